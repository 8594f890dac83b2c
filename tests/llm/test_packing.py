"""Packing: what is packed against the library's ids, how well against bounds and the best that exists."""

import random
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest

from seclog.llm import packing
from tests.llm.helpers import awkward, docs


def least(lengths, capacity):
    """The fewest bins, by trying all subsets."""
    n = len(lengths)
    fits = [sum(lengths[i] for i in range(n) if s >> i & 1) <= capacity for s in range(1 << n)]

    @cache
    def best(rest):
        if not rest:
            return 0
        first = rest & -rest
        part, found = rest, n
        while part:
            if part & first and fits[part]:
                found = min(found, 1 + best(rest ^ part))
            part = (part - 1) & rest
        return found

    return best((1 << n) - 1)


def test_bounds_are_below_the_best_packing_and_best_fit_near_it():
    rng = random.Random(4)
    met = 0
    for _ in range(150):
        capacity = rng.randint(3, 40)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
        want = least(lengths, capacity)
        bound = packing.least_bins(np.bincount(lengths, minlength=capacity + 1), capacity)
        assert -(-sum(lengths) // capacity) <= bound <= want <= packing.best_fit(np.array(lengths), capacity)[2]
        met += bound == want
    assert met > 130


def check(rows, capacity):
    """Pieces fill their sequences without gaps, up to the capacity; the number of sequences."""
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("kind", ["small", "thirds", "halves", "equal"])
def test_partitions_exchange_until_their_bins_are_few(spark, kind):
    rng = random.Random(kind)
    draw = {"small": lambda: rng.randint(1, 60), "thirds": lambda: rng.randint(30, 37), "halves": lambda: rng.randint(35, 65), "equal": lambda: 40}[kind]
    rows = [(i // 2, draw(), "x", -1, "y", "z") for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, length long, `a.b` string, sequence_id long, block string, row string").repartition(6)
    got = packing.packed(table, capacity=100, block=200, pool=150)
    assert got.columns == ["doc_id", "length", "a.b", "block", "row", "sequence_id", "offset"]
    got = got.collect()
    assert sorted((r.doc_id, r.length) for r in got) == sorted(r[:2] for r in rows)
    lengths = np.array([r[1] for r in rows])
    n, bound = check(got, 100), packing.least_bins(np.bincount(lengths, minlength=101), 100)
    assert n <= packing.best_fit(lengths, 100)[2] * 1.02 and (kind != "equal" or n == bound == 1500)


def test_documents_become_pieces_of_their_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = awkward()
    placed = packing.pack_documents(docs(spark, rows), capacity=100, with_ids=True)
    got = placed.collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc_id, at // 100, at, len(part := ids[at : at + 100]), zlib.crc32(part.tobytes())) for at in range(0, len(ids), 100)]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    n = check(got, 100)
    assert n <= packing.least_bins(np.bincount([r.length for r in got], minlength=101), 100) + 1
    whole = {r.sequence_id: r for r in packing.sequences(placed).collect()}
    assert len(whole) == n
    for r in got:
        assert bytes(whole[r.sequence_id].ids)[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


def test_nothing_to_pack(spark):
    assert packing.pack_documents(docs(spark, []).limit(0)).collect() == []
