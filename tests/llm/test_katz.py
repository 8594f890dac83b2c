"""Katz scores against a dictionary version that also checks that probabilities sum to one."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from seclog.llm import katz
from seclog.llm.common import lower_words
from tests.llm.helpers import awkward, docs


def slow(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows]
    words = [[*lower_words(t or ""), b"\n"] for _, t, *_ in rows]
    uni, pairs, times = Counter(), Counter(), Counter()
    for out, w in zip(held, words, strict=True):
        if not out:
            uni.update(w)
            pairs.update(zip([None, *w], w, strict=False))
            times.update([None, *w[:-1]])
    n, v = uni.total(), len(uni)
    hist = lambda c: [sum(x == r for x in c.values()) for r in range(1, 7)]
    d1, d2 = katz.discounts(hist(uni)), katz.discounts(hist(pairs))
    cut = lambda c, d: c if c > 5 else d[c] * c
    mass = sum(cut(c, d1) for c in uni.values())
    total = n if mass < n else n + 1
    word = lambda w: cut(uni[w], d1) / total if uni[w] else 1 - mass / total
    after = defaultdict(dict)
    for (a, b), c in pairs.items():
        after[a][b] = c
    weight, whole = {}, {}
    for a, seen in after.items():
        own = sum(cut(c, d2) for c in seen.values())
        whole[a] = times[a] if own < times[a] - 1e-12 else times[a] + 1
        weight[a] = (1 - own / whole[a]) / (1 - sum(map(word, seen)))

    def p(a, b):
        if not times[a]:
            return word(b)
        c = pairs.get((a, b), 0)
        return cut(c, d2) / whole[a] if c else weight[a] * word(b)

    for a in list(after)[:40]:
        assert abs(sum(p(a, b) for b in uni) + p(a, b"no such word") - 1) < 1e-9
    base = lambda w: math.log10((uni[w] + 1) / (n + v + 1))
    return [
        (i, out, len(w), sum(uni[x] > 0 for x in w), n, sum(map(base, w)), sum(math.log10(p(a, b)) for a, b in zip([None, *w], w, strict=False)))
        for (i, *_), out, w in zip(rows, held, words, strict=True)
    ]


def same(got, want):
    order = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: (str(r[0]), r[2], r[5]))
    got, want = order(got), order(want)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_scores_of_the_documents_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    same(katz.scored(table).collect(), slow([(r.doc_id, r.text) for r in table.collect()]))


@pytest.mark.parametrize("bounds", [{}, {"block": 300, "bucket": 50, "split": 8}])
def test_awkward_rows_small_blocks_and_split_histories(spark, bounds):
    same(katz.scored(docs(spark, awkward()), **bounds).collect(), slow(awkward()))


def test_few_rows_and_none(spark):
    rows = [(1, "a b a"), (2, None), (None, "a b c"), (5, "x"), (9, "A a a a")]
    same(katz.scored(docs(spark, rows), split=2).collect(), slow(rows))
    assert katz.scored(docs(spark, []).limit(0)).collect() == []
    only_held = [(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2]
    assert {(r.train_tokens, r.n_known, r.base_score, r.score) for r in katz.scored(docs(spark, only_held)).collect()} == {(0, 0, 0.0, 0.0)}
