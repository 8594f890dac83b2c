"""Katz backoff: Good-Turing discounted word pairs over discounted words, in tables partitioned by hash.

Texts are read once and become blocks: the tokens of some documents as numbers in a list of the block's different
words. A block asks the partitions of the word table for its words, and the partitions of the pair table for its
pairs; the questions carry the block's own training counts, so asking and counting is one shuffle. Rows are packed
arrays, sorted and compressed, worked on with NumPy inside tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seclog.llm.common import documents, lower_words, texts
from seclog.llm.toxicity import held_out
from seclog.sources.staging import new_folder, staged

#: Counts above this are taken as they are.
TRUSTED = 5
#: Tokens in a block, entries of a table partition, training tokens of a history from which its pairs are split.
BLOCK = 2_000_000
BUCKET = 1_500_000
SPLIT = 1_000_000
#: At most about this many histories are split, since their sums pass through the driver.
MOST_SPLIT = 4096
#: The end of a document as a token: no word has a line break. The beginning is a history only.
END = b"\n"
BEGIN = np.uint64(0xFFFFFFFF)
_HIGH = np.uint64(32)


def pack(a: np.ndarray, rising: bool = False) -> bytes:
    """An array of 8-byte numbers, compressed with like bytes side by side; ``rising`` keeps the steps."""
    a = np.diff(a, prepend=a.dtype.type(0)) if rising and len(a) else a
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), 8).T).tobytes()
    return len(a).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(b: bytes, kind: type = np.int64, rising: bool = False) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    raw = pa.decompress(b[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(kind).reshape(n)
    return np.cumsum(a, dtype=kind) if rising else a


def discounts(n: list[int]) -> np.ndarray:
    """d[r] for counts r up to TRUSTED from the numbers of types seen once, twice, ...: Good-Turing, renormalised.

    Where the numbers give no factor in (0, 1] for some count, all take half a count off instead.
    """
    d = np.ones(TRUSTED + 1)
    r = np.arange(1, TRUSTED + 1)
    half = (r - 0.5) / r
    n = np.array(n, float)
    if (n[: TRUSTED + 1] <= 0).any():
        d[1:] = half
        return d
    cut = (TRUSTED + 1) * n[TRUSTED] / n[0]
    found = ((r + 1) * n[1 : TRUSTED + 1] / (r * n[:TRUSTED]) - cut) / (1 - cut) if cut < 1 else half
    d[1:] = found if ((found > 0) & (found <= 1)).all() and (found < 1).any() else half
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c > TRUSTED, c, d[np.minimum(c, TRUSTED)] * c)


@dataclass
class Words:
    """What the word table says of the corpus: tokens, types, documents, discounts; and the histories that are split."""

    tokens: int
    types: int
    docs: int
    hist: list[int]
    split: int
    hot: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.d = discounts(self.hist)
        lost = sum((1 - self.d[r]) * r * self.hist[r - 1] for r in range(1, TRUSTED + 1))
        self.total = self.tokens if lost > 0 else self.tokens + 1
        #: Probability of all words that training does not have.
        self.unknown = lost / self.total if lost > 0 else 1 / self.total
        self.hot_ids = np.array(sorted(self.hot), np.uint64)
        self.hot_counts = np.array([self.hot[int(i)] for i in self.hot_ids], np.int64)

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) / self.total, self.unknown)

    def bucket(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Partition of each pair: by its history, a split history by parts of its second words too."""
        h = keys >> _HIGH
        part = np.zeros(len(keys), np.uint64)
        if len(self.hot_ids):
            at = np.minimum(np.searchsorted(self.hot_ids, h), len(self.hot_ids) - 1)
            hot = self.hot_ids[at] == h
            parts = (self.hot_counts[at[hot]] // self.split + 1).astype(np.uint64)
            part[hot] = (keys[hot] & np.uint64(0xFFFFFFFF)) * np.uint64(0x9E3779B1) % np.uint64(1 << 32) % parts + np.uint64(1)
        mixed = (h + (part << _HIGH)) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _blocks(docs: DataFrame, block: int) -> DataFrame:
    """A row per block: its documents, tokens, different words by hash, and their training counts."""
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, n_words long, train_docs long, train_tokens long, doc_ids array<{key}>, held binary, lengths binary, tokens binary, words binary, train binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, tokens, ids, held, lengths, n = _Numbers(), [], [], [], [], 0

        def row(kind: pa.DataType) -> pa.RecordBatch:
            words = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
            order = np.argsort(words)
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            flat = place[np.concatenate(tokens)]
            out = np.array(held)
            train = np.bincount(flat[np.repeat(~out, lengths)], minlength=len(words)).astype(np.int64)
            values = (
                uuid.uuid4().int >> 65, len(words), int((~out).sum()), int(train.sum()), ids, out.tobytes(), pack(np.array(lengths, np.int64)),
                pack(flat), pack(words[order], True), pack(train),
            )
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(kind), *[pa.binary()] * 5)
            names = [c.split(" ")[0] for c in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc_id, text, out in zip(batch.column("doc_id").to_pylist(), texts(batch), batch.column("held").to_pylist(), strict=True):
                words = lower_words(text)
                words.append(END)
                tokens.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                ids.append(doc_id)
                held.append(out)
                lengths.append(len(words))
                n += len(words)
                if n >= block:
                    yield row(kind)
                    numbers, tokens, ids, held, lengths, n = _Numbers(), [], [], [], [], 0
        if ids:
            yield row(kind)

    return docs.select("doc_id", "text", "held").mapInArrow(run, schema)


def _rows(schema: str, rows: Iterator[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [c.split(" ") for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _sum_by_key(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, their summed counts, for each row its key's place, and a row of each key."""
    one, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return one, np.bincount(at, weights=np.concatenate(counts), minlength=len(one)).astype(np.int64), at, first


ASK_WORDS = "bucket int, block long, words binary, train binary"
WORDS = "bucket int, block long, places binary, counts binary, words binary, n long, v long, hist array<long>, hot array<long>"
ASK_PAIRS = "bucket int, block long, keys binary, train binary, second binary"
PAIRS = "bucket int, block long, counts binary, sums binary, seen binary, hist array<long>, hot binary"


def _ask_words(blocks: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, train in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "train")), strict=True):
                words, train = unpack(words, np.uint64, True), unpack(train)
                part = (words >> np.uint64(64 - bits)).astype(np.int64)
                cuts = np.searchsorted(part, np.arange((1 << bits) + 1))
                yield _rows(ASK_WORDS, ((k, block, pack(words[a:b], True), pack(train[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a))

    return blocks.select("block", "words", "train").mapInArrow(run, ASK_WORDS)


def _count_words(asked: DataFrame, bits: int, split: int) -> DataFrame:
    """Per partition the word table (block null) and an answer to each block: each word's place in it, and its count."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        words = [unpack(x, np.uint64, True) for x in table.column("words").to_pylist()]
        one, total, at, _ = _sum_by_key(words, [unpack(x) for x in table.column("train").to_pylist()])
        place = np.cumsum(total > 0)
        seen = total[total > 0]
        hist = np.bincount(np.minimum(seen, TRUSTED + 2), minlength=TRUSTED + 3)[1 : TRUSTED + 2].tolist()
        big = np.flatnonzero(total > split)
        hot = np.stack((place[big], total[big]), 1).ravel().tolist()
        out = [(bucket, None, None, pack(seen), pack(one[total > 0], True), int(seen.sum()), len(seen), hist, hot)]
        end = 0
        for block, own in zip(table.column("block").to_pylist(), words, strict=True):
            i = at[end : end + len(own)]
            end += len(own)
            out.append((bucket, block, pack(place[i], True), pack(total[i]), None, None, None, None, None))
        return pa.Table.from_batches([_rows(WORDS, iter(out))])

    return asked.groupBy("bucket").applyInArrow(run, WORDS)


@dataclass
class _Block:
    """A block with the answers of the word table: ids and counts of its words, and its different pairs."""

    ids: np.ndarray
    counts: np.ndarray
    tokens: np.ndarray
    lengths: np.ndarray
    held: np.ndarray
    keys: np.ndarray
    at: np.ndarray
    first: np.ndarray
    history: np.ndarray

    @classmethod
    def of(cls, row: dict, bits: int, model: Words) -> _Block:
        ids, counts = [], []
        for a in sorted(row["word_answers"], key=lambda a: a["bucket"]):
            c = unpack(a["counts"])
            ids.append(np.where(c > 0, (unpack(a["places"], rising=True) << bits) + a["bucket"], 0))
            counts.append(c)
        ids, counts = np.concatenate(ids).astype(np.uint64), np.concatenate(counts)
        if len(ids) and int(ids.max()) >= int(BEGIN):
            raise ValueError("more different words than 32-bit numbers")
        tokens, lengths = unpack(row["tokens"]), unpack(row["lengths"])
        starts = np.cumsum(lengths) - lengths
        before = np.roll(tokens, 1)
        left, history = ids[before], counts[before]
        left[starts], history[starts] = BEGIN if model.docs else 0, model.docs
        keys, first, at = np.unique((left << _HIGH) | ids[tokens], return_index=True, return_inverse=True)
        return cls(ids, counts, tokens, lengths, np.frombuffer(row["held"], bool), keys, at, first, history[first])

    def asked(self, model: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs to ask for, by partition and then key, and the partitions."""
        which = np.flatnonzero(self.keys >> _HIGH)
        part = model.bucket(self.keys[which], n)
        order = np.argsort(part, kind="stable")
        return which[order], part[order]


def _parts(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return ((int(part[a]), a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def _ask_pairs(answered: DataFrame, model: Words, bits: int, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block.of(row, bits, model)
                train = np.bincount(b.at, weights=np.repeat(~b.held, b.lengths), minlength=len(b.keys)).astype(np.int64)
                which, part = b.asked(model, n)
                second = b.counts[b.tokens[b.first]]
                yield _rows(ASK_PAIRS, ((k, row["block"], pack(b.keys[w], True), pack(train[w]), pack(second[w])) for k, s, e in _parts(part) for w in [which[s:e]]))

    return answered.mapInArrow(run, ASK_PAIRS)


def _count_pairs(asked: DataFrame, model: Words) -> DataFrame:
    """Per partition its numbers of types by count and sums of split histories (block null), and an answer to each block.

    An answer has the counts of the pairs asked for, and for each history among them the unigram probability of
    the words seen after it and how many of those were seen once, twice, ...
    """

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys = [unpack(x, np.uint64, True) for x in table.column("keys").to_pylist()]
        one, total, at, first = _sum_by_key(keys, [unpack(x) for x in table.column("train").to_pylist()])
        second = np.concatenate([unpack(x) for x in table.column("second").to_pylist()])[first]
        h = one >> _HIGH
        starts = np.concatenate(([0], np.flatnonzero(np.diff(h)) + 1))
        sums = np.add.reduceat(np.where(total > 0, model.p(second), 0.0), starts)
        seen = np.stack([np.add.reduceat((total == r).astype(np.int64), starts) for r in range(1, TRUSTED + 1)])
        hist = np.bincount(np.minimum(total[total > 0], TRUSTED + 2), minlength=TRUSTED + 3)[1 : TRUSTED + 2].tolist()
        hot = np.flatnonzero(np.isin(h[starts], model.hot_ids))
        sent = np.concatenate((h[starts][hot].astype(float)[None], sums[hot][None], seen[:, hot].astype(float)))
        out = [(bucket, None, None, None, None, hist, np.ascontiguousarray(sent).tobytes())]
        end = 0
        owner = np.cumsum(np.isin(np.arange(len(one)), starts)) - 1
        for block, own in zip(table.column("block").to_pylist(), keys, strict=True):
            i = at[end : end + len(own)]
            end += len(own)
            mine = np.unique(owner[i])
            out.append((bucket, block, pack(total[i]), pack(sums[mine]), pack(seen[:, mine].ravel()), None, None))
        return pa.Table.from_batches([_rows(PAIRS, iter(out))])

    return asked.groupBy("bucket").applyInArrow(run, PAIRS)


def _score(answered: DataFrame, model: Words, pair_hist: list[int], hot: dict[int, np.ndarray], bits: int, n: int, key: str) -> DataFrame:
    schema = f"doc_id {key}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    d = discounts(pair_hist)
    worth = (1 - d[1:]) * np.arange(1, TRUSTED + 1)

    def probabilities(b: _Block, row: dict) -> np.ndarray:
        """P(word | history) of each different pair: its discounted share if seen, else the history's weight times P(word)."""
        word = model.p(b.counts[b.tokens[b.first]])
        which, part = b.asked(model, n)
        answers = {a["bucket"]: a for a in row["pair_answers"] or []}
        count, sums, lost = np.zeros(len(b.keys), np.int64), np.zeros(len(b.keys)), np.zeros(len(b.keys))
        h = b.keys >> _HIGH
        for k, s, e in _parts(part):
            w, a = which[s:e], answers[k]
            count[w] = unpack(a["counts"])
            _, place = np.unique(h[w], return_inverse=True)
            sums[w] = unpack(a["sums"], np.float64)[place]
            lost[w] = (worth @ unpack(a["seen"]).reshape(TRUSTED, -1))[place]
        for i, total in hot.items():
            own = h == np.uint64(i)
            sums[own], lost[own] = total[0], worth @ total[1:]
        known = h > 0
        times = np.maximum(b.history, 1)
        whole = np.where(lost > 0, times, times + 1)
        rest = np.where(lost > 0, lost, 1.0) / whole
        backed = rest / np.maximum(1 - sums, model.unknown) * word
        return np.where(~known, word, np.where(count > 0, discounted(count, d) / whole, backed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                b = _Block.of(row, bits, model)
                starts = np.cumsum(b.lengths) - b.lengths
                each = np.log10(probabilities(b, row))[b.at]
                c = b.counts[b.tokens]
                base = np.log10((b.counts + 1) / (model.tokens + model.types + 1))[b.tokens]
                total = lambda x: np.add.reduceat(x, starts)
                columns = (b.held, b.lengths, total((c > 0).astype(np.int64)), np.full(len(starts), model.tokens), total(base), total(each))
                names = [x.split(" ")[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, *map(pa.array, columns)], names=names)

    return answered.mapInArrow(run, schema)


def _sums(rows: DataFrame) -> list[int]:
    return [x or 0 for x in rows.agg(*[F.sum(F.col("hist")[r]) for r in range(TRUSTED + 1)]).first()]


def scored(docs: DataFrame, modulus: int = 7, rest: int = 2, block: int = BLOCK, bucket: int = BUCKET, split: int = SPLIT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words, A-Z lower-cased, and one end; the model learns from rows that are not held out (crc32 of
    the doc_id modulo ``modulus`` is ``rest``; a null doc_id is not held out). ``score`` is log10 of
    P(first | begin) * ... * P(end | last). A pair seen r times after a history seen t times has d(r) * r / t; others
    have the history's backoff weight times the word's own probability, the weight such that all words and the
    unknown one sum to 1. A history all of whose pairs keep their counts is taken as seen once more, which leaves
    something for the rest; after a history that training does not have, the word's own probability counts.
    Words are discounted likewise; what is left is the probability of the unknown word. Words are told apart by
    64-bit hashes. Null text counts as empty (its end is its only token), repeated rows each count and give a row,
    other columns are not read, no rows give no rows; without training rows every score is 0.
    """
    spark = docs.sparkSession
    key = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), modulus, rest).alias("held"))
    name, parts = f"blocks_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One file row per block, bucketed by it: the two joins below move the answers only.
    _blocks(rows, block).write.option("path", new_folder(spark, "blocks")).bucketBy(parts, "block").sortBy("block").saveAsTable(name)
    blocks = spark.table(name)
    facts = blocks.agg(F.sum("n_words"), F.sum("train_docs"), F.sum("train_tokens")).first()
    entries, train_docs, train_tokens = (x or 0 for x in facts)
    split = max(split, train_tokens // MOST_SPLIT)
    bits = max(5, (entries // bucket).bit_length())
    words = staged(_count_words(_ask_words(blocks, bits), bits, split), "words")
    table = words.filter("block is null")
    n, v = (x or 0 for x in table.agg(F.sum("n"), F.sum("v")).first())
    hot = {(at << bits) + r["bucket"]: c for r in table.filter("size(hot) > 0").select("bucket", "hot").collect() for at, c in zip(r["hot"][::2], r["hot"][1::2], strict=True)}
    if train_docs > split:
        hot[int(BEGIN)] = train_docs
    model = Words(n, v, train_docs, _sums(table), split, hot)
    answers = words.filter("block is not null").groupBy("block").agg(F.collect_list(F.struct("bucket", "places", "counts")).alias("word_answers"))
    known = blocks.join(answers, "block")
    buckets = max(32, -(-train_tokens // bucket))
    pairs = staged(_count_pairs(_ask_pairs(known.select("block", "held", "lengths", "tokens", "word_answers"), model, bits, buckets), model), "pairs")
    own = pairs.filter("block is null")
    split_sums: dict[int, np.ndarray] = {}
    for r in own.filter("length(hot) > 0").select("hot").collect():
        for h, *x in np.frombuffer(r["hot"], float).reshape(TRUSTED + 2, -1).T:
            split_sums[int(h)] = split_sums.get(int(h), 0) + np.array(x)
    pair_answers = pairs.filter("block is not null").groupBy("block").agg(F.collect_list(F.struct("bucket", "counts", "sums", "seen")).alias("pair_answers"))
    both = known.join(pair_answers, "block", "left").select("block", "doc_ids", "held", "lengths", "tokens", "word_answers", "pair_answers")
    result = staged(_score(both, model, _sums(own), split_sums, bits, buckets, key), "scores")
    spark.sql(f"DROP TABLE {name}")
    return result


def op10_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))
