"""SimHash near copies: fingerprints that share a one-wildcard segment are compared, links make components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seclog.llm.common import documents, lower_words, mapped, texts
from seclog.llm.components import roots
from seclog.llm.exact import one_by_key, row_key
from seclog.sources.staging import staged

BITS = 64
WIDTH = 4
DISTANCE = 4
SEED = 42
#: Fingerprints of one key that are compared in one go; larger keys are compared block by block.
BLOCK = 4096


def fingerprint(text: str, width: int = WIDTH) -> int:
    """Bits set in over half the hashes of the word shingles, repeats counted; 0 without words."""
    words = lower_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    k = min(width, len(words))
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)]
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], "<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, with_digest: bool = False) -> DataFrame:
    """(doc_id, fp): a 64-bit fingerprint, as signed long, per row; and ``sha``, SHA-256 of the text in hex, if asked for."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> dict:
        whole = texts(batch)
        found = np.array([fingerprint(t) for t in whole], np.uint64)
        sha = {"sha": [hashlib.sha256(t.encode()).hexdigest() for t in whole]} if with_digest else {}
        return {"doc_id": batch.column("doc_id"), "fp": pa.array(found.view(np.int64))} | sha

    return mapped(docs.select("doc_id", "text"), rows, f"doc_id {key}, fp long" + ", sha string" * with_digest)


def segments(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(offset, length) of as many segments as needed for one of them to differ by at most one bit."""
    n = distance // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return list(zip(cuts, [b - a for a, b in zip(cuts, cuts[1:], strict=False)], strict=False))


def variants(fp: Column, distance: int = DISTANCE) -> Column:
    """A key per bit: its segment without that bit, tagged with the bit's number.

    Two fingerprints share the key of a bit exactly if their segments agree in all other bits.
    """
    keys = []
    for offset, length in segments(distance):
        segment = F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << length) - 1))
        for bit in range(length):
            tag = F.lit(offset + bit).cast("long")
            rest = segment.bitwiseAND(F.lit(((1 << length) - 1) & ~(1 << bit)))
            # A segment of more bits than leave room for the number is hashed; what is not alike fails the comparison.
            keys.append(F.shiftleft(rest, 6).bitwiseOR(tag) if length <= 57 else F.xxhash64(rest, tag))
    return F.array(*keys)


def forest(x: np.ndarray, y: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Links that span what the links within ``x`` (or only those between ``x`` and ``y``) connect: fewer than nodes."""
    sides = (x, x if y is None else y)
    left = [np.arange(len(s)) for s in sides[: 1 if y is None else 2]]
    links: list[tuple[int, int]] = []
    while len(left[0]):
        stack = [(0, int(left[0][0]))]
        left[0] = left[0][1:]
        while stack:
            side, node = stack.pop()
            other = 0 if y is None else 1 - side
            value = sides[side][node]
            near = np.bitwise_count(sides[other][left[other]] ^ value) <= distance
            if near.any():
                for k in left[other][near].tolist():
                    links.append((int(value), int(sides[other][k])))
                    stack.append((other, k))
                left[other] = left[other][~near]
    return links


def _near_in_keys(keys: np.ndarray, fps: np.ndarray, distance: int) -> list[np.ndarray]:
    """Links of all keys of a sorted run of rows: short groups side by side, long ones as forests."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    starts = np.concatenate(([0], cuts))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    group = np.repeat(sizes, sizes)
    found = []
    for d in range(1, 8):
        i = np.flatnonzero((keys[:-d] == keys[d:]) & (group[:-d] <= 8)) if len(keys) > d else np.empty(0, np.int64)
        if not len(i):
            break
        i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= distance]
        found.append(np.stack((fps[i], fps[i + d]), 1))
    for s, n in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist(), strict=True):
        links = forest(fps[s : s + n], None, distance)
        if links:
            found.append(np.array(links, np.uint64))
    return found


LINKS = "a long, b long, key long, block long, fps binary"


def _links(found: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    pairs = np.concatenate(found).view(np.int64) if found else np.empty((0, 2), np.int64)
    n = len(pairs)
    empty = [pa.nulls(n, schema.field(c).type) for c in ("key", "block", "fps")]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])), *empty], schema=schema)


def links(nodes: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b) fingerprints within ``distance``; what they connect is what all such pairs connect.

    Every fingerprint goes to one key per bit. Rows of a key arrive together and sorted; groups of up to ``block``
    are compared at once and leave at most one link per member. Larger ones leave blocks, which are then paired
    by a join and compared pair by pair in other tasks, so no task holds more than two blocks.
    """

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("block", pa.int64()), ("fps", pa.binary())])
        keys, fps, part = np.empty(0, np.int64), np.empty(0, np.uint64), 0

        def blocks(k: int, v: np.ndarray, number: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((None, None, k, number, v.tobytes()), schema, strict=True)], schema=schema)

        for batch in batches:
            keys = np.concatenate((keys, batch.column("key").to_numpy(zero_copy_only=False)))
            fps = np.concatenate((fps, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
            while len(keys) and (last := int(np.searchsorted(keys, keys[-1]))) < len(keys):
                if part and keys[0] != keys[-1]:  # the rest of a key that began in earlier batches
                    end = int(np.searchsorted(keys, keys[0], "right"))
                    yield from (_links(_near_in_keys(keys[:end], fps[:end], distance), schema), blocks(int(keys[0]), fps[:end], part))
                    keys, fps, part = keys[end:], fps[end:], 0
                    continue
                if last:
                    yield _links(_near_in_keys(keys[:last], fps[:last], distance), schema)
                    keys, fps = keys[last:], fps[last:]
                if len(keys) > block:
                    yield from (_links(_near_in_keys(keys[:block], fps[:block], distance), schema), blocks(int(keys[0]), fps[:block], part))
                    keys, fps, part = keys[block:], fps[block:], part + 1
                    continue
                break
        if len(keys):
            yield _links(_near_in_keys(keys, fps, distance), schema)
            if part:
                yield blocks(int(keys[0]), fps, part)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("fps").to_pylist(), batch.column("fps2").to_pylist(), strict=True):
                found = np.array(forest(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), distance), np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in (0, 1)], names=["a", "b"])

    # Few bytes make many rows here: spread them first, over a number of tasks that no later step merges.
    spread = nodes.select("fp").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = spread.select("fp", F.explode(variants(F.col("fp"), distance)).alias("key"))
    one = staged(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(within, LINKS), "links")
    parts = one.filter("key is not null").select("key", "block", "fps")
    others = parts.select("key", F.col("block").alias("block2"), F.col("fps").alias("fps2"))
    pairs = parts.join(others, "key").filter("block < block2").select("fps", "fps2")
    return one.filter("key is null").select("a", "b").union(pairs.mapInArrow(across, "a long, b long")).distinct()


def _least(marked: DataFrame, value: Column, distance: int) -> tuple[DataFrame, DataFrame]:
    """(fp, root) of the different fingerprints of ``marked``, and (root, least): the least ``value`` of each component."""
    nodes = marked.groupBy("fp").agg(F.min(value).alias("first"))
    found = roots(links(nodes.select("fp"), distance)).withColumnRenamed("node", "fp")
    placed = staged(nodes.join(found, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "placed")
    # A table of its own: a join with it then has two shuffled sides and can split a large component.
    least = staged(placed.groupBy("root").agg(F.min("first").alias("least")), "least")
    return placed.select("fp", "root"), least


def near_copies(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (hex), component_id.

    Rows link when their fingerprints differ in ``distance`` bits or fewer; component_id is the smallest doc_id that
    links reach, itself included. Null text counts as empty; texts without words have fingerprint 0. A null doc_id
    takes part and never is the smallest (component_id is null if there is no other); repeated rows each give a
    row; other columns are not read; an empty table gives no rows.
    """
    marked = staged(fingerprints(docs), "fingerprints")
    placed, least = _least(marked, F.col("doc_id"), distance)
    named = placed.join(least, "root").select("fp", F.col("least").alias("component_id"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(named, "fp").select("doc_id", text, "component_id")


def without_near_copies(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row of each component of ``near_copies``; all columns unchanged, whatever their names.

    The row with the smallest doc_id stays, of several the one whose text has the smallest digest, of equal ones any
    one; a row with null doc_id stays only if its component has no other doc_id.
    """
    marked = staged(fingerprints(docs, with_digest=True), "fingerprints")
    _, least = _least(marked, F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "sha"), distance)
    stay = least.select(row_key(F.col("least.doc_id"), F.col("least.sha")).alias("key"))
    return one_by_key(docs, stay)


def op4_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(documents(spark, sf_dir))
