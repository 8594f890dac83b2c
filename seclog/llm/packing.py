"""Best-fit packing of documents into sequences of bounded length, with bounds that certify how few will do."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seclog.llm.bpe import word_bpe
from seclog.llm.common import documents, texts
from seclog.sources.staging import staged

#: Ids in a sequence.
CAPACITY = 2048
END = 0
#: Pieces packed together, in memory at once; pieces that partitions exchange and pack anew together.
BLOCK, POOL = 1 << 16, 1 << 15
ROUNDS = 5
#: sequence_id is round, block, bin; a block is a task's partition and its count there.
BIN_BITS, COUNT_BITS, BLOCK_BITS = 22, 16, 36


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: (bin of each piece, its place there, bins). The open bins wait by the room they have left."""
    bins, places = np.zeros(len(lengths), np.int32), np.zeros(len(lengths), np.int32)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin has room r
    n = 0
    order = np.argsort(-lengths, kind="stable")
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = some >> length
        if fits:
            r = (fits & -fits).bit_length() - 1 + length
            b = room[r].pop()
            if not room[r]:
                some ^= 1 << r
        else:
            r, b, n = capacity, n, n + 1
        bins[i], places[i] = b, capacity - r
        if left := r - length:
            room[left].append(b)
            some |= 1 << left
    return bins, places, n


def least_bins(count: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing of ``count[length]`` pieces a length goes below.

    The largest bound of two families of dual feasible functions.

    One counts pieces over capacity - e as whole bins and those under e not at all, for each e; the other rounds
    (k + 1) * length down to whole bins and divides by k. In integers throughout.
    """
    size = np.arange(capacity + 1, dtype=np.int64)
    pieces, total = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(count * size)))
    e = np.arange(capacity // 2 + 1)
    whole = pieces[-1] - pieces[capacity - e + 1]
    between = total[capacity - e + 1] - total[e]
    bound = int((whole + -(-between // capacity)).max())
    for k in range(1, 33):
        grown = (k + 1) * size
        value = np.where(grown % capacity == 0, k * size, grown // capacity * capacity)
        bound = max(bound, -(-int((count * value).sum()) // (k * capacity)))
    return bound


def _pack(lengths: np.ndarray, capacity: int, old: tuple[np.ndarray, np.ndarray] | None = None) -> dict:
    """Bin and place of each piece, and how readily it moves on.

    2 where bins go beyond the lower bound of these pieces, and in the emptiest bin; 1 where the bound certifies the
    bins but they would hold more ids; 0 in full bins. ``old``: bins and places that hold already; they stay unless
    best fit needs fewer.
    """
    bins, places, n = best_fit(lengths, capacity)
    if old is not None:
        names, numbers = np.unique(old[0], return_inverse=True)
        if len(names) <= n:
            bins, places, n = numbers.astype(np.int32), old[1], len(names)
    room = capacity - np.bincount(bins, lengths, minlength=n).astype(np.int64)
    certain = n == least_bins(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)
    spare = n > -(-int(lengths.sum()) // capacity)
    ready = np.where(bins == room.argmax(), 2, (1 if certain else 2) if spare else 0)
    return {"bin": bins, "place": places, "ready": np.where(room[bins] > 0, ready, 0).astype(np.int32)}


def _table(rows: pa.Array, lengths: np.ndarray, block: int, found: dict, schema: pa.Schema) -> pa.RecordBatch:
    columns = [rows, pa.array(lengths, pa.int64()), pa.array(np.full(len(lengths), block, np.int64)), *map(pa.array, found.values())]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def packed(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, pool: int = POOL, rounds: int = ROUNDS, cut: tuple[Batches, str] | None = None) -> DataFrame:
    """``pieces``, any columns with ``length`` from 1 to ``capacity``, and where each lies: sequence_id and offset.

    Each task packs its rows in blocks by best-fit decreasing and bounds each block's bins from below. Where that
    certifies the bins they are done, but for the emptiest; elsewhere only full bins are. The other bins go, whole,
    to new groups of about ``pool`` pieces, where bins of many blocks meet; these are packed and bounded anew, and
    the bins they came in stay where that needs no fewer. Where all bins exceed the bound of all pieces by more than
    one a block, bins with room in certified blocks move too, since a block may have too many long pieces for its
    short ones. It ends when the bound of all pieces is met, an exchange gains nothing, or after ``rounds`` of them.
    Each round is a written table; the driver sees counts, of at most ``capacity`` lengths. Columns named sequence_id
    or offset are replaced; equal rows are pieces of their own; no rows give no rows. ``cut`` is a function that makes
    pieces of the batches of what is given instead, and the schema of these: it runs in the same workers.
    """
    given = T.StructType.fromDDL(cut[1]) if cut else pieces.schema
    kept = T.StructType([f for f in given.fields if f.name not in ("sequence_id", "offset")])
    names = kept.names
    schema = T.StructType([T.StructField("row", kept), *T.StructType.fromDDL("size long, block long, bin int, place int, ready int").fields])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        held, n, made = [], 0, TaskContext.get().partitionId() << COUNT_BITS

        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            lengths = whole.column(given.names.index("length")).cast(pa.int64()).to_numpy()
            columns = [whole.column(given.names.index(f.name)).combine_chunks().cast(f.type) for f in arrow.field("row").type]
            row = pa.StructArray.from_arrays(columns, fields=list(arrow.field("row").type))
            return _table(row, lengths, made, _pack(lengths, capacity), arrow)

        for batch in cut[0](batches) if cut else batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                if n + part.num_rows > block:
                    yield out()
                    held, n, made = [], 0, made + 1
                held.append(part)
                n += part.num_rows
        if n:
            yield out()

    def again(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        lengths = group.column("size").to_numpy()
        old = (group.column("block").to_numpy() << BIN_BITS) | group.column("bin").to_numpy()
        found = _pack(lengths, capacity, (old, group.column("place").to_numpy()))
        kept = group.column("row").combine_chunks().cast(arrow.field("row").type)
        return pa.Table.from_batches([_table(kept, lengths, key[0].as_py(), found, arrow)])

    done = []
    # by position: a name may hold a dot
    table = staged(pieces.toDF(*[f"_{i}" for i, _ in enumerate(pieces.columns)] if not cut else pieces.columns).mapInArrow(first, schema), "packed")
    count = np.zeros(capacity + 1, np.int64)
    for size, n in table.groupBy("size").count().collect():
        count[size] = n
    bound = least_bins(count, capacity)
    settled = moving = 0
    for k in range(rounds + 1):
        opens = F.count_if(F.col("place") == 0)  # one piece of each bin
        ready = [c for r in (1, 2) for c in (F.count_if(F.col("ready") >= r), F.count_if((F.col("ready") >= r) & (F.col("place") == 0)))]
        bins, blocks, *by_ready = table.agg(opens, F.countDistinct("block"), *ready).first()
        excess = settled + bins - bound
        least = 1 if excess > blocks else 2
        pieces_left, bins_left = by_ready[2 * least - 2 : 2 * least]
        stop = k == rounds or excess == 0 or bins_left < 2 or (k and bins == moving)
        number = F.shiftleft(F.lit(k).cast("long"), BLOCK_BITS + BIN_BITS)
        number = number.bitwiseOR(F.shiftleft("block", BIN_BITS)).bitwiseOR(F.col("bin").cast("long"))
        stays = table if stop else table.filter(F.col("ready") < least)
        done.append(stays.select(*[F.col(f"row.`{c}`").alias(c) for c in names], number.alias("sequence_id"), F.col("place").cast("long").alias("offset")))
        if stop:
            break
        settled, moving = settled + bins - bins_left, bins_left
        dealt = table.filter(F.col("ready") >= least).withColumn("to", F.pmod(F.xxhash64(F.lit(k), "block", "bin"), F.lit(-(-pieces_left // pool))))
        table = staged(dealt.groupBy("to").applyInArrow(again, schema), "packed")
    out = done[0]
    for other in done[1:]:
        out = out.unionAll(other)
    return out


def token_cutter(key: str, capacity: int = CAPACITY, tokenizer: str = "word_bpe_49k.json", end: int = END, with_ids: bool = False) -> tuple[Batches, str]:
    """A function from batches of documents (doc_id of type ``key``, text) to batches of pieces, and their schema."""
    stop = array("I", [end]).tobytes()
    step = 4 * capacity
    schema = f"doc_id {key}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            source, number, lengths, sums, parts = [], [], [], [], []
            for i, text in enumerate(texts(batch)):
                ids = bpe.encode(text) + stop
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    source.append(i)
                    number.append(k)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    if with_ids:
                        parts.append(part)
            columns = {"doc_id": batch.column("doc_id").take(pa.array(source, pa.int64())), "piece": pa.array(number, pa.int32()), "start": pa.array([capacity * k for k in number], pa.int64()), "length": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(parts, pa.binary())} if with_ids else {}))

    return cut, schema


def sequences(placed: DataFrame) -> DataFrame:
    """The sequences themselves, from packed pieces with their ``ids``: sequence_id, n_pieces, ids (32 bit, little-endian)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b""), lambda ids, part: F.concat(ids, part["ids"]))
    return placed.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), whole.alias("ids"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Documents cut into pieces of at most ``capacity`` ids and packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and one end id. Only those longer than ``capacity`` are cut, every ``capacity`` ids. Null
    text counts as empty, a piece of the end id alone; null and repeated doc_ids give their own pieces; other columns
    are not read; no rows give no rows. ``with_ids`` adds the ids of each piece, of which ``sequences`` are made.
    """
    cut = token_cutter(docs.schema["doc_id"].dataType.simpleString(), capacity, with_ids=with_ids)
    return packed(docs.select("doc_id", "text"), capacity, cut=cut)


def op12_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document; the SQL of it would need the tokenizer."""
    return pack_documents(documents(spark, sf_dir))
