"""Token ids in Arrow stream files of equal-length sequences with masks, and the way back."""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seclog.llm.bpe import byte_letters
from seclog.llm.common import Kept, documents, latin_pattern, quiet_tokenizers, texts, tokenizer_path
from seclog.sources.staging import new_folder

#: Ids in a sequence, sequences in a record batch.
LENGTH = 2048
BATCH = 256
END = 0
#: The splitting pattern of byte-level vocabularies (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces in each of the two generations that a worker keeps.
KEPT_PIECES = 400_000


class ByteEncoder:
    """The tokenizers library over pieces of text that it would cut apart itself, each different piece once.

    Texts of Latin-1 are cut by the pattern of byte-level vocabularies, and the library's model encodes the pieces not
    met lately. Texts with other letters, or with the string of a special token, go to the library whole, as do all
    texts if the tokenizer file does more than byte-level cutting.
    """

    def __init__(self, path: str) -> None:
        quiet_tokenizers()
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cutter = spec["pre_tokenizer"] or {}
        self.plain = spec["normalizer"] is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter["add_prefix_space"]
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        self.pieces = latin_pattern(PIECES).findall
        self.model = self.own.model
        self.letters = dict(enumerate(byte_letters()))
        self.kept = Kept(self._piece, KEPT_PIECES)
        #: Bytes that hold any id of the vocabulary.
        self.width = 2 if self.own.get_vocab_size() <= 1 << 16 else 4
        self.code = {2: "H", 4: "I"}[self.width]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned integers of ``width`` bytes."""
        if self._whole(text):
            return self._library(text)
        return b"".join(map(self.kept.__getitem__, self.pieces(text)))

    def _whole(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return True
        return not self.plain or any(map(text.__contains__, self.special))

    def _piece(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _library(self, text: str) -> bytes:
        return array(self.code, self.own.encode(text, add_special_tokens=False).ids).tobytes()


@cache
def byte_encoder(name: str) -> ByteEncoder:
    return ByteEncoder(tokenizer_path(name))


def sequence_schema(length: int, width: int) -> pa.Schema:
    """Sequences of unsigned integers of ``width`` bytes, and masks of one bit an id."""
    kind = {2: pa.uint16(), 4: pa.uint32()}[width]
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Appends ids to one Arrow stream file, in batches of ``batch`` sequences of ``length`` ids.

    All batches but the last have ``batch`` rows, so id k of the file is in batch k // (batch * length). The last
    sequence is filled up with 0; its mask is false there. At most one batch of ids waits in memory.
    """

    def __init__(self, path: str, length: int = LENGTH, batch: int = BATCH, width: int = 4) -> None:
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(path)
        store.create_dir(place.rsplit("/", 1)[0], recursive=True)
        self.out = store.open_output_stream(place)
        self.schema, self.kind = sequence_schema(length, width), {2: np.uint16, 4: np.uint32}[width]
        self.writer = pa.ipc.new_stream(self.out, self.schema)
        self.length, self.batch = length, batch
        self.waiting, self.held, self.total = [], 0, 0

    def append(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(self.kind))
        self.held += len(ids)
        self.total += len(ids)
        full = self.length * self.batch
        if self.held >= full:
            flat = np.concatenate(self.waiting)
            for at in range(0, len(flat) - full + 1, full):
                self._write(flat[at : at + full], full)
            rest = flat[len(flat) // full * full :]
            self.waiting, self.held = [rest], len(rest)

    def _write(self, ids: np.ndarray, used: int) -> None:
        mask = np.arange(len(ids)) < used
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            flat = np.concatenate(self.waiting)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.kind)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        self.writer.close()
        self.out.close()


class SequenceReader:
    """Random access to the ids of one stream file: batches are mapped or buffered once, slices copy nothing."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(path)
        source = pa.memory_map(place) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(place)
        self.batches = list(pa.ipc.open_stream(source))
        self.flat = [b.column("ids").flatten().to_numpy() for b in self.batches]
        self.per_batch = len(self.flat[0]) if self.flat else 1

    def parts(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views of the ids from ``start`` on, one a batch."""
        at, skip = divmod(start, self.per_batch)
        while n:
            part = self.flat[at][skip : skip + n]
            yield part
            at, skip, n = at + 1, 0, n - len(part)

    def ids(self, start: int, n: int) -> np.ndarray:
        parts = list(self.parts(start, n))
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.empty(0, np.uint16)])

    def sequence(self, k: int) -> tuple[pa.Array, pa.Array]:
        """Sequence ``k`` and its mask, both Arrow arrays that view the file."""
        batch, row = divmod(k, self.batches[0].num_rows)
        return tuple(self.batches[batch].column(c)[row].values for c in ("ids", "mask"))


INDEX = "file string, first long, least_digest long, least_place long, starts array<long>, lengths array<long>, total long"


def encoded_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end: int = END) -> DataFrame:
    """(doc_id, digest, place, ids): encoded where the texts lie, so that only ids move on.

    ``digest`` is a hash of the text and ``place`` a number of the row, by which rows of one doc_id are told apart.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(tokenizer)
        code = encoder.code if end < 1 << 16 else "I"
        stop = array(code, [end]).tobytes()
        for batch in batches:
            # some rows at a time: a batch of very long texts would make one of very many ids
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [encoder.encode(t) for t in texts(part)]
                if code != encoder.code:
                    ids = [np.frombuffer(x, np.uint16).astype(np.uint32).tobytes() for x in ids]
                kept = [part.column(c) for c in ("doc_id", "digest", "place")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([x + stop for x in ids], pa.binary())], names=["doc_id", "digest", "place", "ids"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("place"), "text")
    return rows.mapInArrow(run, f"doc_id {key}, digest long, place long, ids binary")


def dealt_by_range(rows: DataFrame, keys: DataFrame, parts: int) -> DataFrame:
    """``rows`` (doc_id, digest, ...) in ``parts`` partitions, each a range of doc_id, then digest; null doc_id first.

    The borders are quantiles of doc_id, a number, read from ``keys`` alone, so that rows are made once. A doc_id that
    holds several quantiles, and null, have the partitions between them to themselves and are dealt there by digest.
    """
    numbers, nulls = keys.agg(F.count("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    first = 0 if not nulls else parts if not numbers else max(1, min(parts - 1, round(parts * nulls / (numbers + nulls))))
    steps = [k / (parts - first) for k in range(1, parts - first)]
    borders = keys.agg(F.percentile_approx("doc_id", steps, 100 * parts)).first()[0] if steps and numbers else []
    border = F.lit(sorted(borders)) if borders else F.array().cast("array<long>")
    below = F.size(F.filter(border, lambda b: b < F.col("doc_id")))
    upto = F.size(F.filter(border, lambda b: b <= F.col("doc_id")))
    spread = F.pmod(F.shiftright("digest", 32), F.lit(1 << 32))  # its upper half, in the order of digest but for the sign
    spread = F.when(F.col("digest") < 0, spread - (1 << 31)).otherwise(spread + (1 << 31))

    def within(low: Column, n: Column) -> Column:
        return low + F.floor(spread * n / (1 << 32)).cast("int")

    part = F.when(F.col("doc_id").isNull(), within(F.lit(0), F.lit(max(first, 1)))).otherwise(within(first + below, upto - below + 1))
    # the number of a partition is the row's own, no hash of it
    return rows.withColumn("part", F.least(part, F.lit(parts - 1))).repartitionById(parts, "part").drop("part")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end: int = END, length: int = LENGTH) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into stream files under ``folder``; returns the index, which lies there too.

    Documents are encoded where they lie; their ids are written, dealt by ranges of doc_id (then text hash and row, so
    that one doc_id may fill several files) and sorted, so each file holds a range, null first. A file's name is new
    for each attempt of a task; only files of attempts that succeeded are in the index. An index row has the file,
    doc_ids with their starts and lengths in it, and at the last row of a file its total.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = byte_encoder(tokenizer).width if end < 1 << 16 else 4
        kind = {2: np.uint16, 4: np.uint32}[width]
        path = f"{folder}/sequences/{uuid.uuid4().hex}.arrow"
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or SequenceWriter(path, length, width=width)
            starts, lengths = [], []
            for ids in batch.column("ids"):
                flat = np.frombuffer(ids.as_buffer(), kind)
                starts.append(out.total)
                lengths.append(len(flat))
                out.append(flat)
            yield row(batch.column("doc_id"), path, starts[0], batch.column("digest")[0].as_py(), batch.column("place")[0].as_py(), starts, lengths, 0)
        if out:
            out.close()
            yield row(batch.column("doc_id")[:0], path, out.total, None, None, [], [], out.total)

    def row(ids, path, first, digest, place, starts, lengths, total):
        kind = ids.type
        numbers = [pa.array([x], pa.int64()) for x in (first, digest, place)]
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (starts, lengths)]
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([path]), *numbers, *lists, pa.array([total], pa.int64())],
            names=["doc_ids", "file", "first", "least_digest", "least_place", "starts", "lengths", "total"],
        )

    order = ["doc_id", "digest", "place"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt_by_range(encoded_documents(docs, tokenizer, end), docs.select("doc_id"), parts).sortWithinPartitions(*order)
    rows.mapInArrow(run, f"doc_ids array<{key}>, {INDEX}").write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(f"doc_ids array<{key}>, {INDEX}").parquet(f"{folder}/index")


def file_starts(index: DataFrame) -> DataFrame:
    """(file, base): ids in all files before; files hold ranges of rows, so they are ordered by their first one.

    The window is over files, not documents.
    """
    least = F.struct(F.get("doc_ids", F.lit(0)).alias("doc_id"), F.col("least_digest").alias("digest"), F.col("least_place").alias("place"))
    files = index.groupBy("file").agg(F.sum("total").alias("n"), F.min(F.when((F.col("first") == 0) & (F.size("lengths") > 0), least)).alias("least"))
    before = Window.orderBy(F.col("least.doc_id").asc_nulls_first(), "least.digest", "least.place").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_token_files(index: DataFrame) -> DataFrame:
    """One row per document of the index: doc_id, start, n_tokens, ids_crc32, all from the files."""
    key = index.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if (file := batch.column("file")[i].as_py()) != name:
                    name, reader = file, SequenceReader(file)
                starts, lengths = (batch.column(c)[i].as_py() for c in ("starts", "lengths"))
                base = batch.column("base")[i].as_py()
                sums = [reduce(lambda crc, part: zlib.crc32(part.astype("<u4"), crc), reader.parts(s, n), 0) for s, n in zip(starts, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[i].values, pa.array([base + s for s in starts], pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    bases = file_starts(index)
    rows = index.filter("size(lengths) > 0").join(bases, "file").repartition(index.sparkSession.sparkContext.defaultParallelism * 4, "file").sortWithinPartitions("file", "first")
    return rows.select("doc_ids", "file", "starts", "lengths", "base").mapInArrow(run, f"doc_id {key}, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) as token files and read them back: doc_id, start, n_tokens, ids_crc32 per row.

    Each document is its ids and one end id, in ascending doc_id order (null first; rows with one doc_id by a hash of
    their text), so ``start`` is the number of ids before it. Null text counts as empty: the end id alone. Other columns are not
    read; no rows give no rows.
    """
    return read_token_files(write_token_files(docs, folder or new_folder(docs.sparkSession, "tokens")))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir))
