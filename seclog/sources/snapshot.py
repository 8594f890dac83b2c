"""File snapshots for integrity monitoring: content hash and metadata per path."""

from __future__ import annotations

import hashlib
import os
import re
import stat
import zlib
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seclog.sources.staging import staged

#: Bytes up to which a file is read whole; bytes read at a time of larger ones.
LARGE, BLOCK = 64 << 20, 8 << 20


@dataclass(frozen=True)
class Watch:
    """A file, or a folder with an optional name pattern, searched in depth or not."""

    path: str
    recursive: bool = True
    pattern: str | None = None


SNAPSHOT = "path string, hash string, size long, mtime long, mode string, uid int, gid int"


#: What a file of another store counts as, beyond its bytes, when Spark packs files into tasks: some 2,000 small files make a task.
_OPEN_COST = 64 << 10

#: Names that are not looked at, as in Spark's readers, but for folders of metadata; entries after which a task hands on the folders it has left.
_HIDDEN, _METADATA = re.compile(r"\.|_[^=]*\Z|.*\._COPYING_\Z", re.DOTALL), ("_metadata", "_common_metadata")
_SPREAD = 10_000

_ENTRY = "path string, length long, mtime long, pattern string"


def _roots(spark: SparkSession, watch: Watch) -> list[tuple[str, bool, str | None, bool]] | None:
    """(path, whether in depth, expression for names, true) of each local file or folder that a watch names; None for other stores."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(watch.path)
    store = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if store.getUri().getScheme() != "file":
        return None
    pattern = hadoop.GlobPattern(watch.pattern).compiled().pattern() if watch.pattern else None
    found = store.globStatus(place) or []
    return [(re.sub("^file:/*", "/", at.getPath().toString()), watch.recursive, pattern, True) for at in found]


def _entries(place: str, watched: bool) -> Iterator[tuple[str, os.stat_result]]:
    """A file, or what a folder holds, with its state. Links are followed; what is hidden or gone is left out."""
    try:
        found = os.scandir(place)
    except FileNotFoundError as gone:
        if watched:  # the driver has just seen it: files must not count as deleted where a task cannot see them
            raise FileNotFoundError(f"{place} is not there for a task; watched folders must be mounted on all executors") from gone
        return
    except NotADirectoryError:
        paths = iter([place])
    else:
        paths = (entry.path for entry in found)
    for path in paths:
        try:
            path.encode()
            state = os.stat(path)
        except (OSError, UnicodeEncodeError):  # nor could Spark name or open it
            continue
        name = os.path.basename(path)
        if not _HIDDEN.match(name) or (stat.S_ISDIR(state.st_mode) and name.startswith(_METADATA)):
            yield path, state


def _below(place: str, deep: bool, pattern: str | None, watched: bool) -> Iterator[tuple[str, int | None, int | None, str | None]]:
    """Rows of the files with content below a place, and, without length, of folders that are left to other tasks."""
    folders, seen = [place], 0
    while folders:
        at = folders.pop()
        for path, state in _entries(at, watched and at == place):
            seen += 1
            if not stat.S_ISDIR(state.st_mode):
                if state.st_size and (pattern is None or re.fullmatch(pattern, os.path.basename(path), re.DOTALL)):
                    yield path, state.st_size, state.st_mtime_ns // 1_000_000 * 1000, None
            elif deep and seen < _SPREAD:
                folders.append(path)
            elif deep:
                yield path, None, None, pattern
        if seen >= _SPREAD:
            yield from ((path, None, None, pattern) for path in folders)
            return


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("mtime", pa.int64()), ("pattern", pa.string())])
    rows = (row for batch in batches for place in zip(*batch.to_pydict().values(), strict=True) for row in _below(*place))
    while some := list(islice(rows, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)


def _listed(spark: SparkSession, roots: list[tuple[str, bool, str | None, bool]]) -> DataFrame:
    """(path, length, mtime) of local files: folders are dealt to tasks, and what a task leaves is dealt again."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places, rounds = spark.createDataFrame(roots, "path string, deep boolean, pattern string, watched boolean"), []
    while not rounds or not places.isEmpty():
        found = staged(places.repartition(parts, "path").mapInArrow(_walk, _ENTRY), "listed")
        rounds.append(found.filter(F.col("length").isNotNull()).drop("pattern"))
        places = found.filter(F.col("length").isNull()).select("path", F.lit(True).alias("deep"), "pattern", F.lit(False).alias("watched"))
    return reduce(DataFrame.unionByName, rounds)


def _files(spark: SparkSession, watches: Sequence[Watch]) -> Iterator[DataFrame]:
    """For each watch of other stores that exists, its files: listed once, by the driver, and opened only where the content is asked for."""
    for watch in watches:
        reader = spark.read.format("binaryFile").options(
            recursiveFileLookup=watch.recursive, ignoreMissingFiles=True, ignoreCorruptFiles=True
        )
        try:
            yield (reader.option("pathGlobFilter", watch.pattern) if watch.pattern else reader).load(watch.path)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise


@contextmanager
def _many_files_a_task(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, _OPEN_COST)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _intact(content: bytes, sums: bytes) -> bool:
    """Whether a content is what Hadoop's checksums (marker, bytes a sum, sums) say; where the head is not theirs, they say nothing."""
    if len(sums) < 8 or not sums.startswith(b"crc\0"):
        return True
    step = int.from_bytes(sums[4:8], "big")
    if not step or len(sums) % 4:
        return False
    chunks = range(0, len(content), step)
    return sums[8 : 8 + 4 * len(chunks)] == b"".join(zlib.crc32(content[i : i + step]).to_bytes(4, "big") for i in chunks)


def _whole_hash(path: str) -> str | None:
    folder, name = os.path.split(path)
    try:
        with open(path, "rb") as f:
            content = f.read()
        try:
            with open(f"{folder}/.{name}.crc", "rb") as f:
                sums = f.read()
        except PermissionError:
            return None
        except OSError:  # none there
            sums = b""
    except OSError:
        return None
    return hashlib.sha256(content).hexdigest() if _intact(content, sums) else None


def _block_hash(path: str) -> str | None:
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    digest = hashlib.sha256()
    try:
        with store.open_input_stream(place) as f:
            while block := f.read(BLOCK):
                digest.update(block)
    except OSError:
        return None
    return digest.hexdigest()


def _hashes(files: DataFrame, large: int) -> DataFrame:
    """(path, hash), null where reading fails: of local files of up to ``large`` bytes read whole, of larger ones in blocks, one task a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, lengths = batch.column("path").to_pylist(), batch.column("length").to_pylist()
            hashes = [_block_hash(p) if n > large else _whole_hash(p) for p, n in zip(paths, lengths, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(hashes, pa.string())], names=["path", "hash"])

    # large files are few and long: as many tasks as Spark allows, the largest first in each; not merged for being few rows
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.select("path", "length").repartition(parts, "path").sortWithinPartitions(F.desc("length"))
    return dealt.mapInArrow(run, "path string, hash string")


def scan_snapshot(
    spark: SparkSession, watches: Sequence[Watch], manifest: DataFrame | None = None, large: int = LARGE
) -> DataFrame:
    """(path, hash, size, mtime, mode, uid, gid), one row per distinct file.

    Files are listed once and without being opened, and the scan is done when this returns. Local and mounted folders
    are listed and read by tasks, so the driver holds nothing of them; other stores are listed by the driver and read by
    Spark. Files of up to ``large`` bytes are hashed whole, larger ones block by block, so a file of any size takes
    bounded memory; for these the store must be one that ``pyarrow.fs`` knows.
    A file that is there but cannot be read, or is not what Hadoop's checksums beside it say, has a null hash. Hidden
    and empty files, and watches that do not exist, are left out. Mode and owner
    are not visible to Spark; ``manifest`` (path, mode, uid, gid) supplies them where it is collected.
    """
    places = [(watch, _roots(spark, watch)) for watch in watches]
    roots = [root for _, local in places for root in local or ()]
    found = list(_files(spark, [watch for watch, local in places if local is None]))
    if not roots and not found:
        return spark.createDataFrame([], SNAPSHOT)
    listed = [files.select("path", "length", F.unix_micros("modificationTime").alias("mtime")) for files in found]
    if roots:
        listed.append(_listed(spark, roots))
    with _many_files_a_task(spark):
        # a file may change between the reads: listed once, by its latest state
        latest = F.max_by(F.struct("length", "mtime"), "mtime").alias("at")
        once = staged(reduce(DataFrame.unionByName, listed).groupBy("path").agg(latest).select("path", "at.*"), "files")
        read = [_hashes(once.filter(F.col("path").startswith("/") | (F.col("length") > large)), large)]
        read += [files.filter(F.col("length") <= large).select("path", F.sha2("content", 256).alias("hash")) for files in found]
        hashes = staged(reduce(DataFrame.unionByName, read), "hashes")
    files = once.join(hashes.groupBy("path").agg(F.max("hash").alias("hash")), "path", "left").select(
        "path", "hash", F.col("length").alias("size"), "mtime"
    )
    if manifest is None:
        return files.select(
            "*",
            F.lit(None).cast("string").alias("mode"),
            F.lit(None).cast("int").alias("uid"),
            F.lit(None).cast("int").alias("gid"),
        )
    return files.join(manifest.select("path", "mode", "uid", "gid"), "path", "left")
