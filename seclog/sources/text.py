"""Text logs as batch or stream: one row per non-empty line, with the file it came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BLANK = " \t\r\n\f\x0b"


def _lines(raw: DataFrame, place: Column) -> DataFrame:
    """Trimmed non-empty lines; bytes that are not UTF-8 are dropped.

    Equal lines of a file are events of their own, which ``place`` tells apart.
    """
    text = F.btrim(F.translate("value", "�", ""), F.lit(_BLANK))
    file = F.col("_metadata.file_path")
    return (
        raw.select(
            text.alias("line"),
            file.alias("file"),
            F.col("_metadata.file_modification_time").alias("arrived"),
            F.xxhash64(file, "value", place).alias("event_id"),
        )
        .filter(F.length("line") > 0)
        .select("line", "file", "arrived", "event_id")
    )


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(event_id, line, file, arrived) from files, folders or globs.

    ``event_id`` is a hash of file, line and place; equal lines differ in it. It is the same on every read that
    finds the same files and splits them alike.
    """
    return _lines(spark.read.text(path), F.monotonically_increasing_id())


def stream_log_lines(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """The same as a stream over a folder that log files are rotated into.

    ``max_files`` bounds what one micro-batch takes in; the query's checkpoint
    remembers the files that were read, each once. A line's ``event_id`` is drawn; a
    micro-batch that runs again draws anew, and its results replace the earlier ones.
    """
    return _lines(spark.readStream.option("maxFilesPerTrigger", max_files).text(path), F.uuid())
