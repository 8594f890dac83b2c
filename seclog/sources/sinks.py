"""Result tables: append logs in Parquet, partitioned by day, and their current state."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _with_day(rows: DataFrame, us: str) -> DataFrame:
    return rows.withColumn("day", F.to_date(F.timestamp_micros(F.col(us))))


def append_table(
    rows: DataFrame, path: str, us: str = "us", batch: int | None = None, query: str = "stream"
) -> None:
    """Append rows below ``path``, in one folder per batch and day.

    A streaming batch that runs again replaces its own folder, so a retried
    micro-batch leaves no duplicates; streams that share a table need their own
    ``query`` names. Rows appended without a batch get a folder of their own.
    """
    target = f"{path}/batch={uuid.uuid4().hex if batch is None else f'{query}-{batch}'}"
    # Rows of a day meet in few files; a large day is split by size.
    _with_day(rows, us).hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(target)


def read_appended(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    since_us: int | None = None,
    until_us: int | None = None,
) -> DataFrame:
    """What was appended below ``path``; give ``schema`` where it may hold no rows yet.

    ``since_us`` and ``until_us`` name the days to read, so only their folders are opened.
    """
    reader = spark.read.option("basePath", path)
    if schema is not None:
        own = [f for f in schema.fields if f.name not in ("batch", "day")]
        reader = reader.schema(T.StructType([*own]).add("batch", "string").add("day", "date"))
    try:
        rows = reader.parquet(path)
    except AnalysisException as problem:
        if schema is None or problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType(own))  # nothing was appended yet
    if since_us is not None:
        rows = rows.filter(F.col("day") >= F.to_date(F.timestamp_micros(F.lit(since_us))))
    if until_us is not None:
        rows = rows.filter(F.col("day") <= F.to_date(F.timestamp_micros(F.lit(until_us))))
    return rows.drop("batch", "day")


def write_incidents(incidents: DataFrame, path: str, batch: int | None = None) -> None:
    append_table(incidents, path, "us", batch)


def write_blocks(intervals: DataFrame, path: str, batch: int | None = None) -> None:
    append_table(intervals, path, "start_us", batch)


def write_fim_alerts(alerts: DataFrame, path: str, batch: int | None = None) -> None:
    append_table(alerts, path, "us", batch)


def current_blocks(block_log: DataFrame) -> DataFrame:
    """The latest block per address: an upsert by address, read from the append log."""
    fields = [c for c in block_log.columns if c != "ip"]
    return (
        block_log.groupBy("ip")
        .agg(F.max_by(F.struct(*fields), F.col("start_us")).alias("b"))
        .select("ip", *[F.col(f"b.{c}").alias(c) for c in fields])
    )
