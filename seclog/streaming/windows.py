"""Streaming operators Spark has natively: ingest, windows, sessions, dedup, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_table(
    spark: SparkSession, folder: str, name: str, schema: T.StructType, max_files: int = 1000
) -> DataFrame:
    """Parquet files called ``name`` below ``folder`` as a stream; NTZ times become UTC instants."""
    df = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name)
        .option("maxFilesPerTrigger", max_files)
        .parquet(folder)
    )
    for field in schema.fields:
        if isinstance(field.dataType, T.TimestampNTZType):
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def stream_kafka(spark: SparkSession, servers: str, topic: str, max_offsets: int = 1_000_000) -> DataFrame:
    """Log lines from a Kafka topic (needs the Kafka package on the class path)."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", max_offsets)
        .load()
    )
    return raw.select(
        F.xxhash64("topic", "partition", "offset").alias("event_id"),
        F.col("value").cast("string").alias("line"),
        F.col("timestamp").alias("arrived"),
    )


def with_event_time_bound(events: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """Bound how late events may be; later ones are dropped and counted by the query."""
    return events.withWatermark(ts, delay)


def window_counts(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Events per address and kind in fixed windows, emitted once a window is closed."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        events.filter(F.col("src_ip").isNotNull())
        .groupBy(w.alias("w"), "src_ip", "kind")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "src_ip", "kind", "n")
    )


def decoy_sessions(records: DataFrame, gap: str = "180 seconds") -> DataFrame:
    """Decoy sessions, emitted once their gap has passed."""
    return (
        records.groupBy(F.session_window("ts", gap).alias("w"), "ip")
        .agg(
            F.max(F.unix_micros("ts")).alias("end_us"),
            F.count(F.when(F.col("type") == "honeypot_command", 1)).alias("commands"),
            F.count(F.when(F.col("type") == "honeypot_credentials", 1)).alias("auth_attempts"),
            F.count(F.lit(1)).alias("records"),
        )
        .select("ip", F.unix_micros("w.start").alias("session_us"), "end_us", "commands", "auth_attempts", "records")
    )


def deduplicated(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Drop repeats of an id that arrive within the event-time bound."""
    return events.dropDuplicatesWithinWatermark([key])


def enriched(events: DataFrame, lookup: DataFrame, on: str = "src_ip") -> DataFrame:
    """Stream-static join with a lookup table (see ``geo_lookup``)."""
    return events.join(lookup, on, "left")
