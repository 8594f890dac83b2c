"""Audit records: one JSON object per line, ``{ts, time, type, payload}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RECORD = "ts double, time string, type string, payload {payload}"


def parse_audit(lines: DataFrame, line: str, payload: str) -> DataFrame:
    """Split JSON text into ``ts, time, type, payload``; ``payload`` is a struct's fields.

    Lines that are not JSON give nulls. Fields a record type lacks are null.
    """
    schema = _RECORD.format(payload=f"struct<{_as_fields(payload)}>")
    return lines.withColumn("__r", F.from_json(line, schema)).select(
        *[c for c in lines.columns if c != line], "__r.ts", "__r.time", "__r.type", "__r.payload"
    )


def _as_fields(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (p.split(None, 1) for p in ddl.split(",")))


def read_audit(spark: SparkSession, path: str, payload: str) -> DataFrame:
    """Audit files with the given payload fields; only the fields used are parsed."""
    return spark.read.schema(_RECORD.format(payload=f"struct<{_as_fields(payload)}>")).json(path)


def audit_records(rows: DataFrame, record_type: str, us: str = "us") -> DataFrame:
    """Rows as audit JSON lines (column ``value``); all columns but ``us`` form the payload."""
    payload = F.struct(*[c for c in rows.columns if c != us])
    return rows.select(
        F.to_json(
            F.struct(
                (F.col(us) / 1_000_000).alias("ts"),
                F.date_format(F.timestamp_micros(F.col(us)), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"),
                F.lit(record_type).alias("type"),
                payload.alias("payload"),
            )
        ).alias("value")
    )


def write_audit(rows: DataFrame, record_type: str, path: str, us: str = "us") -> None:
    audit_records(rows, record_type, us).write.mode("append").text(path)
