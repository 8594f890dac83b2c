"""Event model shared by batch and streaming jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seclog.config import DAY_US

# Event kinds and sources, spelled as the log pipeline emits them.
SSH_KINDS = ("SSH_FAIL", "SSH_SUCCESS")
WEB_KINDS = ("WEB_SCAN", "WEB_AUTH_FAIL", "WEB_EXPLOIT_ATTEMPT")
DB_KINDS = ("DB_AUTH_FAIL",)
FW_KINDS = ("FW_BLOCK", "FW_HONEYPOT_PORT")
SYS_KINDS = ("SUDO_FAIL", "SU_FAIL")
NET_HINT = "NET_HINT"
HANDLED_KINDS = SSH_KINDS + WEB_KINDS + DB_KINDS + FW_KINDS + SYS_KINDS
ALL_KINDS = HANDLED_KINDS + (NET_HINT,)
ALL_SOURCES = ("auth", "net", "nginx", "apache", "mysql", "ufw", "syslog")

META = T.StructType(
    [
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("ua", T.StringType()),
        T.StructField("threat_score", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("action", T.StringType()),
        T.StructField("target_user", T.StringType()),
        T.StructField("hint", T.StringType()),
        T.StructField("db", T.StringType()),
        T.StructField("type", T.StringType()),
    ]
)

SEC_EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("meta", META),
    ]
)


def meta_struct(**given: Column) -> Column:
    """The typed ``meta`` struct with the given fields set and the rest null."""
    return F.struct(
        *[
            given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in META.fields
        ]
    )


def with_micros(df: DataFrame, ts: str = "ts", us: str = "us") -> DataFrame:
    """Add the epoch-microsecond order column that every windowed operator uses."""
    return df.withColumn(us, F.unix_micros(F.col(ts).cast("timestamp")))


def within(df: DataFrame, since_us: int | None = None, until_us: int | None = None, us: str = "us") -> DataFrame:
    """Rows with ``since_us <= us <= until_us``.

    ``us`` is derived, so a filter on it reaches no file. Where ``ts`` (the instant that ``us`` is of) or a partition
    column ``day`` (its date, UTC) is there, the bounds are put on them as well: row groups and folders outside are skipped.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    for bound, is_in in ((since_us, lambda c, low: c >= low), (until_us, lambda c, high: c <= high)):
        if bound is None:
            continue
        df = df.filter(is_in(F.col(us), F.lit(bound)))
        if kinds.get("ts") == T.TimestampType():
            df = df.filter(is_in(F.col("ts"), F.timestamp_micros(F.lit(bound))))
        if kinds.get("day") == T.DateType():
            df = df.filter(is_in(F.col("day"), F.date_add(F.lit("1970-01-01").cast("date"), bound // DAY_US)))
    return df
