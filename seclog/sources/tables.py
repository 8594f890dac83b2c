"""Columnar tables: reading with UTC event time, dimension tables and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seclog.functions.ip import ipv4_to_long, ipv6_network_of, ipv6_to_hex, network_of

GEO_SCHEMA = T.StructType(
    [
        T.StructField("cidr", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("country_code", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("isp", T.StringType()),
        T.StructField("org", T.StringType()),
        T.StructField("asn", T.StringType()),
        T.StructField("proxy", T.BooleanType()),
        T.StructField("hosting", T.BooleanType()),
    ]
)
REPUTATION_SCHEMA = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("abuse_score", T.IntegerType()),
        T.StructField("country_code", T.StringType()),
        T.StructField("isp", T.StringType()),
        T.StructField("total_reports", T.IntegerType()),
        T.StructField("last_reported", T.StringType()),
        T.StructField("is_public", T.BooleanType()),
        T.StructField("fetched_us", T.LongType()),
    ]
)
ALLOWLIST_SCHEMA = T.StructType([T.StructField("cidr", T.StringType())])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; timestamps without zone become UTC instants.

    They are read as such, not cast, so that bounds on them reach the files.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if any(isinstance(f.dataType, T.TimestampNTZType) for f in df.schema):
        kind = lambda f: T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType
        df = spark.read.schema(T.StructType([T.StructField(f.name, kind(f)) for f in df.schema])).parquet(f"{folder}/{name}.parquet")
    return df


def _network(cidr: Column) -> tuple[Column, Column, Column]:
    """(number, digits, bits) of a network literal: one of the first two is set if it is one."""
    parts = F.split(cidr, "/")
    number, digits = ipv4_to_long(parts[0]), ipv6_to_hex(parts[0])
    most = F.when(number.isNotNull(), 32).otherwise(128)
    bits = F.when(F.size(parts) == 1, most).when(F.size(parts) == 2, F.try_element_at(parts, F.lit(2)).try_cast("int"))
    fits = bits.between(0, most)
    return F.when(fits, number), F.when(fits, digits), bits


def with_network(df: DataFrame, cidr: str = "cidr") -> DataFrame:
    """Turn a network (``a.b.c.d/n``, ``x:y::/n``) or a single address into its first address and ``prefix_len``.

    IPv4 has its first address as a number in ``lo``, IPv6 as hexadecimal digits in ``lo6``. Host bits are cleared;
    rows that are no network are left out: ``no_networks`` gives those.
    """
    number, digits, bits = _network(F.col(cidr))
    return (
        df.withColumn("prefix_len", bits)
        .withColumn("__number", number)
        .withColumn("__digits", digits)
        .filter(F.col("__number").isNotNull() | F.col("__digits").isNotNull())
        .withColumn("lo", network_of(F.col("__number"), F.col("prefix_len")))
        .withColumn("lo6", ipv6_network_of(F.col("__digits"), F.col("prefix_len")))
        .drop("__number", "__digits")
    )


def no_networks(df: DataFrame, cidr: str = "cidr") -> DataFrame:
    """The rows that ``with_network`` leaves out."""
    number, digits, _ = _network(F.col(cidr))
    return df.filter(number.isNull() & digits.isNull())


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV files with a header; columns may be missing or in any order."""
    text = spark.read.csv(path, header=True)
    return text.select(
        *[
            (F.col(f.name) if f.name in text.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def load_geo(spark: SparkSession, path: str) -> DataFrame:
    """Geo networks from CSV files with a ``cidr`` column."""
    return with_network(_csv(spark, path, GEO_SCHEMA))


def load_reputation(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, REPUTATION_SCHEMA)


def load_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """Allowlisted addresses and networks from CSV files with a ``cidr`` column."""
    return with_network(_csv(spark, path, ALLOWLIST_SCHEMA))
