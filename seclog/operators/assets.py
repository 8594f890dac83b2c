"""Asset inventory: what is known about each address, and how far it is trusted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seclog.functions.scalar import iso_from_micros, time_ago
from seclog.operators.enrich import ALL_PREFIXES, matching_networks
from seclog.sources.parsers import network_identity

# Trust levels, and the service an event source stands for.
TRUST_LEVELS = ("allowlisted", "known", "unknown", "suspicious", "attacker")
SERVICE_OF_SOURCE = {"auth": "ssh", "nginx": "http", "apache": "http", "mysql": "mysql"}
FAILS_UNTIL_SUSPICIOUS = 3


def asset_inventory(events: DataFrame, geo: DataFrame | None = None) -> DataFrame:
    """One row per address: first and last seen, event and failure counts, services.

    Users are rows in ``asset_users``; services form a small fixed set.
    """
    service = F.lit(None).cast("string")
    for source, name in SERVICE_OF_SOURCE.items():
        service = F.when(F.col("source") == source, name).otherwise(service)
    out = (
        events.filter(F.col("src_ip").isNotNull())
        .groupBy("src_ip")
        .agg(
            F.min("us").alias("first_seen_us"),
            F.max("us").alias("last_seen_us"),
            F.count(F.lit(1)).alias("event_count"),
            F.count(F.when(F.col("kind") == "SSH_FAIL", 1)).alias("fail_count"),
            F.sort_array(F.collect_set(service)).alias("services"),
        )
    )
    if geo is not None:
        out = out.join(geo.select("src_ip", "country", "flag"), "src_ip", "left")
    return out


def newest_first(assets: DataFrame, as_of_us: int) -> DataFrame:
    """Inventory as listed: ISO times, age text, most recently seen first."""
    age = F.floor((F.lit(as_of_us) - F.col("last_seen_us")) / 1_000_000)
    return assets.select(
        "*",
        iso_from_micros(F.col("first_seen_us")).alias("first_seen_iso"),
        iso_from_micros(F.col("last_seen_us")).alias("last_seen_iso"),
        time_ago(age).alias("last_seen_ago"),
    ).orderBy(F.desc("last_seen_us"), "src_ip")


def asset_users(events: DataFrame) -> DataFrame:
    """Notes of the form ``user:<name>``, one row per address and user."""
    return (
        events.filter(F.col("src_ip").isNotNull() & (F.col("user") != ""))
        .select("src_ip", F.concat(F.lit("user:"), F.col("user")).alias("note"))
        .distinct()
    )


def asset_trust(
    events: DataFrame,
    allowlist: DataFrame | None = None,
    blocked: DataFrame | None = None,
    prefixes: Sequence[int] = ALL_PREFIXES,
) -> DataFrame:
    """Trust per address in closed form.

    Blocked addresses are attackers; allowlisted ones stay so otherwise. Else
    whichever comes first decides: the third SSH failure (suspicious) or the
    first SSH success (known). The third failure needs only three rows per
    address, which the planner keeps per task before the shuffle. At one instant
    the success counts first.
    """
    rows = events.filter(F.col("src_ip").isNotNull())
    order = Window.partitionBy("src_ip").orderBy("us", "event_id")
    third = (
        rows.filter(F.col("kind") == "SSH_FAIL")
        .select("src_ip", "us", "event_id", F.row_number().over(order).alias("n"))
        .filter(F.col("n") <= FAILS_UNTIL_SUSPICIOUS)
        .filter(F.col("n") == FAILS_UNTIL_SUSPICIOUS)
        .select("src_ip", F.col("us").alias("third_fail_us"))
    )
    seen = rows.groupBy("src_ip").agg(
        F.min(F.when(F.col("kind") == "SSH_SUCCESS", F.col("us"))).alias("first_success_us")
    )
    out = seen.join(third, "src_ip", "left")
    trust = (
        F.when(
            F.col("third_fail_us").isNotNull()
            & (
                F.col("first_success_us").isNull()
                | (F.col("third_fail_us") < F.col("first_success_us"))
            ),
            "suspicious",
        )
        .when(F.col("first_success_us").isNotNull(), "known")
        .otherwise("unknown")
    )
    if allowlist is not None:
        listed = (
            matching_networks(seen, allowlist, "src_ip", prefixes)
            .select("src_ip", F.lit(True).alias("listed"))
            .distinct()
        )
        out = out.join(listed, "src_ip", "left")
        trust = F.when(F.col("listed"), "allowlisted").otherwise(trust)
    if blocked is not None:
        held = blocked.select(F.col("ip").alias("src_ip"), F.lit(True).alias("held")).distinct()
        out = out.join(held, "src_ip", "left")
        trust = F.when(F.col("held"), "attacker").otherwise(trust)
    return out.select("src_ip", trust.alias("trust"))


def identity_facts(lines: DataFrame) -> DataFrame:
    """(ip, us, line_id, attribute, value) facts from packet lines (line, src_ip, us, line_id)."""
    return (
        lines.select("us", "line_id", F.explode(network_identity(F.col("line"), F.col("src_ip"))).alias("f"))
        .select("f.ip", "us", "line_id", "f.attribute", "f.value")
        .filter(~((F.col("attribute") == "hostname") & F.col("value").startswith("_")))
    )


def asset_identity(facts: DataFrame) -> DataFrame:
    """Per address: latest MAC and how many hostnames and services it showed."""
    named = facts.filter(F.col("attribute") != "seen")
    mac = named.filter(F.col("attribute") == "mac")
    latest = mac.groupBy("ip").agg(F.max_by("value", F.struct("us", "line_id")).alias("mac"))
    counts = (
        facts.groupBy("ip", "attribute", "value")
        .agg(F.max("us").alias("last_us"))
        .groupBy("ip")
        .agg(
            F.count(F.when(F.col("attribute") == "hostname", 1)).alias("hostnames"),
            F.count(F.when(F.col("attribute") == "service", 1)).alias("services"),
            F.max("last_us").alias("last_seen_us"),
        )
    )
    return counts.join(latest, "ip", "left")


def asset_attributes(facts: DataFrame) -> DataFrame:
    """All hostnames and services seen, one row per address and value."""
    return (
        facts.filter(F.col("attribute").isin("hostname", "service"))
        .groupBy("ip", "attribute", "value")
        .agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    )


def assets_by_trust(trust: DataFrame, level: str) -> DataFrame:
    return trust.filter(F.col("trust") == level)


def asset_summary(trust: DataFrame) -> DataFrame:
    """Addresses per trust level and in total."""
    return (
        trust.rollup("trust")
        .agg(F.count(F.lit(1)).alias("assets"), F.grouping("trust").alias("g"))
        .select(F.when(F.col("g") == 1, "total").otherwise(F.col("trust")).alias("trust"), "assets")
    )
