"""Numeric features of each address's recent activity, and what makes them stand out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclog.config import DAY_US, HOUR_US, SECOND_US
from seclog.operators.sweep import Count, Distinct, GapSum, window_counts
from seclog.schema import ALL_SOURCES, DB_KINDS, FW_KINDS, WEB_KINDS

# Feature names in vector order.
FEATURES = (
    "ssh_fails",
    "ssh_success",
    "web_events",
    "db_fails",
    "fw_blocks",
    "unique_users",
    "source_count",
    "hour_of_day",
    "day_of_week",
    "events_per_min",
    "avg_interval_sec",
)


def ip_window_features(
    events: DataFrame,
    window_sec: int = 60,
    sources: tuple[str, ...] = ALL_SOURCES,
    chunk_us: int = HOUR_US,
) -> DataFrame:
    """The eleven features per (src_ip, instant) over the last ``window_sec``."""
    w = window_sec * SECOND_US
    kind, source = F.col("kind"), F.col("source")
    counts = window_counts(
        events,
        [
            Count("ssh_fails", kind == "SSH_FAIL", w),
            Count("ssh_success", kind == "SSH_SUCCESS", w),
            Count("web_events", kind.isin(*WEB_KINDS), w),
            Count("db_fails", kind.isin(*DB_KINDS), w),
            Count("fw_blocks", kind.isin(*FW_KINDS), w),
            Count("n", F.lit(True), w),
            *[Count(f"source_{s}", source == s, w) for s in sources],
            Distinct("unique_users", F.col("user") != "", w, value=F.col("user")),
            GapSum("span_us", F.lit(True), w),
        ],
        chunk_us=chunk_us,
    )
    us = F.col("us")
    return counts.select(
        "src_ip",
        "us",
        *[F.col(c) for c in FEATURES[:6]],
        sum((F.when(F.col(f"source_{s}") > 0, 1).otherwise(0) for s in sources), F.lit(0)).alias(
            "source_count"
        ),
        (F.floor(us / HOUR_US) % 24).cast("int").alias("hour_of_day"),
        # 1970-01-01 was a Thursday; Monday is 0
        ((F.floor(us / DAY_US) + 3) % 7).cast("int").alias("day_of_week"),
        (F.col("n") / F.lit(window_sec / 60.0)).alias("events_per_min"),
        F.when(F.col("n") >= 2, F.col("span_us") / (F.col("n") - 1) / F.lit(float(SECOND_US)))
        .otherwise(F.lit(0.0))
        .alias("avg_interval_sec"),
    )


def anomaly_reasons(score: Column) -> Column:
    """Why a feature row stands out, as an array of texts."""

    def when(name: str, limit: int, text: str) -> Column:
        value = F.col(name)
        shown = F.format_string("%.1f", value) if name == "events_per_min" else value.cast("string")
        return F.when(value > limit, F.concat(shown, F.lit(text)))

    # Limits and texts.
    found = F.array_compact(
        F.array(
            when("ssh_fails", 3, " SSH failures in window"),
            when("web_events", 10, " web events in window"),
            when("db_fails", 2, " DB failures in window"),
            when("fw_blocks", 1, " firewall blocks"),
            when("unique_users", 3, " distinct usernames"),
            when("source_count", 2, " different log sources"),
            when("events_per_min", 5, " events/min"),
        )
    )
    fallback = F.concat(
        F.lit("statistical anomaly (score="), F.format_string("%.3f", score), F.lit(")")
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(fallback))
