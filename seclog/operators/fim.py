"""File-integrity monitoring over snapshots: path, hash, size, mtime, mode, uid, gid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclog.functions.scalar import file_severity
from seclog.schema import within

FACTS = ("hash", "size", "mtime", "mode", "uid", "gid")


def baseline_init(baseline: DataFrame, snapshot: DataFrame, now_us: int) -> DataFrame:
    """Baseline plus the readable paths it does not hold yet; known rows stay as they are."""
    fresh = (
        snapshot.filter(F.col("hash").isNotNull())
        .join(baseline, "path", "left_anti")
        .select(
            "path", *FACTS, F.lit(now_us).alias("first_seen_us"), F.lit(now_us).alias("last_seen_us")
        )
    )
    return baseline.select(*fresh.columns).unionByName(fresh)


def _paired(baseline: DataFrame, snapshot: DataFrame) -> DataFrame:
    old = baseline.select(
        "path",
        F.struct(*FACTS).alias("old"),
        *[c for c in ("first_seen_us", "last_seen_us") if c in baseline.columns],
    )
    new = snapshot.select("path", F.struct(*FACTS).alias("new"))
    return old.join(new, "path", "full_outer")


def change_kind(alert_on_create: bool = True, alert_on_delete: bool = True) -> Column:
    """created / deleted / modified / permission, null for no alert.

    A file that is present but unreadable (null hash) is skipped.
    """
    readable = F.col("new.hash").isNotNull()
    created = F.col("old").isNull() & readable
    deleted = F.col("new").isNull()
    return (
        F.when(created, F.when(F.lit(alert_on_create), "created"))
        .when(deleted, F.when(F.lit(alert_on_delete), "deleted"))
        .when(readable & ~F.col("old.hash").eqNullSafe(F.col("new.hash")), "modified")
        .when(readable & ~F.col("old.mode").eqNullSafe(F.col("new.mode")), "permission")
    )


def diff(
    baseline: DataFrame,
    snapshot: DataFrame,
    now_us: int,
    alert_on_create: bool = True,
    alert_on_delete: bool = True,
) -> DataFrame:
    """Changes between the baseline and a snapshot: one full outer join on the path."""
    change = change_kind(alert_on_create, alert_on_delete)
    return (
        _paired(baseline, snapshot)
        .withColumn("change", change)
        .filter(F.col("change").isNotNull())
        .select(
            "path",
            "change",
            file_severity(F.col("path")).alias("severity"),
            F.col("old.hash").alias("old_hash"),
            F.col("new.hash").alias("new_hash"),
            F.col("old.mode").alias("old_mode"),
            F.col("new.mode").alias("new_mode"),
            F.col("old.mtime").alias("old_mtime"),
            F.col("new.mtime").alias("new_mtime"),
            F.lit(now_us).alias("us"),
        )
    )


def baseline_merge(
    baseline: DataFrame, snapshot: DataFrame, now_us: int, alert_on_delete: bool = True
) -> DataFrame:
    """The next baseline version: changed rows replaced, new added, deleted dropped.

    Only changed rows get a new ``last_seen_us``; ``first_seen_us`` is kept. With
    delete alerts off, deleted paths stay in the baseline.
    """
    change = change_kind(True, True)
    taken = F.col("__change").isin("created", "modified", "permission")
    rows = _paired(baseline, snapshot).withColumn("__change", change)
    if alert_on_delete:
        rows = rows.filter(F.coalesce(F.col("__change") != "deleted", F.lit(True)))
    rows = rows.filter(F.col("old").isNotNull() | taken)
    pick = F.coalesce(taken, F.lit(False))
    return rows.select(
        "path",
        *[F.when(pick, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in FACTS],
        F.coalesce("first_seen_us", F.lit(now_us)).alias("first_seen_us"),
        F.when(pick, F.lit(now_us)).otherwise(F.col("last_seen_us")).alias("last_seen_us"),
    )


def recent_alerts(alerts: DataFrame, limit: int = 50) -> DataFrame:
    return alerts.orderBy(F.desc("us"), "path").limit(limit)


def alert_counts(alerts: DataFrame, since_us: int) -> DataFrame:
    """Alerts and critical alerts since a point in time, one row."""
    return within(alerts, since_us).agg(
        F.count(F.lit(1)).alias("fim_alert_count"),
        F.count(F.when(F.col("severity") == "CRITICAL", 1)).alias("fim_critical"),
    )
