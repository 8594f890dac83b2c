"""Hourly states that reports combine instead of counting events again: counters and a sketch of failing addresses.

States of one hour may come from several batches; what is merged is the same whichever way they are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclog.config import HOUR_US
from seclog.schema import within

TRACKED = 10_000
_FAIL = "kind = 'SSH_FAIL' AND src_ip IS NOT NULL"


def hourly_states(events: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """One row an hour: us (its start), events, ssh_fails, a sketch of the addresses that failed and of how many there are."""
    hour = F.col("us") - F.pmod(F.col("us"), F.lit(HOUR_US))
    return events.groupBy(hour.alias("us")).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("kind") == "SSH_FAIL").alias("ssh_fails"),
        F.expr(f"approx_top_k_accumulate(src_ip, {tracked}) FILTER (WHERE {_FAIL})").alias("failing"),
        F.expr(f"hll_sketch_agg(src_ip, 12) FILTER (WHERE {_FAIL})").alias("addresses"),
    )


def _merged(tracked: int) -> list[Column]:
    return [
        F.sum("events").alias("events"),
        F.sum("ssh_fails").alias("ssh_fails"),
        F.expr(f"approx_top_k_combine(failing, {tracked})").alias("failing"),
        F.expr("hll_union_agg(addresses)").alias("addresses"),
    ]


def compacted(states: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """One state an hour, whatever number of batches it came from."""
    return states.groupBy("us").agg(*_merged(tracked))


def counters(states: DataFrame, since_us: int | None = None, until_us: int | None = None) -> DataFrame:
    """(us, events, ssh_fails) per hour that starts in the span."""
    return within(states, since_us, until_us).groupBy("us").agg(F.sum("events").alias("events"), F.sum("ssh_fails").alias("ssh_fails"))


def top_failing(
    states: DataFrame, since_us: int | None = None, until_us: int | None = None, limit: int = 10, tracked: int = TRACKED
) -> DataFrame:
    """(src_ip, fails, error): addresses with the most failures in the hours that start in the span, from their states.

    ``fails`` is at most ``error`` from the true count, and an address that is missing has at most ``error`` more than
    the last: 0 while 0.75 * ``tracked`` addresses or fewer occur (with room for the estimate of their number), else
    1 / (0.75 * ``tracked``) of all failures in the span. A day reads 24 compacted rows.
    """
    # grouped, since sketches of no rows at all can't be combined
    whole = within(states, since_us, until_us).groupBy(F.lit(0).alias("span")).agg(*_merged(tracked))
    few = F.expr("hll_sketch_estimate(addresses)") * 1.1 < 0.75 * tracked
    error = F.when(few, 0).otherwise(F.ceil(F.col("ssh_fails") / (0.75 * tracked))).cast("long")
    items = whole.filter("ssh_fails > 0").select(error.alias("error"), F.explode(F.expr(f"approx_top_k_estimate(failing, {tracked})")).alias("i"))
    return items.select(F.col("i.item").alias("src_ip"), F.col("i.count").alias("fails"), "error").orderBy(F.desc("fails"), "src_ip").limit(limit)
