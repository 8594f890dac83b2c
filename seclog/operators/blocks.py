"""Temporary blocks: intervals, overrides, the blocklist shared by many nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seclog.config import SECOND_US, BlockLimits, checked
from seclog.operators.scan import Running, running
from seclog.operators.suppress import suppress_within


def block_requests(incidents: DataFrame) -> DataFrame:
    """HIGH incidents as block requests (ip, us, request_id, reason)."""
    return incidents.filter(F.col("severity") == "HIGH").select(
        F.col("src_ip").alias("ip"),
        "us",
        F.col("event_id").alias("request_id"),
        F.array_join("reasons", "; ").alias("reason"),
    )


def block_intervals(
    requests: DataFrame,
    limits: BlockLimits = BlockLimits(),
    unblocks: DataFrame | None = None,
) -> DataFrame:
    """Accepted blocks as half-open intervals ``[start_us, end_us)`` per address.

    A request during an active block is ignored. ``unblocks`` (ip, us, request_id)
    end a block early; the address can be blocked again right after. Each
    unblock starts a new epoch of its address, and epochs are independent.
    """
    checked(limits)
    length = limits.duration_sec * SECOND_US
    if unblocks is None:
        kept = suppress_within(requests, ["ip"], length, tie="request_id")
        return kept.select(
            "ip", F.col("us").alias("start_us"), (F.col("us") + length).alias("end_us"), "reason"
        )
    merged = requests.select("ip", "us", "request_id", "reason", F.lit(0).alias("lift")).unionByName(
        unblocks.select(
            "ip", "us", "request_id", F.lit(None).cast("string").alias("reason"), F.lit(1).alias("lift")
        )
    )
    epochs = running(
        merged.filter(F.col("ip").isNotNull()),
        ["ip"],
        "us",
        {"epoch": Running(F.col("lift"))},
        tie="request_id",
    )
    asked = epochs.filter(F.col("lift") == 0)
    # The unblock that ends epoch n is the one that opens epoch n + 1.
    ends = epochs.filter(F.col("lift") == 1).select(
        "ip", (F.col("epoch") - 1).alias("epoch"), F.col("us").alias("lifted_us")
    )
    kept = suppress_within(asked, ["ip", "epoch"], length, tie="request_id")
    return kept.join(ends, ["ip", "epoch"], "left").select(
        "ip",
        F.col("us").alias("start_us"),
        F.least(F.col("us") + length, F.col("lifted_us")).alias("end_us"),
        "reason",
    )


def active_blocks(intervals: DataFrame, as_of_us: int) -> DataFrame:
    """Blocks in force at ``as_of_us``, newest first."""
    return intervals.filter(
        (F.col("start_us") <= as_of_us) & (F.col("end_us") > as_of_us)
    ).orderBy(F.desc("start_us"), "ip")


def cluster_blocklist(
    messages: DataFrame,
    as_of_us: int,
    limits: BlockLimits = BlockLimits(),
    own_node: str | None = None,
) -> DataFrame:
    """Blocks in force after merging all nodes' block / unblock messages.

    ``messages``: ip, us, message_id, action, reason, ttl (seconds), node_id. The
    last message per address decides; ``own_node`` drops a node's own echoes.
    """
    seen = messages.filter(F.col("us") <= as_of_us)
    if own_node is not None:
        seen = seen.filter(F.col("node_id") != own_node)
    last = seen.groupBy("ip").agg(
        F.max_by(
            F.struct("action", "reason", "ttl", "node_id", "us"), F.struct("us", "message_id")
        ).alias("m")
    )
    expires = F.col("m.us") + F.coalesce("m.ttl", F.lit(limits.default_ttl_sec)) * SECOND_US
    return last.filter((F.col("m.action") == "block") & (expires > as_of_us)).select(
        "ip",
        F.coalesce("m.reason", F.lit("remote_block")).alias("reason"),
        F.col("m.node_id").alias("node_id"),
        F.col("m.us").alias("blocked_us"),
        expires.alias("expire_us"),
    )


def active_nodes(
    heartbeats: DataFrame, as_of_us: int, limits: BlockLimits = BlockLimits()
) -> DataFrame:
    """Nodes heard from within the heartbeat lifetime before ``as_of_us``."""
    last = (
        heartbeats.filter(F.col("us") <= as_of_us).groupBy("node_id").agg(F.max("us").alias("last_us"))
    )
    return last.filter(F.col("last_us") + limits.heartbeat_sec * SECOND_US > as_of_us)
