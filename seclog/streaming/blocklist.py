"""Blocks as a stream: requests, lifts and messages of other nodes in, changes of the block list out.

Addresses share a state by groups, so a batch asks the store a few times a group and not a few times
an address. State per group: the running blocks, and by span of time what came after the event-time
bound. Actions are judged, and their state removed, once the bound has passed the end of their time bucket, so the
state holds open buckets only, whatever the history. One timer a group, for the first bucket or block to end.
Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from seclog.config import SECOND_US, BlockLimits

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKET_MS = 1000
#: Groups of addresses, and the time whose actions are kept together if buckets are shorter.
GROUPS, SPAN_MS = 512, 3_600_000
CHANGES = StructType().add("ip", "string").add("action", "string").add("us", "long").add("end_us", "long").add("reason", "string").add("node_id", "string")
_SPAN = StructType([StructField("span", LongType())])
_WAKE = StructType([StructField("at_ms", LongType())])
#: The actions of a span, column by column.
_ACTIONS = StructType(
    [
        StructField(name, ArrayType(kind))
        for name, kind in (
            ("us", LongType()), ("request_id", LongType()), ("lift", BooleanType()), ("end_us", LongType()),
            ("reason", StringType()), ("node_id", StringType()), ("ip", StringType()),
        )
    ]
)
_BLOCKS = StructType([StructField(name, ArrayType(kind)) for name, kind in (("ip", StringType()), ("end_us", LongType()), ("reason", StringType()), ("node_id", StringType()))])


class BlockKeeper(StatefulProcessor):
    """Judges the actions of a group of addresses, of each address in event order.

    A request during a running block is ignored, or, with ``renew``, replaces it (the last
    message decides). A lift ends a running block.
    """

    def __init__(self, bucket_ms: int, renew: bool) -> None:
        self.bucket_ms, self.renew = bucket_ms, renew
        self.span_us = 1000 * max(bucket_ms, SPAN_MS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", _SPAN, _ACTIONS)
        self.blocks = handle.getValueState("blocks", _BLOCKS)
        self.wake = handle.getValueState("wake", _WAKE)

    def _over(self, us: int) -> int:
        """When the bucket that holds an instant is over."""
        return (us // (1000 * self.bucket_ms) + 1) * self.bucket_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if not len(pdf):
                continue
            for span, part in pdf.groupby(pdf["us"] // self.span_us):
                at = (int(span),)
                columns = [part[c].astype(object).where(part[c].notna(), None).tolist() for c in _ACTIONS.names]
                if self.pending.containsKey(at):
                    columns = [[*old, *new] for old, new in zip(self.pending.getValue(at), columns, strict=True)]
                self.pending.updateValue(at, tuple(columns))
            first = int(pdf["us"].min()) if first is None else min(first, int(pdf["us"].min()))
        if first is not None:
            wake = self.wake.get() if self.wake.exists() else None
            if wake is None or self._over(first) < wake[0]:
                if wake is not None:
                    self.handle.deleteTimer(wake[0])
                self.handle.registerTimer(self._over(first))
                self.wake.update((self._over(first),))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # actions before this one are complete
        limit = timerValues.getCurrentWatermarkInMs() // self.bucket_ms * self.bucket_ms * 1000
        actions, first = [], None
        for span in sorted(s for (s,) in self.pending.keys()):
            kept = list(zip(*self.pending.getValue((span,)), strict=True))
            open_ = [a for a in kept if a[0] >= limit]
            if len(open_) < len(kept):
                actions += [a for a in kept if a[0] < limit]
                if open_:
                    self.pending.updateValue((span,), tuple(list(c) for c in zip(*open_, strict=True)))
                else:
                    self.pending.removeKey((span,))
            if open_:
                first = min(a[0] for a in open_)
                break  # later spans are open too
        running = {ip: tuple(block) for ip, *block in zip(*self.blocks.get(), strict=True)} if self.blocks.exists() else {}
        changes = []

        def ends(ip: str, us: int) -> None:
            changes.append((ip, "unblock", us, None, None, None))
            del running[ip]

        for us, _, lift, end, reason, node, ip in sorted(actions, key=lambda a: a[:2]):
            if ip in running and running[ip][0] <= us:
                ends(ip, running[ip][0])
            if lift:
                if ip in running:
                    ends(ip, us)
            elif ip not in running or self.renew:
                running[ip] = (end, reason, node)
                changes.append((ip, "block", us, *running[ip]))
        for ip, (end, *_) in list(running.items()):
            if end < limit:
                ends(ip, end)
        if running:
            self.blocks.update(tuple(list(c) for c in zip(*[(ip, *block) for ip, block in running.items()], strict=True)))
            ended = min(end for end, *_ in running.values())
            first = ended if first is None else min(first, ended)
        else:
            self.blocks.clear()
        if first is None:
            self.wake.clear()
        else:
            self.handle.registerTimer(self._over(first))
            self.wake.update((self._over(first),))
        if changes:
            yield pd.DataFrame(changes, columns=CHANGES.names)

    def close(self) -> None:
        pass


def _kept(actions: DataFrame, bucket_ms: int, renew: bool) -> DataFrame:
    return actions.withColumn("__group", F.pmod(F.xxhash64("ip"), F.lit(GROUPS))).groupBy("__group").transformWithStateInPandas(
        statefulProcessor=BlockKeeper(bucket_ms, renew),
        outputStructType=CHANGES,
        outputMode="Append",
        timeMode="EventTime",
    )


def block_changes(
    requests: DataFrame, limits: BlockLimits = BlockLimits(), unblocks: DataFrame | None = None, bucket_ms: int = BUCKET_MS
) -> DataFrame:
    """Stream of block / unblock changes (ip, action, us, end_us, reason) from requests (ip, ts, us, request_id, reason).

    ``requests`` and ``unblocks`` (ip, ts, us, request_id) need an event-time bound on ``ts``. The blocks are those of
    ``operators.blocks.block_intervals``: ``end_us`` is when a block is to end, the unblock when it did.
    """
    length = limits.duration_sec * SECOND_US
    node = F.lit(None).cast("string").alias("node_id")
    actions = requests.select("ip", "ts", "us", "request_id", F.lit(False).alias("lift"), (F.col("us") + length).alias("end_us"), "reason", node)
    if unblocks is not None:
        # numbers are never null: pandas would make them floats
        lifts = unblocks.select("ip", "ts", "us", "request_id", F.lit(True).alias("lift"), F.col("us").alias("end_us"), F.lit(None).cast("string").alias("reason"), node)
        actions = actions.unionByName(lifts)
    return _kept(actions.filter(F.col("ip").isNotNull()), bucket_ms, renew=False).drop("node_id")


def cluster_changes(
    messages: DataFrame, limits: BlockLimits = BlockLimits(), own_node: str | None = None, bucket_ms: int = BUCKET_MS
) -> DataFrame:
    """The same from the nodes' messages (ip, ts, us, message_id, action, reason, ttl, node_id), of which the last decides.

    An address is on the list of ``operators.blocks.cluster_blocklist`` as long as its last change is a block.
    """
    if own_node is not None:
        messages = messages.filter(F.col("node_id") != own_node)
    expires = F.col("us") + F.coalesce("ttl", F.lit(limits.default_ttl_sec)) * SECOND_US
    actions = messages.select(
        "ip", "ts", "us", F.col("message_id").alias("request_id"), (F.col("action") != "block").alias("lift"),
        expires.cast("long").alias("end_us"), F.coalesce("reason", F.lit("remote_block")).alias("reason"), "node_id",
    )
    return _kept(actions.filter(F.col("ip").isNotNull()), bucket_ms, renew=True)
