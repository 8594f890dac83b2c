"""The streamed block list against a walk over all actions in order."""

import random

from pyspark.sql import functions as F

from seclog.config import BlockLimits
from seclog.streaming import blocklist
from seclog.streaming import windows as sw

SECOND = 1_000_000


def changes(actions, renew):
    """actions: (ip, us, id, lift, end, reason, node) in any order."""
    out, running = [], {}
    for ip, us, _, lift, end, reason, node in sorted(actions, key=lambda a: (a[1], a[2])):
        now = running.get(ip)
        if now and now <= us:
            out.append((ip, "unblock", now, None, None, None))
            now = None
        if lift:
            if now:
                out.append((ip, "unblock", us, None, None, None))
            now = None
        elif now is None or renew:
            now = end
            out.append((ip, "block", us, end, reason, node))
        running[ip] = now
    return out + [(ip, "unblock", end, None, None, None) for ip, end in running.items() if end]


def run(spark, tmp_path, rows, ddl, build):
    """Rows in three files, one a micro-batch, each out of order; the last row is far beyond."""
    from seclog.plans.queries_stream import kept_blocks

    for k, part in enumerate([rows[0::3], rows[1::3], rows[2::3]]):
        spark.createDataFrame(part, ddl).withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 2:
            end = spark.createDataFrame([("-", 90_000 * SECOND, 10**9, *next(r for r in rows if r[-1] != "n0")[3:])], ddl)
            end.withColumn("ts", F.timestamp_micros("us")).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = sw.stream_table(spark, str(tmp_path / "in"), "*.parquet", schema, max_files=1).withWatermark("ts", "2000 seconds")
    return [tuple(r) for r in kept_blocks(build(stream), "test").filter("ip <> '-'").collect()]


def test_requests_and_unblocks(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("aaab"), rng.randrange(2000) * SECOND // 2, i, rng.random() < 0.2, f"r{i}") for i in range(300)]
    limits = BlockLimits(duration_sec=40)
    got = run(spark, tmp_path, rows, "ip string, us long, request_id long, lift boolean, reason string", lambda s: blocklist.block_changes(s.filter("not lift"), limits, s.filter("lift"), bucket_ms=7000))
    want = changes([(ip, us, i, lift, us + 40 * SECOND, reason, None) for ip, us, i, lift, reason in rows], renew=False)
    assert sorted(got, key=str) == sorted((w[:5] for w in want), key=str)


def test_messages_of_nodes(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("aaab"), rng.randrange(2000) * SECOND // 2, i, rng.choice(["block", "block", "unblock"]), rng.choice([None, "r"]), rng.choice([5, 60, 300]), rng.choice(["n0", "n1"])) for i in range(300)]
    ddl = "ip string, us long, message_id long, action string, reason string, ttl long, node_id string"
    got = run(spark, tmp_path, rows, ddl, lambda s: blocklist.cluster_changes(s, own_node="n0", bucket_ms=5000))
    kept = [(ip, us, i, action != "block", us + ttl * SECOND, reason or "remote_block", node) for ip, us, i, action, reason, ttl, node in rows if node != "n0"]
    assert sorted(got, key=str) == sorted(changes(kept, renew=True), key=str)


def test_addresses_share_states_and_slices_are_batches(spark, tmp_path):
    from seclog.plans import queries_stream as qs

    rows = [(f"a{i % 900}", qs.fx.AS_OF_US - (40 - i % 40) * qs.DAY + i, i, "block" if i % 5 else "unblock", "r", 10**9, "n1") for i in range(3600)]
    ddl = "ip string, us long, message_id long, action string, reason string, ttl long, node_id string"
    stream = qs._arriving(spark.createDataFrame(rows, ddl).repartition(24), "messages")
    changed = blocklist.cluster_changes(stream, bucket_ms=86_400_000)
    path = qs.new_folder(spark, "messages")
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, blocklist.ROCKSDB)
    try:
        query = qs.sinks.to_table(changed, f"{path}/out", f"{path}/checkpoint")
        query.awaitTermination()
    finally:
        spark.conf.unset(name)
    progress = query.recentProgress
    assert sum(p["numInputRows"] > 0 for p in progress) <= 6  # five slices and the last row
    assert max(p["stateOperators"][0]["customMetrics"].get("numRegisteredTimers", 0) for p in progress) <= blocklist.GROUPS
    found = [tuple(r) for r in spark.read.schema(changed.schema).parquet(f"{path}/out").filter("ip <> '-'").collect()]
    kept = [(ip, us, i, action != "block", us + ttl * SECOND, reason, node) for ip, us, i, action, reason, ttl, node in rows]
    want = [w for w in changes(kept, renew=True) if w[2] < qs.fx.AS_OF_US + 60 * qs.DAY]
    assert sorted(found, key=str) == sorted(want, key=str)
