"""Hourly states against counting the events again."""

import random
from collections import Counter

from pyspark.sql import functions as F

from seclog.config import HOUR_US
from seclog.operators import rollup
from seclog.sources import sinks
from seclog.streaming.sinks import hourly_handler


def events(spark, rows):
    return spark.createDataFrame(rows, "us long, kind string, src_ip string")


def draw(seed, n, addresses):
    rng = random.Random(seed)
    return [(rng.randrange(72 * HOUR_US), rng.choice(["SSH_FAIL", "SSH_FAIL", "FW_BLOCK"]), f"10.0.{(a := int(rng.paretovariate(0.8)) % addresses) // 250}.{a % 250}" if rng.random() < 0.98 else None) for _ in range(n)]


def test_batches_in_any_grouping_give_the_counts_of_all_events(spark, tmp_path):
    rows = draw(1, 4000, 200)
    handle = hourly_handler(str(tmp_path / "t"))
    for k in range(4):
        handle(events(spark, rows[k::4]), k)
    handle(events(spark, rows[3::4]), 3)  # a retry replaces its own
    states = rollup.compacted(sinks.read_appended(spark, str(tmp_path / "t")))
    states.write.parquet(str(tmp_path / "hours"))
    states = spark.read.parquet(str(tmp_path / "hours"))
    span = (24 * HOUR_US, 48 * HOUR_US - 1)
    assert states.filter(F.col("us").between(*span)).count() == 24
    want = Counter(ip for us, kind, ip in rows if kind == "SSH_FAIL" and ip and span[0] <= us <= span[1])
    got = [tuple(r) for r in rollup.top_failing(states, *span, limit=12).collect()]
    assert got == [(ip, n, 0) for ip, n in sorted(want.items(), key=lambda x: (-x[1], x[0]))[:12]]
    per_hour = {r.us: (r.events, r.ssh_fails) for r in rollup.counters(states).collect()}
    for hour in range(72):
        mine = [kind for us, kind, _ in rows if us // HOUR_US == hour]
        assert per_hour[hour * HOUR_US] == (len(mine), mine.count("SSH_FAIL"))


def test_the_error_bound_holds_with_few_counters(spark):
    rows = draw(2, 30_000, 3000)
    states = rollup.hourly_states(events(spark, rows), tracked=128)
    want = Counter(ip for _, kind, ip in rows if kind == "SSH_FAIL" and ip)
    got = rollup.top_failing(states, limit=10, tracked=128).collect()
    assert got and all(r.error > 0 and abs(want[r.src_ip] - r.fails) <= r.error for r in got)
    last = min(r.fails for r in got)
    assert all(n <= last + 2 * got[0].error for ip, n in want.items() if ip not in {r.src_ip for r in got})


def test_no_events(spark):
    states = rollup.hourly_states(events(spark, []))
    assert rollup.top_failing(states).collect() == [] == rollup.counters(states).collect()
