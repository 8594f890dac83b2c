"""Scan, sweep and suppression against brute force, with hot keys and small chunks."""

import random
import re

import numpy as np
import pyarrow
import pytest
from pyspark.sql import functions as F

from seclog.operators.scan import Running, running
from seclog.operators.suppress import _compose, suppress_within
from seclog.operators.sweep import Count, Distinct, GapSum, window_counts


def rows(seed, n, keys, horizon):
    rng = random.Random(seed)
    return [
        # one key holds most of the rows, and instants repeat
        (i, rng.choice(keys + keys[:1] * 4), rng.randrange(horizon), rng.choice("ABC"), rng.choice("uvwxyz"))
        for i in range(n)
    ]


def frame(spark, data):
    return spark.createDataFrame(data, "event_id long, src_ip string, us long, kind string, user string")


def greedy(data, cooldown):
    kept, last = set(), {}
    for eid, key, us, *_ in sorted(data, key=lambda r: (r[2], r[0])):
        if key not in last or us - last[key] >= cooldown:
            kept.add(eid)
            last[key] = us
    return kept


@pytest.mark.parametrize("seed,cooldown,chunks", [(1, 7, 2), (2, 50, 3), (3, 1, 4), (4, 400, 1), (5, 13, 64)])
def test_suppression_is_greedy(spark, seed, cooldown, chunks):
    data = rows(seed, 3000, ["a", "b", "c"], 6000)
    out = suppress_within(frame(spark, data), ["src_ip"], cooldown, chunk_cooldowns=chunks)
    assert {r.event_id for r in out.collect()} == greedy(data, cooldown)


@pytest.mark.parametrize("seed,cooldown,chunks,fan", [(1, 7, 2, 2), (2, 50, 1, 3), (3, 1, 4, 16), (4, 400, 1, 2), (5, 9, 1, 5)])
def test_suppression_by_a_tree_of_maps(spark, seed, cooldown, chunks, fan):
    data = rows(seed, 3000, ["a", "b", "c"], 6000) + [(9000 + i, "d", -70 + i * (cooldown - 1), "A", "u") for i in range(200)]
    out = suppress_within(frame(spark, data), ["src_ip"], cooldown, chunk_cooldowns=chunks, fan=fan)
    assert {r.event_id for r in out.collect()} == greedy(data, cooldown)


def test_suppression_of_one_key_with_a_million_chunks(spark):
    every = F.col("id") * 37 + F.pmod(F.xxhash64("id"), F.lit(90))
    df = spark.range(600_000).select(F.col("id").alias("event_id"), F.lit("a").alias("src_ip"), every.alias("us"))
    out = suppress_within(df, ["src_ip"], 23, chunk_cooldowns=1, fan=64).select("us").collect()
    kept, last = [], None
    for r in df.select("us").distinct().orderBy("us").collect():
        if last is None or r.us - last >= 23:
            kept.append(last := r.us)
    assert sorted(r.us for r in out) == kept


@pytest.mark.parametrize("seed", range(20))
def test_maps_of_stretches_compose(seed):
    rng = np.random.default_rng(seed)
    cooldown, span = 10, 30

    def table(chunk):
        us = np.unique(rng.integers(chunk * span, (chunk + 1) * span, rng.integers(1, 8)))
        leave = []
        for i in range(len(us)):
            last = us[i]
            for u in us[i:]:
                last = u if u - last >= cooldown else last
            leave.append(last)
        return us, np.array(leave)

    def through(tables, before):
        for entry, leave in tables:
            j = np.searchsorted(entry, before + cooldown)
            before = leave[j] if j < len(entry) else before
        return before

    for _ in range(30):
        tables = [table(c) for c in sorted(rng.choice(6, 4, replace=False))]
        latest = tables[0][0][0] // span * span + cooldown
        whole = tables[0]
        for t in tables[1:]:
            whole = _compose(whole, t, cooldown, latest)
        for before in [-1000, *range(latest - 3 * cooldown, latest - cooldown)]:
            assert through([whole], before) == through(tables, before)


def test_suppression_regular_spacing_and_gap_edges(spark):
    # exactly the cooldown apart is kept; one less is not
    data = [(i, "a", t, "A", "u") for i, t in enumerate([0, 9, 10, 19, 20, 30, 41, 50, 1000, 1009, 1010])]
    out = suppress_within(frame(spark, data), ["src_ip"], 10, chunk_cooldowns=2)
    assert sorted(r.us for r in out.collect()) == [0, 10, 20, 30, 41, 1000, 1010]


def test_suppression_across_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        data = rows(9, 2000, ["a", "b", "c", "d"], 9000)
        out = suppress_within(frame(spark, data), ["src_ip"], 25, chunk_cooldowns=5)
        assert {r.event_id for r in out.collect()} == greedy(data, 25)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("chunk", [5, 64, 10_000])
def test_window_counts_match_brute_force(spark, chunk):
    data = rows(11, 1200, ["a", "b"], 2000)
    terms = [
        Count("a_incl", F.col("kind") == "A", 40),
        Count("a_strict", F.col("kind") == "A", 40, strict=True),
        Count("b_wide", F.col("kind") == "B", 300, strict=True),
        Distinct("users", F.col("kind") == "A", 40, value=F.col("user")),
        Distinct("users_strict", F.col("kind") == "C", 25, True, F.col("user")),
    ]
    got = {
        (r.src_ip, r.us): (r.a_incl, r.a_strict, r.b_wide, r.users, r.users_strict)
        for r in window_counts(frame(spark, data), terms, chunk_us=chunk).collect()
    }
    assert len(got) == len({(r[1], r[2]) for r in data})
    for key, us in got:
        mine = [r for r in data if r[1] == key and r[2] <= us]
        want = (
            sum(r[3] == "A" and r[2] >= us - 40 for r in mine),
            sum(r[3] == "A" and r[2] > us - 40 for r in mine),
            sum(r[3] == "B" and r[2] > us - 300 for r in mine),
            len({r[4] for r in mine if r[3] == "A" and r[2] >= us - 40}),
            len({r[4] for r in mine if r[3] == "C" and r[2] > us - 25}),
        )
        assert got[key, us] == want


@pytest.mark.parametrize(("partitions", "batch"), [(1, 10_000), (5, 7), (60, 10_000)])
def test_running_values_over_partitions_of_one_key(spark, partitions, batch):
    data = rows(13, 500, ["a", "b", "c"], 900)
    seen = F.when(F.col("kind") == "A", F.struct("us", "user"))
    wanted = {"n": Running(F.lit(1)), "a": Running(seen, "last"), "begun": Running(F.lit(None), "session", 12)}
    for name, value in (("spark.sql.shuffle.partitions", partitions), ("spark.sql.execution.arrow.maxRecordsPerBatch", batch), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(name, value)
    try:
        df = frame(spark, data)
        before = running(df, ["src_ip"], "us", {k: wanted[k] for k in ("n", "a")}, tie="event_id", include_current=False).collect()
        upto = running(df, ["src_ip"], "us", wanted, tie="event_id").collect()
        peers = running(df, ["src_ip"], "us", {k: wanted[k] for k in ("n", "a")}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled"):
            spark.conf.unset(name)
    order = {key: sorted((d[2], d[0], d[3], d[4]) for d in data if d[1] == key) for key in "abc"}
    for got, reaches in (
        (before, lambda r, at: at[:2] < (r.us, r.event_id)), (upto, lambda r, at: at[:2] <= (r.us, r.event_id)), (peers, lambda r, at: at[0] <= r.us),
    ):
        assert sorted(r.event_id for r in got) == list(range(500))
        for r in got:
            mine = [at for at in order[r.src_ip] if reaches(r, at)]
            last = [(at[0], at[3]) for at in mine if at[2] == "A"]
            assert r.n == len(mine)
            if got is not peers:
                assert (tuple(r["a"]) if r["a"] else None) == (last[-1] if last else None)
            else:
                assert r["a"] is None if not last else r["a"].us == last[-1][0]
            if got is upto:
                begun = mine[0][0]
                for x, y in zip(mine, mine[1:], strict=False):
                    begun = y[0] if y[0] - x[0] >= 12 else begun
                assert r.begun == begun


def test_running_over_no_rows(spark):
    assert running(frame(spark, []), ["src_ip"], "us", {"n": Running(F.lit(1))}).collect() == []


def test_copies_of_a_kept_row_come_out_once(spark):
    data = [(1, "a", 5, "A", "u")] * 200 + [(2, "a", 6, "A", "u")] * 50 + [(3, "a", 40, "A", "u"), (4, None, 5, "A", "u")]
    out = suppress_within(frame(spark, data), ["src_ip"], 10).collect()
    assert sorted((r.event_id, r.us) for r in out) == [(1, 5), (3, 40)]


def test_copies_count_in_windows(spark):
    data = [(i, "a", 5, "A", "u") for i in range(300)] + [(900, "a", 15, "A", "v")]
    counts = window_counts(
        frame(spark, data),
        [Count("n", F.col("kind") == "A", 10), Distinct("users", F.lit(True), 10, value=F.col("user"))],
        chunk_us=4,
    )
    assert sorted((r.us, r.n, r.users) for r in counts.collect()) == [(5, 300, 1), (15, 301, 2)]


def test_rows_of_many_windows_stay_narrow(spark):
    data = rows(17, 900, ["a", "b", "c"], 700)
    terms = [Count(f"n{i}", F.col("event_id") % 70 == i, 30 + i, i % 2 == 0) for i in range(70)]
    terms += [GapSum("gaps", F.col("kind") == "A", 25), Distinct("users", F.lit(True), 25, value=F.col("user"))]
    counts = window_counts(frame(spark, data), terms, chunk_us=128)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(" not in plan and "Window" not in plan  # no row carries a count per term through a shuffle
    got = {(r.src_ip, r.us): r for r in counts.collect()}
    assert got.keys() == {(r[1], r[2]) for r in data}
    for (key, us), row in got.items():
        mine = [r for r in data if r[1] == key and r[2] <= us]
        for i in (0, 1, 61, 62, 69):
            assert row[f"n{i}"] == sum(r[0] % 70 == i and r[2] >= us - 30 - i + (i % 2 == 0) for r in mine)
        times = sorted({r[2] for r in mine if r[3] == "A" and r[2] >= us - 25})
        assert row["gaps"] == (times[-1] - times[0] if times else 0)
        assert row["users"] == len({r[4] for r in mine if r[2] >= us - 25})


def test_long_groups_are_counted_in_slices(monkeypatch):
    from seclog.operators import sweep

    batch = pyarrow.RecordBatch.from_pydict({"k": ["a"] * 500 + ["b"] * 500, sweep.CHUNK: [0] * 1000, "us": [*range(500)] * 2, "__word0": [1, 2] * 500, "__n": [1] * 1000})
    terms = [sweep._Term("odd", 10, "__word0", 1), sweep._Term("even", 300, "__word0", 0)]
    for size in (7, 1 << 16):
        monkeypatch.setattr(sweep, "_SLICE", size)
        out = pyarrow.Table.from_batches(sweep._swept(iter([batch]), "k", 1000, 300, terms))
        assert out.column("k").to_pylist() == ["a"] * 500 + ["b"] * 500
        assert out.column("odd").to_pylist() == [sum(j % 2 for j in range(max(0, i - 9), i + 1)) for i in range(500)] * 2
        assert out.column("even").to_pylist() == [sum(j % 2 == 0 for j in range(max(0, i - 299), i + 1)) for i in range(500)] * 2


def test_suppression_has_more_tasks_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr("seclog.operators.suppress.TASK_ROWS", 100, raising=False)
    data = rows(7, 3000, ["a", "b", "c"], 6000)
    out = suppress_within(frame(spark, data), ["src_ip"], 13, chunk_cooldowns=2)
    assert {r.event_id for r in out.collect()} == greedy(data, 13)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(src_ip#\d+, us#\w+, event_id#\w+, 30\)", plan)
