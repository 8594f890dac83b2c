"""How often the windowed operators read and shuffle their input."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seclog.plans import report
from seclog.schema import within
from seclog.sources import sinks

SF_DIR = "/root/testdata/sf0.001"

#: query: most exchanges, most scans of the initial plan
BOUNDS = {
    "brute_force": (3, 2),
    "credential_stuffing": (3, 2),
    "incident_candidates": (3, 3),
    "correlate": (2, 1),
    "sliding_count_sweep": (2, 1),
    "sliding_distinct_sweep": (2, 1),
    "ip_window_features": (2, 1),
    "login_anomalies": (9, 3),
    "decoy_sessions": (1, 1),
    "privilege_attribution": (0, 1),
    "manual_overrides": (8, 4),
}


@pytest.mark.parametrize("name", sorted(BOUNDS))
def test_input_is_read_and_shuffled_few_times(spark, name):
    frame = entry.queries()[name](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    exchanges, scans = BOUNDS[name]
    assert len(re.findall(r"Exchange ", plan)) <= exchanges
    assert len(re.findall(r"FileScan", plan)) <= scans


@pytest.mark.parametrize("name", ["corr_ip_summary", "timeline_24h"])
def test_time_bounds_reach_the_files(spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"PushedFilters: \[([^\]]*)", plan)[1]
    assert "GreaterThanOrEqual(ts," in pushed and "LessThanOrEqual(ts," in pushed


def test_time_bounds_reach_folders_by_day(spark, tmp_path):
    day = 86_400_000_000
    rows = spark.range(100).select((F.col("id") * (day // 4)).cast("long").alias("us"), F.lit("LOW").alias("severity"))
    sinks.write_incidents(rows, str(tmp_path / "t"), batch=1)
    table = spark.read.parquet(str(tmp_path / "t"))
    found = within(table, 3 * day, 5 * day)
    assert found.count() == 9
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*day#\d+ >= 1970-01-04", plan)
    assert sum(r.n for r in report.timeline(table, 5 * day, 2 * day, day).collect()) == 9


def test_top_failing_ips_approx_is_exact_where_the_sketch_is_not_sure(spark):
    rows = [("SSH_FAIL", f"10.0.{i // 250}.{i % 250}") for i in range(600) for _ in range(1 + (i == 577))]
    events = spark.createDataFrame([*rows, ("SSH_OK", "10.9.9.9"), ("SSH_FAIL", None)], "kind string, src_ip string")
    want = [tuple(r) for r in report.top_failing_ips(events, limit=5).collect()]
    assert [tuple(r) for r in report.top_failing_ips_approx(events, limit=5, tracked=100).collect()] == want and want[0] == ("10.0.2.77", 2)
    few = events.filter("src_ip < '10.0.0.12'")
    exact = {tuple(r) for r in report.top_failing_ips(few, limit=50).collect()}
    assert {tuple(r) for r in report.top_failing_ips_approx(few, limit=50, tracked=100).collect()} == exact
