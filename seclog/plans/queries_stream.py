"""Streaming queries, run over the given tables until all input is taken."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seclog.config import BlockLimits
from seclog.operators import enrich as en
from seclog.operators import outbox as ob
from seclog.operators import rollup
from seclog.plans import fixtures as fx
from seclog.plans.catalog import query
from seclog.plans.fixture_sql import DAY
from seclog.plans.fixtures import CHUNK_US, LIMITS, RULES, YEAR
from seclog.plans.queries_parse import CHANNELS, SSH_LINES
from seclog.sources.sinks import read_appended
from seclog.sources import follow
from seclog.sources import parsers as pa
from seclog.sources import text
from seclog.sources.staging import new_folder, remove, staged
from seclog.plans.queries_detect import ANOMALIES_SQL
from seclog.plans.queries_history import CLUSTER_LIMITS, CLUSTER_SQL, OVERRIDES_SQL, override_actions
from seclog.streaming import detect as sd
from seclog.streaming import replays, sinks
from seclog.streaming.blocklist import ROCKSDB, block_changes, cluster_changes
from seclog.streaming import windows as sw

_LAST = "(SELECT max(us) FROM raw)"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    fx.read_table(spark, sf_dir, "events")  # sets the session time zone
    return sw.stream_table(spark, sf_dir, "events.parquet", schema)


def sec_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.as_sec_events(fx.as_raw_events(event_stream(spark, sf_dir)))


#: Days in a slice of the events that arrives on its own, and days by which every fifth event comes late.
_SLICE, _LATE = 10, 2
#: Files of a slice, whatever its size, and of a micro-batch: state is carried from slice to slice, not from file to file.
_FILES = 4


def arriving_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in the order of three slices, every fifth one late: a micro-batch each."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = new_folder(spark, "arriving")
    day = (fx.AS_OF_US - F.unix_micros(F.col("ts").cast("timestamp"))) / DAY - F.when(F.col("event_id") % 5 == 0, _LATE).otherwise(0)
    fx.read_table(spark, sf_dir, "events")  # sets the session time zone
    for ahead in (F.lit(2), F.lit(1), F.lit(0)):
        raw.filter(F.least(F.greatest(F.floor(day / _SLICE), F.lit(0)), F.lit(2)) == ahead).repartition(_FILES).write.mode("append").parquet(path)
    stream = sw.stream_table(spark, path, "*.parquet", raw.schema, max_files=_FILES)
    return fx.as_sec_events(fx.as_raw_events(stream))


def judged(stream: DataFrame, handler, path: str) -> DataFrame:
    """Run a detector over a stream until all is taken and judged."""
    sinks.for_each_batch(stream, [handler], f"{path}/checkpoint").awaitTermination()
    handler.finish(stream.sparkSession.createDataFrame([], stream.schema), handler.next_batch)
    return read_appended(stream.sparkSession, f"{path}/out")


def taken(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over the input that is there and read back what it wrote."""
    spark = stream.sparkSession
    path = new_folder(spark, label)
    sinks.to_table(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


_SSH_LINES = f"SELECT src_ip, kind, \"user\", us - us % 1000000 AS us, count(*) AS n FROM ({SSH_LINES}) GROUP BY ALL"


def _line_folder(spark: SparkSession, sf_dir: str) -> str:
    """All log lines, of every source, as text files."""
    path = new_folder(spark, "logs")
    fx.log_lines(spark, sf_dir).select("line").write.text(path)
    return path


def _counted(events: DataFrame) -> DataFrame:
    # Text lines have no id of their own: compare how often each event occurs.
    return events.groupBy("src_ip", "kind", "user", F.unix_micros("ts").alias("us")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("read_log_lines", _SSH_LINES)
def read_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text.read_log_lines(spark, _line_folder(spark, sf_dir))
    return _counted(pa.parse_lines(lines, "auth", YEAR))


@query("stream_ingest", _SSH_LINES)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text.stream_log_lines(spark, _line_folder(spark, sf_dir))
    events = pa.parse_lines(lines, "auth", YEAR).select("src_ip", "kind", "user", "ts")
    return _counted(taken(events, "ingest"))


def _grown(spark: SparkSession, sf_dir: str, path: str, until: int) -> None:
    """The log lines before a day of the events, as one file a source and shard; each time under new names.

    Lines are in order, so each file starts with what the one before it held, like a log that grew and was renamed.
    """
    lines = fx.log_lines(spark, sf_dir).filter(F.col("us") < fx.AS_OF_US - until * DAY)
    dealt = lines.withColumn("shard", F.pmod(F.xxhash64("src_ip"), F.lit(4))).repartition("source", "shard")
    ordered = dealt.sortWithinPartitions("source", "shard", "us", "event_id")
    ordered.select("source", "shard", "line").write.mode("overwrite").partitionBy("source", "shard").text(path)


def _counted_lines(lines: DataFrame) -> DataFrame:
    return _counted(pa.parse_lines(follow.lines_of(lines), "auth", YEAR))


@query("follow_batch", _SSH_LINES)
def follow_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files read in ranges of 64 kB."""
    path = new_folder(spark, "grown")
    _grown(spark, sf_dir, path, 0)
    return _counted_lines(follow.read_grown_lines(spark, path, "*.txt", chunk=1 << 16))


def _follow(spark: SparkSession, sf_dir: str, steps: list[int | None], once: bool) -> DataFrame:
    """Follow log files over several states of the folder, one run of the stream each; None empties the folder."""
    path, work = new_folder(spark, "grown"), new_folder(spark, "followed")
    schema = None
    for until in steps:
        if until is None:
            remove(spark, path)
        else:
            _grown(spark, sf_dir, path, until)
        lines = follow.follow_lines(spark, path, "*.txt", chunk=1 << 16)
        schema = lines.schema
        sinks.to_table(replays.drop_replayed(lines, 1 << 16) if once else lines, f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return _counted_lines(spark.read.schema(schema).parquet(f"{work}/out"))


@query("stream_follow", _SSH_LINES)
def stream_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that grow and are renamed between three runs: each line comes once."""
    return _follow(spark, sf_dir, [20, 10, 0], once=False)


@query("stream_replays", _SSH_LINES)
def stream_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that go, come back whole, go, and come back in part: each line counts once, equal lines each."""
    return _follow(spark, sf_dir, [20, None, 0, None, 10], once=True)


@query(
    "stream_watermark",
    f"""SELECT us // {DAY} * {DAY} AS start_us, kind, count(*) AS n FROM sec
        WHERE us // {DAY} * {DAY} + {DAY} <= ({_LAST} - {3 * DAY}) // 1000 * 1000 GROUP BY ALL""",
)
def stream_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a bound of three days, the windows of the last three days stay open."""
    events = sw.with_event_time_bound(sec_stream(spark, sf_dir), "3 days")
    closed = taken(sw.window_counts(events, "1 day"), "bound")
    return closed.groupBy("start_us", "kind").agg(F.sum("n").alias("n"))


@query(
    "stream_sinks",
    """SELECT src_ip, us, severity, channel FROM rinc, (SELECT unnest(['chat', 'hook']) AS channel) WHERE severity IN ('MEDIUM', 'HIGH')""",
)
def stream_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents of a stream routed to the outbox table, one idempotent write per batch."""
    path = new_folder(spark, "outbox")
    found = fx.as_report_incidents(sec_stream(spark, sf_dir))
    outbox = ob.route_channels(found, CHANNELS)
    handlers = [sinks.table_handler(f"{path}/out")]
    sinks.for_each_batch(outbox, handlers, f"{path}/checkpoint").awaitTermination()
    return read_appended(spark, f"{path}/out").select("src_ip", "us", "severity", "channel")


@query(
    "stream_window_counts",
    f"""SELECT us // {DAY} * {DAY} AS start_us, us // {DAY} * {DAY} + {DAY} AS end_us, src_ip, kind, count(*) AS n
        FROM sec WHERE us // {DAY} * {DAY} + {DAY} <= {_LAST} GROUP BY ALL""",
)
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = sw.with_event_time_bound(sec_stream(spark, sf_dir), "0 seconds")
    return taken(sw.window_counts(events, "1 day"), "windows")


@query(
    "stream_sessions",
    f"""SELECT ip, session_us, max(us) AS end_us, count(*) FILTER (type = 'honeypot_command') AS commands,
          count(*) FILTER (type = 'honeypot_credentials') AS auth_attempts, count(*) AS records
        FROM decoy_session GROUP BY ip, session_us HAVING max(us) + {DAY} <= {_LAST}""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.as_raw_events(event_stream(spark, sf_dir)).withWatermark("ts", "0 seconds")
    return taken(sw.decoy_sessions(fx.as_decoy_log(raw), "1 day"), "sessions")


@query("stream_dedup", "SELECT event_id, us FROM raw")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = event_stream(spark, sf_dir).withWatermark("ts", "1 hour")
    twice = once.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    rows = sw.deduplicated(twice).select("event_id", F.unix_micros("ts").alias("us"))
    return taken(rows, "dedup")


@query(
    "stream_enrich",
    "SELECT r.event_id, r.src_ip, g.country, g.flag FROM raw r LEFT JOIN ip_geo g ON r.src_ip = g.src_ip",
)
def stream_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = en.geo_lookup(
        fx.raw_events(spark, sf_dir), fx.geo_ranges(spark, sf_dir), prefixes=fx.GEO_PREFIXES
    ).select("src_ip", "country", "flag")
    rows = fx.as_raw_events(event_stream(spark, sf_dir)).select("event_id", "src_ip")
    return taken(sw.enriched(rows, lookup), "enriched")


@query(
    "stream_detect",
    "SELECT event_id, src_ip, us, severity, fail_count, uniq_users, trigger, reasons FROM inc",
)
def stream_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "detect")
    handler = sd.IncidentDetector(f"{path}/state", f"{path}/out", LIMITS, delay_us=(_SLICE + _LATE) * DAY)
    return judged(arriving_stream(spark, sf_dir), handler, path).select(
        "event_id", "src_ip", "us", "severity", "fail_count", "uniq_users", "trigger",
        F.array_join("reasons", "; ").alias("reasons"),
    )


@query("stream_correlate", "SELECT src_ip, us, rule, confidence, severity, description FROM corr_kept")
def stream_correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "correlate")
    handler = sd.CorrelationDetector(f"{path}/state", f"{path}/out", RULES, delay_us=(_SLICE + _LATE) * DAY, chunk_us=CHUNK_US)
    return judged(arriving_stream(spark, sf_dir), handler, path).select(
        "src_ip", "us", "rule", "confidence", "severity", "description"
    )


def _rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly states that a stream of out-of-order batches wrote, one an hour."""
    path = new_folder(spark, "hours")
    sinks.for_each_batch(arriving_stream(spark, sf_dir), [sinks.hourly_handler(f"{path}/out")], f"{path}/checkpoint").awaitTermination()
    return staged(rollup.compacted(read_appended(spark, f"{path}/out")), "hours")


_ROLLED = (fx.AS_OF_US - 20 * DAY, fx.AS_OF_US - 1)


@query(
    "rolled_top_failing_ips",
    f"""SELECT src_ip, count(*) AS fails, 0::BIGINT AS error FROM sec WHERE kind = 'SSH_FAIL' AND us >= {_ROLLED[0]} AND us <= {_ROLLED[1]}
        GROUP BY src_ip ORDER BY fails DESC, src_ip LIMIT 10""",
)
def rolled_top_failing_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.top_failing(_rolled(spark, sf_dir), *_ROLLED)


@query(
    "rolled_counters",
    """SELECT us // 3600000000 * 3600000000 AS us, count(*) AS events, count(*) FILTER (kind = 'SSH_FAIL') AS ssh_fails FROM sec GROUP BY 1""",
)
def rolled_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.counters(_rolled(spark, sf_dir))


def _login_detector(spark: SparkSession, sf_dir: str) -> tuple[sd.LoginDetector, DataFrame, DataFrame]:
    path = new_folder(spark, "logins")
    handler = sd.LoginDetector(f"{path}/state", f"{path}/out", fx.BASELINE, delay_us=(_SLICE + _LATE) * DAY)
    stream = arriving_stream(spark, sf_dir)
    return handler, judged(stream, handler, path), spark.createDataFrame([], stream.schema)


@query("stream_login_anomalies", ANOMALIES_SQL)
def stream_login_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each login judged by the profile of its address so far, over out-of-order micro-batches."""
    return _login_detector(spark, sf_dir)[1].select("event_id", "src_ip", "anomaly")


@query(
    "stream_login_profile",
    """SELECT src_ip, count(*) AS total_logins, count(DISTINCT "user") AS known_users, min(us) AS first_seen_us, max(us) AS last_seen_us,
         (SELECT string_agg(hour || ':' || n, ',' ORDER BY hour) FROM (SELECT hour, count(*) AS n FROM logins h WHERE h.src_ip = l.src_ip GROUP BY hour)) AS hours
       FROM logins l GROUP BY src_ip""",
)
def stream_login_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    handler, _, like = _login_detector(spark, sf_dir)
    hour = lambda e: F.concat(e["key"], F.lit(":"), e["value"])
    return handler.profiles(like).withColumn("hours", F.array_join(F.transform(F.map_entries("login_hours"), hour), ",")).drop("login_hours")


@query("stream_ml_alerts")
def stream_ml_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalous windows by a forest that is trained anew as the stream goes on."""
    path = new_folder(spark, "forest")
    limits = replace(fx.FOREST, retrain_sec=5 * 86_400, buffer_sec=16 * 86_400)
    handler = sd.ForestDetector(f"{path}/state", f"{path}/out", limits, delay_us=(_SLICE + _LATE) * DAY, chunk_us=CHUNK_US)
    return judged(arriving_stream(spark, sf_dir), handler, path).select("src_ip", "us", F.round("score", 6).alias("score"), "version")


def _port_requests(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("kind") == "FW_HONEYPOT_PORT").select(
        F.col("src_ip").alias("ip"), "ts", "us", F.col("event_id").alias("request_id"), F.lit("port").alias("reason")
    )


@query(
    "stream_block_intervals",
    f"SELECT ip, us, us + {5 * DAY} AS end_us, 'port' AS reason FROM port_at",
)
def stream_block_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "blocks")
    handler = sd.BlockDetector(f"{path}/state", f"{path}/out", BlockLimits(duration_sec=5 * 86_400), delay_us=(_SLICE + _LATE) * DAY)
    return judged(_port_requests(arriving_stream(spark, sf_dir)).drop("ts"), handler, path)


@query(
    "stream_blocklist",
    f"""SELECT ip, 'block' AS action, us, 'port' AS reason FROM port_at WHERE us // 1000 < (SELECT max(us) FROM port_req) // 1000
        UNION ALL SELECT ip, 'unblock', us + {5 * DAY}, NULL FROM port_at WHERE (us + {5 * DAY}) // 1000 < (SELECT max(us) FROM port_req) // 1000""",
)
def stream_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sec_stream(spark, sf_dir).withWatermark("ts", "0 seconds")
    changes = block_changes(_port_requests(rows), BlockLimits(duration_sec=5 * 86_400), bucket_ms=1)
    return kept_blocks(changes, "blocklist").select("ip", "action", "us", "reason")


def kept_blocks(changes: DataFrame, label: str) -> DataFrame:
    """Run a stream of block changes, whose state needs its own kind of store; a part of it costs each batch a start."""
    conf = changes.sparkSession.conf
    parts, provider = "spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(parts)
    conf.set(parts, min(int(before), 2 * changes.sparkSession.sparkContext.defaultParallelism))
    conf.set(provider, ROCKSDB)
    try:
        return taken(changes, label)
    finally:
        conf.set(parts, before)
        conf.unset(provider)


def _arriving(rows: DataFrame, label: str) -> DataFrame:
    """Rows (us, ...) as a stream of five slices of time in order, every seventh row one slice late.

    A last row lies beyond all, so that the event-time bound passes them.
    """
    spark = rows.sparkSession
    path = new_folder(spark, label)
    timed = rows.withColumn("ts", F.timestamp_micros("us"))
    slice_ = F.least(F.greatest(5 - F.ceil((fx.AS_OF_US - F.col("us")) / (8 * DAY)), F.lit(0)) + F.when(F.xxhash64("ip", "us") % 7 == 0, 1).otherwise(0), F.lit(4))
    dealt = staged(timed.withColumn("slice", slice_), label)
    for k in range(5):
        dealt.filter(F.col("slice") == k).drop("slice").repartition(_FILES).write.mode("append").parquet(path)
    beyond = dealt.drop("slice").limit(1).withColumn("ip", F.lit("-")).withColumn("us", F.lit(fx.AS_OF_US + 90 * DAY))
    beyond.withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(path)
    stream = sw.stream_table(spark, path, "*.parquet", dealt.drop("slice").schema, max_files=_FILES)
    return stream.withWatermark("ts", "17 days")


@query("stream_overrides", OVERRIDES_SQL)
def stream_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block requests and manual unblocks as a stream: the intervals of the batch."""
    requests, lifts = override_actions(spark, sf_dir)
    both = requests.select("ip", "us", "request_id", "reason").withColumn("lift", F.lit(False)).unionByName(lifts.withColumn("lift", F.lit(True)), allowMissingColumns=True)
    stream = _arriving(both, "overrides")
    changes = block_changes(stream.filter("not lift"), fx.BLOCKS, stream.filter("lift"), bucket_ms=DAY // 1000)
    found = kept_blocks(changes, "overrides").filter("ip <> '-'")
    starts, stops = found.filter("action = 'block'"), found.filter("action = 'unblock'")
    ended = starts.alias("s").join(stops.alias("e"), (F.col("s.ip") == F.col("e.ip")) & (F.col("e.us") > F.col("s.us")) & (F.col("e.us") <= F.col("s.end_us")), "left")
    return ended.groupBy("s.ip", F.col("s.us").alias("start_us")).agg(F.min("e.us").alias("end_us"))


@query("stream_cluster_blocklist", CLUSTER_SQL)
def stream_cluster_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of all nodes as a stream; the list as it stands when the last is judged."""
    stream = _arriving(fx.block_messages(spark, sf_dir), "messages")
    found = kept_blocks(cluster_changes(stream, CLUSTER_LIMITS, own_node="n0", bucket_ms=DAY // 1000), "messages")
    last = found.filter(F.col("us") <= fx.AS_OF_US).groupBy("ip").agg(F.max_by(F.struct("action", "reason", "node_id", "us", "end_us"), F.struct("us", "end_us", "action")).alias("m"))
    return last.filter(f"m.action = 'block' and m.end_us > {fx.AS_OF_US}").select(
        "ip", "m.reason", "m.node_id", F.col("m.us").alias("blocked_us"), F.col("m.end_us").alias("expire_us")
    )
