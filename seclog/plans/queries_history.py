"""Enrichment, blocks, file integrity, assets and decoy sessions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import replace
from itertools import groupby

import pyarrow
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seclog.operators import assets as asx
from seclog.operators import blocks as bk
from seclog.operators import decoy as dc
from seclog.operators import enrich as en
from seclog.operators import fim as fi
from seclog.plans import fixtures as fx
from seclog.plans.catalog import query
from seclog.plans.fixture_sql import BASE, DAY
from seclog.plans.fixtures import AS_OF_US, BLOCKS, IDLE_SEC
from seclog.plans.queries_detect import final_incidents
from seclog.sources import sinks, snapshot, tables
from seclog.sources.staging import new_folder, staged

_TTL = 12 * 3600


# --- enrichment -------------------------------------------------------------------


_GEO_SQL = """SELECT r.event_id, r.src_ip, g.country, g.country_code, g.city, g.isp, g.flag
       FROM raw r LEFT JOIN ip_geo g ON r.src_ip = g.src_ip"""


@query("geo_enrich", _GEO_SQL)
def geo_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.raw_events(spark, sf_dir).select("event_id", "src_ip")
    return en.geo_enrich(events, fx.geo_ranges(spark, sf_dir), prefixes=fx.GEO_PREFIXES).select(
        "event_id", "src_ip", "country", "country_code", "city", "isp", "flag"
    )


@query("geo_enrich_by_range", _GEO_SQL)
def geo_enrich_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.raw_events(spark, sf_dir).select("event_id", "src_ip")
    found = en.geo_lookup_by_range(events, fx.geo_ranges(spark, sf_dir))
    return events.join(found, "src_ip", "left").select("event_id", "src_ip", "country", "country_code", "city", "isp", "flag")


@query(
    "reputation_enrich",
    """SELECT r.event_id, r.src_ip, p.abuse_score, p.total_reports, p.isp AS reputation_isp,
         coalesce(p.abuse_score >= 50 AND p.is_public, false) AS flagged FROM raw r LEFT JOIN rep p ON r.src_ip = p.ip""",
)
def reputation_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.raw_events(spark, sf_dir).select("event_id", "src_ip")
    return en.reputation_enrich(events, fx.loaded_reputation(spark, sf_dir))


@query(
    "fresh_lookup",
    f"SELECT ip, abuse_score, fetched_us FROM rep WHERE fetched_us <= {AS_OF_US} AND {AS_OF_US} - fetched_us < {_TTL}000000",
)
def fresh_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.reputation(spark, sf_dir)
    # every record twice, the earlier one stale and with another score
    older = rows.withColumn("abuse_score", F.lit(0)).withColumn("fetched_us", F.col("fetched_us") - 1)
    return en.fresh_records(rows.unionByName(older), AS_OF_US, _TTL).select(
        "ip", "abuse_score", "fetched_us"
    )


@query(
    "lookup_worklist",
    f"""SELECT DISTINCT src_ip AS ip FROM raw WHERE src_ip NOT IN
        (SELECT ip FROM rep WHERE {AS_OF_US} - fetched_us < {_TTL}000000)""",
)
def lookup_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = fx.raw_events(spark, sf_dir).select(F.col("src_ip").alias("ip"))
    return en.lookup_worklist(seen, fx.reputation(spark, sf_dir), AS_OF_US, _TTL)


@query("allowlist_filter", "SELECT event_id, src_ip FROM raw WHERE src_ip NOT IN (SELECT src_ip FROM allowed)")
def allowlist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.raw_events(spark, sf_dir).select("event_id", "src_ip")
    return en.outside_networks(events, fx.loaded_allowlist(spark, sf_dir), prefixes=fx.ALLOW_PREFIXES)


_V6 = "'2001:db8:0:' || format('{:x}', user_id % 65536) || '::7'"


_ALLOW_SQL_6 = f"""SELECT event_id, {_V6} AS src_ip FROM raw WHERE user_id % 65536 NOT IN (SELECT s_suppkey * 3 % 65536 FROM supplier)
        AND user_id % 65536 NOT BETWEEN 64 AND 79"""


def _ipv6_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The events' addresses in IPv6 form; a /64 per supplier and a /60."""
    group = lambda number: F.lower(F.hex(number % 65536))
    events = fx.raw_events(spark, sf_dir).select(
        "event_id", F.concat(F.lit("2001:db8:0:"), group(F.col("user_id")), F.lit("::7")).alias("src_ip")
    )
    suppliers = fx.read_table(spark, sf_dir, "supplier")
    single = suppliers.select(F.concat(F.lit("2001:DB8::"), group(F.col("s_suppkey") * 3), F.lit(":0:0:0:0/64")).alias("cidr"))
    wide = fx.read_table(spark, sf_dir, "region").filter("r_regionkey = 0").select(F.lit("2001:db8:0:4f::/60").alias("cidr"))
    return events, tables.with_network(single.unionByName(wide))


@query("allowlist_filter_ipv6", _ALLOW_SQL_6)
def allowlist_filter_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.outside_networks(*_ipv6_sides(spark, sf_dir))


@query("allowlist_filter_ipv6_by_range", _ALLOW_SQL_6)
def allowlist_filter_ipv6_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.outside_networks_by_range(*_ipv6_sides(spark, sf_dir))


# --- blocks -----------------------------------------------------------------------


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bk.block_intervals(bk.block_requests(final_incidents(spark, sf_dir)), BLOCKS)


@query("block_intervals", "SELECT ip, start_us, end_us, reason FROM blocks")
def block_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(spark, sf_dir)


@query("active_blocks", f"SELECT ip, start_us, end_us FROM blocks WHERE start_us <= {AS_OF_US} AND end_us > {AS_OF_US}")
def active_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bk.active_blocks(intervals(spark, sf_dir), AS_OF_US).select("ip", "start_us", "end_us")


def override_actions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Block requests of the incidents, and unblocks by hand."""
    lifts = (
        fx.raw_events(spark, sf_dir)
        .filter((F.col("event_type") == "view") & (F.col("k") % 10 == 3))
        .select(F.col("src_ip").alias("ip"), "us", F.col("event_id").alias("request_id"))
    )
    return staged(bk.block_requests(final_incidents(spark, sf_dir)), "requests"), lifts


OVERRIDES_SQL = f"""SELECT e.ip, e.us AS start_us, least(e.us + {15 * DAY},
          (SELECT min(l.us) FROM lifts l WHERE l.ip = e.ip AND l.us >= e.us)) AS end_us FROM epoch_at e"""
CLUSTER_LIMITS = replace(BLOCKS, default_ttl_sec=15 * 86_400)
CLUSTER_SQL = f"""SELECT ip, coalesce(reason, 'remote_block') AS reason, node_id, us AS blocked_us, us + coalesce(ttl, 1296000)::BIGINT * 1000000 AS expire_us
        FROM (SELECT * FROM msgs WHERE node_id <> 'n0' QUALIFY row_number() OVER (PARTITION BY ip ORDER BY us DESC, message_id DESC) = 1)
        WHERE action = 'block' AND us + coalesce(ttl, 1296000)::BIGINT * 1000000 > {AS_OF_US}"""


@query("manual_overrides", OVERRIDES_SQL)
def manual_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, lifts = override_actions(spark, sf_dir)
    return bk.block_intervals(requests, BLOCKS, lifts).select("ip", "start_us", "end_us")


@query("cluster_blocklist", CLUSTER_SQL)
def cluster_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bk.cluster_blocklist(fx.block_messages(spark, sf_dir), AS_OF_US, CLUSTER_LIMITS, own_node="n0")


@query(
    "active_nodes",
    f"SELECT node_id, max(us) AS last_us FROM msgs GROUP BY node_id HAVING max(us) + {DAY} > {AS_OF_US}",
)
def active_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bk.active_nodes(fx.block_messages(spark, sf_dir), AS_OF_US, BLOCKS)


# --- file integrity ---------------------------------------------------------------


@query(
    "fim_baseline_init",
    f"""SELECT path, hash, size, mode, first_seen_us FROM fim_old
        UNION ALL SELECT path, hash, size, mode, {AS_OF_US} FROM fim_new WHERE hash IS NOT NULL AND path NOT IN (SELECT path FROM fim_old)""",
)
def fim_baseline_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.baseline_init(
        fx.fim_baseline(spark, sf_dir), fx.fim_current(spark, sf_dir), AS_OF_US
    ).select("path", "hash", "size", "mode", "first_seen_us")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.diff(fx.fim_baseline(spark, sf_dir), fx.fim_current(spark, sf_dir), AS_OF_US)


@query("fim_diff", "SELECT path, change, severity, old_hash, new_hash, old_mode, new_mode FROM fim_alerts")
def fim_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).select(
        "path", "change", "severity", "old_hash", "new_hash", "old_mode", "new_mode"
    )


@query(
    "fim_baseline_merge",
    f"""SELECT path, CASE WHEN change IS NULL THEN old_hash ELSE new_hash END AS hash, CASE WHEN change IS NULL THEN old_mode ELSE new_mode END AS mode,
          CASE WHEN change IS NULL THEN old_size ELSE new_size END AS size, coalesce(first_seen_us, {AS_OF_US}) AS first_seen_us,
          CASE WHEN change IS NULL THEN last_seen_us ELSE {AS_OF_US} END AS last_seen_us
        FROM fim_changes WHERE coalesce(change, '') <> 'deleted' AND (had OR change IS NOT NULL)""",
)
def fim_baseline_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.baseline_merge(
        fx.fim_baseline(spark, sf_dir), fx.fim_current(spark, sf_dir), AS_OF_US
    ).select("path", "hash", "mode", "size", "first_seen_us", "last_seen_us")


@query(
    "fim_recent_alerts",
    "SELECT path, change, severity FROM fim_alerts ORDER BY path LIMIT 50",
)
def fim_recent_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.recent_alerts(changes(spark, sf_dir), 50).select("path", "change", "severity")


@query(
    "fim_counts",
    "SELECT count(*) AS fim_alert_count, count(*) FILTER (severity = 'CRITICAL') AS fim_critical FROM fim_alerts",
)
def fim_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.alert_counts(changes(spark, sf_dir), AS_OF_US - DAY)


# --- assets -----------------------------------------------------------------------


@query(
    "asset_inventory",
    """SELECT s.src_ip, min(us) AS first_seen_us, max(us) AS last_seen_us, count(*) AS event_count, count(*) FILTER (kind = 'SSH_FAIL') AS fail_count,
         coalesce(string_agg(DISTINCT CASE source WHEN 'auth' THEN 'ssh' WHEN 'nginx' THEN 'http' WHEN 'mysql' THEN 'mysql' END, ','
                    ORDER BY CASE source WHEN 'auth' THEN 'ssh' WHEN 'nginx' THEN 'http' WHEN 'mysql' THEN 'mysql' END), '') AS services,
         any_value(g.country) AS country, any_value(g.flag) AS flag
       FROM sec s JOIN ip_geo g ON s.src_ip = g.src_ip GROUP BY s.src_ip""",
)
def asset_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.sec_events(spark, sf_dir)
    geo = en.geo_lookup(events, fx.geo_ranges(spark, sf_dir), prefixes=fx.GEO_PREFIXES)
    return asx.asset_inventory(events, geo).withColumn("services", F.array_join("services", ","))


@query("asset_users", "SELECT DISTINCT src_ip, 'user:' || \"user\" AS note FROM sec")
def asset_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asx.asset_users(fx.sec_events(spark, sf_dir))


def trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asx.asset_trust(
        fx.sec_events(spark, sf_dir),
        fx.allowlist(spark, sf_dir),
        bk.active_blocks(intervals(spark, sf_dir), AS_OF_US),
        fx.ALLOW_PREFIXES,
    )


@query("asset_trust", "SELECT src_ip, trust FROM trust")
def asset_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust(spark, sf_dir)


@query("assets_by_trust", "SELECT src_ip, trust FROM trust WHERE trust = 'attacker'")
def assets_by_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asx.assets_by_trust(trust(spark, sf_dir), "attacker")


@query(
    "asset_summary",
    "SELECT coalesce(trust, 'total') AS trust, count(*) AS assets FROM trust GROUP BY ROLLUP (trust)",
)
def asset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asx.asset_summary(trust(spark, sf_dir))


_FACTS = """(SELECT event_id AS line_id, us, src_ip AS ip, CASE WHEN k % 9 = 0 THEN 'seen' WHEN k % 9 = 1 THEN 'mac' WHEN k % 9 = 5 THEN 'hostname' ELSE 'service' END AS attribute,
    CASE k % 9 WHEN 1 THEN 'aa:bb:cc:00:00:0' || (k % 10) WHEN 2 THEN 'http' || (k % 3) WHEN 5 THEN 'host' || (k % 4) || '.example.com' WHEN 6 THEN 'smb' END AS value
    FROM raw WHERE k % 9 IN (0, 1, 2, 5, 6))"""


@query(
    "asset_identity",
    f"""SELECT ip, arg_max(value, (us, line_id)) FILTER (attribute = 'mac') AS mac, count(DISTINCT value) FILTER (attribute = 'hostname') AS hostnames,
          count(DISTINCT value) FILTER (attribute = 'service') AS services, max(us) AS last_seen_us FROM {_FACTS} GROUP BY ip""",
)
def asset_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asx.asset_identity(asx.identity_facts(fx.packet_lines(spark, sf_dir)))


@query(
    "asset_attributes",
    f"""SELECT ip, attribute, value, min(us) AS first_us, max(us) AS last_us FROM {_FACTS} WHERE attribute IN ('hostname', 'service') GROUP BY ALL""",
)
def asset_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asx.asset_attributes(asx.identity_facts(fx.packet_lines(spark, sf_dir)))


@query(
    "asset_listing",
    f"""SELECT src_ip, strftime(make_timestamp(max(us)), '%Y-%m-%dT%H:%M:%SZ') AS last_seen_iso,
          CASE WHEN ({AS_OF_US} - max(us)) // 1000000 < 60 THEN (({AS_OF_US} - max(us)) // 1000000) || 's ago'
               WHEN ({AS_OF_US} - max(us)) // 1000000 < 3600 THEN (({AS_OF_US} - max(us)) // 60000000) || 'm ago'
               WHEN ({AS_OF_US} - max(us)) // 1000000 < 86400 THEN (({AS_OF_US} - max(us)) // 3600000000) || 'h ago'
               ELSE (({AS_OF_US} - max(us)) // {DAY}) || 'd ago' END AS last_seen_ago FROM raw GROUP BY src_ip""",
)
def asset_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    inventory = asx.asset_inventory(fx.sec_events(spark, sf_dir))
    return asx.newest_first(inventory, AS_OF_US).select("src_ip", "last_seen_iso", "last_seen_ago")


# --- decoy sessions ---------------------------------------------------------------


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.decoy_sessions(fx.decoy_log(spark, sf_dir), IDLE_SEC)


_SESSIONS = """SELECT ip, session_us, max(us) AS end_us, count(*) FILTER (type = 'honeypot_command') AS commands,
  count(*) FILTER (type = 'honeypot_credentials') AS auth_attempts, count(*) AS records, max(us) - session_us AS duration_us
  FROM decoy_session GROUP BY ip, session_us"""


@query("decoy_sessions", _SESSIONS)
def decoy_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir)


@query(
    "decoy_session_commands",
    """SELECT ip, session_us, row_number() OVER (PARTITION BY ip, session_us ORDER BY us, record_id) AS seq, us, command
       FROM decoy_session WHERE type = 'honeypot_command'""",
)
def decoy_session_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.session_commands(fx.decoy_log(spark, sf_dir), IDLE_SEC)


@query(
    "decoy_session_attempts",
    "SELECT ip, session_us, us, username, password FROM decoy_session WHERE type = 'honeypot_credentials'",
)
def decoy_session_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.session_attempts(fx.decoy_log(spark, sf_dir), IDLE_SEC)


@query("decoy_recent_sessions", f"{_SESSIONS} ORDER BY session_us DESC, ip LIMIT 20")
def decoy_recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.recent_sessions(sessions(spark, sf_dir))


@query(
    "decoy_top_credentials",
    """SELECT username, password, count(*) AS tries FROM decoy WHERE type = 'honeypot_credentials' GROUP BY ALL
       ORDER BY tries DESC, username, password LIMIT 20""",
)
def decoy_top_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.top_credentials(fx.decoy_log(spark, sf_dir))


@query(
    "decoy_top_commands",
    """SELECT lower(split_part(trim(command), ' ', 1)) AS word, count(*) AS uses FROM decoy WHERE type = 'honeypot_command' GROUP BY ALL
       ORDER BY uses DESC, word LIMIT 20""",
)
def decoy_top_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.top_commands(fx.decoy_log(spark, sf_dir))


# --- result and dimension tables --------------------------------------------------


@query(
    "write_incidents",
    "SELECT event_id, src_ip, us, severity, reason1 || '; ' || reason2 AS reasons, fail_count FROM rinc",
)
def write_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "incidents")
    sinks.write_incidents(fx.report_incidents(spark, sf_dir), path)
    return sinks.read_appended(spark, path).select(
        "event_id", "src_ip", "us", "severity", F.array_join("reasons", "; ").alias("reasons"), "fail_count"
    )


@query("write_blocks", "SELECT ip, max(start_us) AS start_us, max(end_us) AS end_us FROM blocks GROUP BY ip")
def write_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "blocks")
    sinks.write_blocks(intervals(spark, sf_dir), path)
    log = sinks.read_appended(spark, path)
    return sinks.current_blocks(log).select("ip", "start_us", "end_us")


@query("write_fim_alerts", "SELECT path, change, severity FROM fim_alerts")
def write_fim_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "fim")
    sinks.write_fim_alerts(changes(spark, sf_dir), path, batch=1)
    sinks.write_fim_alerts(changes(spark, sf_dir), path, batch=1)  # a retry leaves no copies
    return sinks.read_appended(spark, path).select("path", "change", "severity")


#: Files in a folder.
_FOLDER = 1000


def _as_files(rows: DataFrame, path: str) -> None:
    """Rows (doc_id, text) as files ``doc_id=<id>.txt`` of a line each, written by the tasks, some in a folder.

    Equal ids of a task share a file. One that runs again writes the same files.
    """

    def write(batches: Iterator[pyarrow.RecordBatch]) -> Iterator[pyarrow.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(re.sub("^file:/*", "/", path))
        part, made, folder = TaskContext.get().partitionId(), 0, ""
        lines = ((d, t) for b in batches for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for doc_id, same in groupby(lines, key=lambda line: line[0]):
            if made % _FOLDER == 0:
                folder = f"{root}/{part:05d}-{made // _FOLDER:05d}"
                store.create_dir(folder)
            with store.open_output_stream(f"{folder}/doc_id={'__HIVE_DEFAULT_PARTITION__' if doc_id is None else doc_id}.txt") as out:
                for _, text in same:
                    out.write(f"{text}\n".encode())
            made += 1
        yield pyarrow.RecordBatch.from_pydict({"n": pyarrow.array([made], pyarrow.int64())})

    rows.sortWithinPartitions("doc_id").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def _remove_folders(folders: DataFrame) -> None:
    """Deletes folders, named in the column ``folder``, with what they hold, dealt to all tasks."""

    def remove(batches: Iterator[pyarrow.RecordBatch]) -> Iterator[pyarrow.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(re.sub("^file:/*", "/", folder))
                with suppress(FileNotFoundError):  # a task that runs again
                    store.delete_dir(place)
            yield pyarrow.RecordBatch.from_pydict({"n": pyarrow.array([batch.num_rows], pyarrow.int64())})

    parts = int(folders.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as few rows are much work
    folders.distinct().repartition(parts).mapInArrow(remove, "n long").agg(F.sum("n")).collect()


@query(
    "scan_file_snapshot",
    "SELECT doc_id, sha256(coalesce(text, '') || chr(10)) AS hash, strlen(coalesce(text, '')) + 1 AS size FROM documents",
)
def scan_file_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of its own, found again by a scan of the folder and by one of a missing folder."""
    path = new_folder(spark, "files")
    docs = fx.read_table(spark, sf_dir, "documents")
    _as_files(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), path)
    found = snapshot.scan_snapshot(spark, [snapshot.Watch(path, pattern="*.txt"), snapshot.Watch(f"{path}/missing")])
    number = F.regexp_extract("path", r"doc_id=(\d+)", 1).cast(docs.schema["doc_id"].dataType)
    return found.select(number.alias("doc_id"), "hash", "size")


_TEXT = "coalesce(text, '')"


@query(
    "fim_rescan",
    f"""SELECT doc_id, CASE WHEN NOT before THEN 'created' WHEN NOT after THEN 'deleted' ELSE 'modified' END AS change,
          CASE WHEN before THEN sha256({_TEXT} || chr(10)) END AS old_hash,
          CASE WHEN after THEN sha256({_TEXT} || CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END || chr(10)) END AS new_hash
        FROM (SELECT *, doc_id % 10 <> 0 AS before, doc_id % 7 <> 0 AS after FROM documents)
        WHERE before <> after OR (before AND doc_id % 5 = 0)""",
)
def fim_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans of every document as a file, some new, gone or changed; files over 2,000 bytes are hashed in blocks."""
    docs = fx.read_table(spark, sf_dir, "documents")
    key = F.col("doc_id")

    def scan(rows: DataFrame, text: Column) -> DataFrame:
        path = new_folder(spark, "files")
        _as_files(rows.select("doc_id", text.alias("text")), path)
        found = snapshot.scan_snapshot(spark, [snapshot.Watch(path, pattern="*.txt")], large=2000)
        _remove_folders(found.select(F.regexp_extract("path", "(?s)^(.*)/", 1).alias("folder")))  # the scan is done: one set of files at a time
        return found.withColumn("path", F.regexp_extract("path", r"doc_id=\d+", 0))

    text = F.coalesce("text", F.lit(""))
    one = scan(docs.filter(key % 10 != 0), text)
    two = scan(docs.filter(key % 7 != 0), F.when(key % 5 == 0, F.concat(text, F.lit("!"))).otherwise(text))
    number = F.substring_index("path", "=", -1).cast(docs.schema["doc_id"].dataType)
    return fi.diff(one, two, fx.AS_OF_US).select(number.alias("doc_id"), "change", "old_hash", "new_hash")


@query(
    "load_dimensions",
    f"""SELECT 'geo' AS kind, n_name AS name, {BASE} + n_nationkey * 64 AS lo, 26 AS prefix_len FROM nation
        UNION ALL SELECT 'allow', s_name, {BASE} + s_suppkey % 65536, 32 FROM supplier""",
)
def load_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, supplier = fx.read_table(spark, sf_dir, "nation"), fx.read_table(spark, sf_dir, "supplier")
    key = F.col("n_nationkey") * 64 + 5  # host bits are cleared again
    geo = nation.select(
        F.concat(F.lit("198.18."), F.floor(key / 256), F.lit("."), key % 256, F.lit("/26")).alias("cidr"),
        F.col("n_name").alias("country"),
    )
    at = F.col("s_suppkey") % 65536
    allow = supplier.select(
        F.concat(F.lit("198.18."), F.floor(at / 256), F.lit("."), at % 256).alias("cidr"),
        F.col("s_name").alias("name"),
    )
    path = new_folder(spark, "dimensions")
    geo.write.csv(f"{path}/geo", header=True)
    allow.write.csv(f"{path}/allow", header=True)
    networks = tables.load_geo(spark, f"{path}/geo").select(
        F.lit("geo").alias("kind"), F.col("country").alias("name"), "lo", "prefix_len"
    )
    named = tables.with_network(spark.read.schema("cidr string, name string").csv(f"{path}/allow", header=True))
    return networks.unionByName(named.select(F.lit("allow").alias("kind"), "name", "lo", "prefix_len"))
