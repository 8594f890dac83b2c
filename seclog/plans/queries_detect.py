"""Detection, suppression, correlation, baseline and anomaly-scoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seclog.config import SECOND_US
from seclog.functions.scalar import response_decision, response_plan
from seclog.operators import baseline as bl
from seclog.operators import correlate as co
from seclog.operators import detect as de
from seclog.operators import enrich as en
from seclog.operators import features as fe
from seclog.operators import iforest
from seclog.operators.suppress import suppress_within
from seclog.operators.sweep import Count, Distinct, window_counts
from seclog.plans import fixtures as fx
from seclog.plans.catalog import query
from seclog.plans.fixture_sql import DAY
from seclog.plans.fixtures import AS_OF_US, BASELINE, CHUNK_US, FOREST, LIMITS, RULES
from seclog.sources.staging import staged


@query(
    "route_kinds",
    "SELECT event_id, kind, src_ip FROM sec WHERE kind IN ('SSH_FAIL','SSH_SUCCESS','WEB_SCAN','WEB_AUTH_FAIL',"
    "'WEB_EXPLOIT_ATTEMPT','DB_AUTH_FAIL','FW_BLOCK','FW_HONEYPOT_PORT','SUDO_FAIL','SU_FAIL') AND src_ip IS NOT NULL",
)
def route_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.handled(fx.sec_events(spark, sf_dir)).select("event_id", "kind", "src_ip")


def _rule(name: str, columns: dict[str, str], where: str) -> None:
    shown = ", ".join(f"{c} AS {alias}" for alias, c in columns.items())

    @query(name, f"SELECT event_id, src_ip, us, {shown} FROM cnt WHERE {where}")
    def build(spark: SparkSession, sf_dir: str, rule: str = name) -> DataFrame:
        rows = de.rule_rows(fx.sec_events(spark, sf_dir), rule, LIMITS)
        return rows.select("event_id", "src_ip", "us", *[F.col(c).alias(a) for a, c in columns.items()])


_rule("brute_force", {"fails": "ssh_fails"}, "kind = 'SSH_FAIL' AND ssh_fails >= 3")
_rule("credential_stuffing", {"users": "uniq_users"}, "kind = 'SSH_FAIL' AND uniq_users >= 3")
_rule("credential_breach", {"fails": "ssh_fails"}, "kind = 'SSH_SUCCESS' AND ssh_fails >= 2")
_rule("web_scan_flood", {"scans": "web_scans"}, "kind LIKE 'WEB%' AND web_scans >= 2")
_rule("web_auth_flood", {"auth_fails": "web_auth_fails"}, "kind LIKE 'WEB%' AND web_auth_fails >= 2")
_rule("web_exploit", {"exploits": "web_exploits"}, "kind LIKE 'WEB%' AND web_exploits >= 1")
_rule("db_brute_force", {"fails": "db_fails"}, "kind = 'DB_AUTH_FAIL' AND db_fails >= 3")


@query("honeypot_port_hit", "SELECT event_id, src_ip, us, dst_port FROM sec WHERE kind = 'FW_HONEYPOT_PORT'")
def honeypot_port_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.decoy_port_hits(fx.sec_events(spark, sf_dir)).select(
        "event_id", "src_ip", "us", F.col("meta.dst_port").alias("dst_port")
    )


@query("context_events", "SELECT event_id, src_ip, kind FROM sec WHERE kind IN ('FW_BLOCK','SUDO_FAIL','SU_FAIL')")
def context_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.context_events(fx.sec_events(spark, sf_dir)).select("event_id", "src_ip", "kind")


_SHOWN = ["event_id", "src_ip", "us", "severity", "fail_count", "uniq_users", "trigger"]


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select(*_SHOWN, F.array_join("reasons", "; ").alias("reasons"))


_FLAT_SQL = "event_id, src_ip, us, severity, fail_count, uniq_users, trigger, reasons"


@query("incident_candidates", f"SELECT {_FLAT_SQL} FROM cand")
def incident_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(de.incident_candidates(fx.sec_events(spark, sf_dir), LIMITS))


@query(
    "reputation_flag",
    """SELECT c.event_id, c.src_ip, c.us,
              CASE WHEN r3 IS NOT NULL OR r8 IS NOT NULL THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
              c.fail_count, c.uniq_users, c.trigger,
              concat_ws('; ', r1, r2, r3, r4, r5, r6, r7, r8,
                CASE WHEN r.ip IS NOT NULL THEN 'abuseipdb_score=' || abuse_score || ' reports=' || total_reports || ' isp=' || isp END) AS reasons
       FROM cand0 c LEFT JOIN (SELECT * FROM rep WHERE abuse_score >= 50 AND is_public) r ON c.src_ip = r.ip
       WHERE coalesce(r1, r2, r3, r4, r5, r6, r7, r8) IS NOT NULL OR r.ip IS NOT NULL""",
)
def reputation_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(
        de.incident_candidates(fx.sec_events(spark, sf_dir), LIMITS, fx.loaded_reputation(spark, sf_dir))
    )


def fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.fired_incidents(de.incident_candidates(fx.sec_events(spark, sf_dir), LIMITS), LIMITS)


@query("incidents", f"SELECT {_FLAT_SQL} FROM fired")
def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(fired(spark, sf_dir))


@query("repeat_offender", f"SELECT {_FLAT_SQL} FROM inc")
def repeat_offender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(de.incidents(fx.sec_events(spark, sf_dir), LIMITS))


def final_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.incidents(fx.sec_events(spark, sf_dir), LIMITS)


@query(
    "suppress_within",
    f"""SELECT src_ip, count(*) AS kept, min(us) AS first_us, max(us) AS last_us FROM (
          WITH RECURSIVE every AS (
            SELECT src_ip, min(us) AS us FROM raw GROUP BY src_ip
            UNION ALL SELECT e.src_ip, min(r.us) FROM every e JOIN raw r ON r.src_ip = e.src_ip AND r.us >= e.us + {DAY}
            GROUP BY e.src_ip)
          SELECT * FROM every) GROUP BY src_ip""",
)
def suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suppress_within(fx.raw_events(spark, sf_dir), ["src_ip"], DAY, stage=False)
    return kept.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("kept"), F.min("us").alias("first_us"), F.max("us").alias("last_us")
    )


@query(
    "sliding_count_sweep",
    f"""SELECT src_ip, us, count(*) FILTER (kind = 'SSH_FAIL') OVER w AS closed_day,
               count(*) FILTER (kind = 'SSH_FAIL') OVER s AS open_day, count(*) OVER l AS ten_days
        FROM sec WINDOW w AS (PARTITION BY src_ip ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW),
          s AS (PARTITION BY src_ip ORDER BY us RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW),
          l AS (PARTITION BY src_ip ORDER BY us RANGE BETWEEN {10 * DAY} PRECEDING AND CURRENT ROW)""",
)
def sliding_count_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    fail = F.col("kind") == "SSH_FAIL"
    return window_counts(
        fx.sec_events(spark, sf_dir),
        [
            Count("closed_day", fail, DAY),
            Count("open_day", fail, DAY, strict=True),
            Count("ten_days", F.lit(True), 10 * DAY),
        ],
        chunk_us=CHUNK_US,
    )


@query(
    "sliding_distinct_sweep",
    f"""SELECT src_ip, us, count(DISTINCT "user") OVER w AS users, count(DISTINCT kind) OVER l AS kinds
        FROM sec WINDOW w AS (PARTITION BY src_ip ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW),
          l AS (PARTITION BY src_ip ORDER BY us RANGE BETWEEN {5 * DAY - 1} PRECEDING AND CURRENT ROW)""",
)
def sliding_distinct_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_counts(
        fx.sec_events(spark, sf_dir),
        [
            Distinct("users", F.lit(True), DAY, value=F.col("user")),
            Distinct("kinds", F.lit(True), 5 * DAY, True, F.col("kind")),
        ],
        chunk_us=CHUNK_US,
    )


_GATE = "prior >= 5"
_UNUSUAL = "len(usual) > 0 AND hour_prior < 2"
_NEW = "known_users > 0 AND user_prior = 0"
_ABSENT = f"coalesce(us - previous_us > {4 * DAY}, false)"
_SPIKE = "earlier_days + 1 >= 3 AND today_count >= 2 AND today_count * earlier_days > earlier_logins"


@query(
    "ip_activity_snapshot",
    f"""SELECT s.src_ip, count(*) FILTER (kind = 'SSH_FAIL' AND us >= {AS_OF_US - DAY}) AS fails_in_window,
          count(DISTINCT CASE WHEN kind = 'SSH_FAIL' AND us >= {AS_OF_US - DAY} THEN "user" END) AS unique_users,
          count(*) FILTER (kind = 'WEB_SCAN' AND us >= {AS_OF_US - DAY}) AS web_scans,
          count(*) FILTER (kind = 'WEB_AUTH_FAIL' AND us >= {AS_OF_US - DAY}) AS web_auth_fails,
          count(*) FILTER (kind = 'DB_AUTH_FAIL' AND us >= {AS_OF_US - DAY}) AS db_fails,
          count(*) FILTER (kind = 'SSH_FAIL') AS total_fails,
          coalesce(any_value(i.n), 0) AS total_incidents, any_value(i.last_us) AS last_incident_us,
          coalesce(any_value(b.held), false) AS is_blocked, any_value(g.country) AS country, any_value(g.flag) AS flag,
          any_value(g.isp) AS isp, coalesce(any_value(a.n), 0) AS baseline_anomalies, coalesce(any_value(c.kinds), '') AS correlation_events
        FROM sec s LEFT JOIN (SELECT src_ip, count(*) AS n, max(us) AS last_us FROM inc GROUP BY src_ip) i ON s.src_ip = i.src_ip
          LEFT JOIN (SELECT DISTINCT ip, true AS held FROM blocks WHERE start_us <= {AS_OF_US} AND end_us > {AS_OF_US}) b ON s.src_ip = b.ip
          LEFT JOIN ip_geo g ON s.src_ip = g.src_ip
          LEFT JOIN (SELECT src_ip, count(*) AS n FROM login_hist WHERE {_GATE} AND ({_UNUSUAL} OR {_NEW} OR {_ABSENT} OR {_SPIKE}) GROUP BY src_ip) a
            ON s.src_ip = a.src_ip
          LEFT JOIN (SELECT src_ip, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds FROM (
              SELECT src_ip, kind, count(*) AS n FROM sec WHERE us > {AS_OF_US - 5 * DAY} AND us <= {AS_OF_US} GROUP BY ALL) GROUP BY src_ip) c
            ON s.src_ip = c.src_ip
        GROUP BY s.src_ip""",
)
def ip_activity_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seclog.operators import blocks

    events, found = fx.sec_events(spark, sf_dir), final_incidents(spark, sf_dir)
    geo = en.geo_lookup(events, fx.geo_ranges(spark, sf_dir), prefixes=fx.GEO_PREFIXES)
    held = blocks.block_intervals(blocks.block_requests(found), fx.BLOCKS)
    recent = co.kind_count_maps(co.recent_kind_counts(events, AS_OF_US, 5 * 86_400))
    state = de.activity_snapshot(
        events, found, AS_OF_US, LIMITS, held, geo.select("src_ip", "country", "flag", "isp"),
        bl.login_anomalies(events, BASELINE), recent,
    )
    item = lambda e: F.concat(e["key"], F.lit("="), e["value"])
    return state.withColumn("correlation_events", F.array_join(F.transform(F.map_entries("correlation_events"), item), ","))


@query(
    "response_plan",
    """SELECT event_id, CASE WHEN severity = 'HIGH' THEN '[AUTO] TEMP-BLOCK ' || src_ip || ' | ' ||
         CASE trigger WHEN 'success' THEN '[MANUAL] Audit the successful session — check what was accessed | [MANUAL] Rotate SSH credentials and keys immediately | [MANUAL] Check for new cron jobs, authorized_keys, .bashrc changes'
              WHEN 'fw' THEN '[MANUAL] Check if this IP is scanning other ports too | [MANUAL] Consider permanent block if attack persists'
              ELSE '[MANUAL] Review open ports and firewall rules | [MANUAL] Check server logs for signs of compromise' END
         ELSE '[PLAN] Monitor ' || src_ip || ' for further activity | [PLAN] Consider fail2ban / rate-limiting | [PLAN] Check AbuseIPDB / Shodan for known-bad IP info'
         END AS plan FROM rinc""",
)
def response_plan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = response_plan(F.col("severity"), F.col("src_ip"), F.col("trigger"))
    return fx.report_incidents(spark, sf_dir).select("event_id", F.array_join(plan, " | ").alias("plan"))


@query(
    "response_decision",
    """SELECT event_id, 'disabled' AS off, CASE WHEN severity = 'HIGH' THEN 'dry_run:drop' ELSE 'severity_below_threshold' END AS dry,
         CASE WHEN severity IN ('HIGH', 'MEDIUM') THEN 'tarpit' ELSE 'severity_below_threshold' END AS live FROM rinc""",
)
def response_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("severity")
    return fx.report_incidents(spark, sf_dir).select(
        "event_id",
        response_decision(s).alias("off"),
        response_decision(s, True).alias("dry"),
        response_decision(s, True, "MEDIUM", "tarpit", False).alias("live"),
    )


# --- correlation ------------------------------------------------------------------


def all_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.correlate(fx.sec_events(spark, sf_dir), RULES, CHUNK_US)


def _evidence_text(alerts: DataFrame) -> DataFrame:
    item = lambda e: F.concat(e["kind"], F.lit("="), e["count"])
    return alerts.withColumn("evidence", F.array_join(F.transform("evidence", item), ","))


_ALERT = "src_ip, us, rule, confidence, severity, description, evidence"


def _corr_rule(key: str, rule_name: str) -> None:
    @query(key, f"SELECT src_ip, us, description, evidence FROM corr WHERE rule = '{rule_name}'")
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rule = [r for r in RULES if r.name == rule_name]
        alerts = co.correlate(fx.sec_events(spark, sf_dir), rule, CHUNK_US)
        return _evidence_text(alerts).select("src_ip", "us", "description", "evidence")


_corr_rule("corr_multi_service", "multi_service_brute_force")
_corr_rule("corr_web_recon_ssh", "web_recon_then_ssh")
_corr_rule("corr_honeypot_ssh", "honeypot_then_ssh")
_corr_rule("corr_web_auth_flood", "web_auth_flood")
_corr_rule("corr_privilege_escalation", "privilege_escalation")
_corr_rule("corr_persistent_recon", "persistent_recon")


@query("correlate", f"SELECT {_ALERT} FROM corr")
def correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence_text(all_alerts(spark, sf_dir))


def kept_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.correlation_alerts(all_alerts(spark, sf_dir), RULES)


@query("corr_alerts", f"SELECT {_ALERT} FROM corr_kept")
def corr_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence_text(kept_alerts(spark, sf_dir))


@query(
    "corr_ip_summary",
    f"SELECT src_ip, kind, count(*) AS n FROM sec WHERE us > {AS_OF_US - 5 * DAY} AND us <= {AS_OF_US} GROUP BY ALL",
)
def corr_ip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.recent_kind_counts(fx.sec_events(spark, sf_dir), AS_OF_US, 5 * 86_400)


@query(
    "corr_to_incident",
    """SELECT src_ip, us, severity, reasons, fail_count, trigger FROM inc
       UNION ALL SELECT src_ip, us, severity, '[CORRELATION:' || rule || '] ' || description, 0, 'correlation' FROM corr_kept""",
)
def corr_to_incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = final_incidents(spark, sf_dir).unionByName(
        co.alerts_as_incidents(kept_alerts(spark, sf_dir)), allowMissingColumns=True
    )
    return both.select(
        "src_ip", "us", "severity", F.array_join("reasons", "; ").alias("reasons"), "fail_count", "trigger"
    )


@query(
    "privilege_attribution",
    f"""SELECT p.event_id, p.host, p."user", p.kind, CASE WHEN p.us - l.us <= {5 * DAY} THEN l.src_ip END AS src_ip
        FROM (SELECT * FROM sec WHERE kind IN ('SUDO_FAIL', 'SU_FAIL')) p
        ASOF LEFT JOIN (SELECT * FROM sec WHERE kind = 'SSH_SUCCESS') l
        ON p.host = l.host AND p."user" = l."user" AND p.us >= l.us""",
)
def privilege_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = co.attribute_privilege(fx.sec_events(spark, sf_dir), 5 * 86_400)
    return rows.select("event_id", "host", "user", "kind", "src_ip")


CUSTOM = co.RuleSpec(
    "spray_and_probe", 4 * 86_400, ((("SSH_FAIL", "DB_AUTH_FAIL", "WEB_AUTH_FAIL"), 5), (("FW_BLOCK",), 1)),
    "HIGH", 0.6, "{SSH_FAIL}/{DB_AUTH_FAIL}/{WEB_AUTH_FAIL} failures, {FW_BLOCK} blocks",
)


@query(
    "custom_rules",
    f"""SELECT src_ip, us, 'spray_and_probe' AS rule, 'HIGH' AS severity, a || '/' || b || '/' || c || ' failures, ' || d || ' blocks' AS description
        FROM (SELECT src_ip, us, count(*) FILTER (kind = 'SSH_FAIL') OVER w AS a, count(*) FILTER (kind = 'DB_AUTH_FAIL') OVER w AS b,
                count(*) FILTER (kind = 'WEB_AUTH_FAIL') OVER w AS c, count(*) FILTER (kind = 'FW_BLOCK') OVER w AS d
              FROM sec WINDOW w AS (PARTITION BY src_ip ORDER BY us RANGE BETWEEN {4 * DAY - 1} PRECEDING AND CURRENT ROW))
        WHERE a + b + c >= 5 AND d >= 1""",
)
def custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = co.correlate(fx.sec_events(spark, sf_dir), [CUSTOM], CHUNK_US)
    return rows.select("src_ip", "us", "rule", "severity", "description")


# --- behavioural baseline ---------------------------------------------------------

def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.login_history(fx.sec_events(spark, sf_dir), BASELINE).filter(
        F.col("prior") >= BASELINE.min_observations
    )


@query(
    "login_profile",
    f"""SELECT l.src_ip, count(*) AS total_logins, count(DISTINCT l."user") AS known_users, min(us) AS first_seen_us,
          max(us) AS last_seen_us, coalesce(any_value(a.n), 0) AS anomaly_count,
          any_value(h.hours) AS hours
        FROM logins l LEFT JOIN (SELECT src_ip, count(*) AS n FROM login_hist WHERE {_GATE} AND (({_UNUSUAL}) OR ({_NEW}) OR ({_ABSENT}) OR ({_SPIKE})) GROUP BY src_ip) a
          ON l.src_ip = a.src_ip
        JOIN (SELECT src_ip, string_agg(hour || ':' || n, ',' ORDER BY hour) AS hours FROM (SELECT src_ip, hour, count(*) AS n FROM logins GROUP BY ALL) GROUP BY src_ip) h
          ON l.src_ip = h.src_ip
        GROUP BY l.src_ip""",
)
def login_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.sec_events(spark, sf_dir)
    hour = lambda e: F.concat(e["key"], F.lit(":"), e["value"])
    return bl.login_profiles(events, bl.login_anomalies(events, BASELINE)).select(
        "src_ip", "total_logins", "known_users", "first_seen_us", "last_seen_us", "anomaly_count",
        F.array_join(F.transform(F.map_entries("login_hours"), hour), ",").alias("hours"),
    )


@query(
    "login_profile_users",
    'SELECT src_ip, "user", count(*) AS logins, min(us) AS first_seen_us FROM logins GROUP BY ALL',
)
def login_profile_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.login_profile_users(fx.sec_events(spark, sf_dir))


@query("login_unusual_hour", f"SELECT event_id, src_ip, hour, hour_prior FROM login_hist WHERE {_GATE} AND {_UNUSUAL}")
def login_unusual_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).filter(bl.unusual_hour()).select("event_id", "src_ip", "hour", "hour_prior")


@query("login_new_user", f'SELECT event_id, src_ip, "user", known_users FROM login_hist WHERE {_GATE} AND {_NEW}')
def login_new_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).filter(bl.new_user()).select("event_id", "src_ip", "user", "known_users")


@query(
    "login_after_absence",
    f"SELECT event_id, src_ip, (us - previous_us) // {DAY} AS days FROM login_hist WHERE {_GATE} AND {_ABSENT}",
)
def login_after_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).filter(bl.after_absence(BASELINE)).select(
        "event_id", "src_ip", F.floor((F.col("us") - F.col("previous_us")) / DAY).alias("days")
    )


@query(
    "login_frequency_spike",
    f"SELECT event_id, src_ip, today_count, earlier_days, CAST(earlier_logins AS BIGINT) AS earlier_logins FROM login_hist WHERE {_GATE} AND {_SPIKE}",
)
def login_frequency_spike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).filter(bl.frequency_spike(BASELINE)).select(
        "event_id", "src_ip", "today_count", "earlier_days", "earlier_logins"
    )


ANOMALIES_SQL = f"""SELECT * FROM (SELECT event_id, src_ip, concat_ws('; ',
          CASE WHEN {_UNUSUAL} THEN 'login at unusual hour ' || lpad(CAST(hour AS VARCHAR), 2, '0') || ':xx (normal hours: [' || array_to_string(usual, ', ') || '])' END,
          CASE WHEN {_NEW} THEN 'new username ''' || "user" || ''' for IP with ' || known_users || ' known users' END,
          CASE WHEN {_ABSENT} THEN 'login after ' || ((us - previous_us) // {DAY}) || '-day absence' END,
          CASE WHEN {_SPIKE} THEN 'login frequency spike: ' || today_count || ' today vs avg ' || printf('%.1f', CAST(earlier_logins AS DOUBLE) / earlier_days) || '/day' END) AS anomaly
        FROM login_hist WHERE {_GATE}) WHERE anomaly <> ''"""


@query("login_anomalies", ANOMALIES_SQL)
def login_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.login_anomalies(fx.sec_events(spark, sf_dir), BASELINE).select("event_id", "src_ip", "anomaly")


# --- features and isolation forest ------------------------------------------------


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fe.ip_window_features(
        fx.sec_events(spark, sf_dir), FOREST.window_sec, chunk_us=CHUNK_US
    )


_FEATURE_SQL = f"""
  SELECT src_ip, us, count(*) FILTER (kind = 'SSH_FAIL') OVER w AS ssh_fails, count(*) FILTER (kind = 'SSH_SUCCESS') OVER w AS ssh_success,
    count(*) FILTER (kind LIKE 'WEB%') OVER w AS web_events, count(*) FILTER (kind LIKE 'DB%') OVER w AS db_fails,
    count(*) FILTER (kind LIKE 'FW%') OVER w AS fw_blocks, count(DISTINCT "user") OVER w AS unique_users,
    CAST(count(DISTINCT source) OVER w AS INTEGER) AS source_count, CAST(hour(ts) AS INTEGER) AS hour_of_day,
    CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, round(count(*) OVER w / 1440.0, 9) AS events_per_min,
    round(CASE WHEN count(*) OVER w >= 2 THEN (us - min(us) OVER w) / (count(*) OVER w - 1.0) / 1000000.0 ELSE 0.0 END, 3) AS avg_interval_sec
  FROM sec WINDOW w AS (PARTITION BY src_ip ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)"""


@query("ip_window_features", _FEATURE_SQL)
def ip_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).withColumns(
        {
            "events_per_min": F.round("events_per_min", 9),
            "avg_interval_sec": F.round("avg_interval_sec", 3),
        }
    )


@query("iforest_fit")
def iforest_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iforest.fit(staged(_features(spark, sf_dir), "features"), FOREST)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(_features(spark, sf_dir), "features")
    return iforest.score(rows, iforest.fit(rows, FOREST), limits=FOREST)


@query("iforest_score")
def iforest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("src_ip", "us", F.round("score", 6).alias("score"))


@query(
    "iforest_structure",
    f"""SELECT CAST(t AS INTEGER) AS tree, least({FOREST.sample_size}, n) AS sample, least({FOREST.sample_size}, n) AS in_leaves, 0 AS uneven_splits
        FROM (SELECT count(*) AS n FROM ({_FEATURE_SQL})), range({FOREST.trees}) r(t) WHERE n >= {FOREST.min_samples}""",
)
def iforest_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per tree the rows at its root and in its leaves, and the splits whose children do not add up."""
    nodes = staged(iforest_fit(spark, sf_dir), "forest")
    child = nodes.select("tree", F.col("node").alias("child"), F.col("size").alias("part"))
    halves = nodes.filter("feature >= 0").select("tree", "node", "size", F.explode(F.array("left", "right")).alias("child"))
    uneven = (
        halves.join(child, ["tree", "child"], "left")
        .groupBy("tree", "node", "size")
        .agg(F.coalesce(F.sum("part"), F.lit(0)).alias("parts"))
        .filter("parts <> size")
        .select("tree", F.lit(0).alias("sample"), F.lit(0).alias("in_leaves"), F.lit(1).alias("uneven"))
    )
    rows = nodes.select(
        "tree",
        F.when(F.col("node") == 0, F.col("size")).otherwise(0).alias("sample"),
        F.when(F.col("feature") < 0, F.col("size")).otherwise(0).alias("in_leaves"),
        F.lit(0).alias("uneven"),
    )
    return rows.unionByName(uneven).groupBy("tree").agg(
        F.sum("sample").alias("sample"), F.sum("in_leaves").alias("in_leaves"), F.sum("uneven").cast("int").alias("uneven_splits")
    )


@query(
    "iforest_bounds",
    f"""SELECT count(*) AS scored, count(*) AS in_range, true AS share_holds, 0 AS short_gaps, 0 AS without_reason
        FROM ({_FEATURE_SQL})""",
)
def iforest_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants scored, scores in [-1, 0], whether alerts stay within the contamination share and keep their gap."""
    scored = staged(_scored(spark, sf_dir), "scores")
    alerts = staged(iforest.anomalies(scored, FOREST), "alerts")
    gap = F.col("us") - F.lag("us").over(Window.partitionBy("src_ip").orderBy("us"))
    one = lambda where: F.when(where, 1).otherwise(0)
    none = F.lit(0)
    of_alerts = alerts.withColumn("gap", gap).select(
        none.alias("scored"), none.alias("in_range"), F.lit(1).alias("alerts"),
        one(F.col("gap") < FOREST.cooldown_sec * SECOND_US).alias("short"), one(F.size("reasons") == 0).alias("bare"),
    )
    of_scores = scored.select(
        F.lit(1).alias("scored"), one(F.col("score").between(-1, 0)).alias("in_range"), none.alias("alerts"), none.alias("short"), none.alias("bare"),
    )
    total = of_scores.union(of_alerts).agg(*[F.coalesce(F.sum(c), none).alias(c) for c in ("scored", "in_range", "alerts", "short", "bare")])
    return total.select(
        "scored",
        "in_range",
        (F.col("alerts") <= F.ceil(F.col("scored") * FOREST.contamination)).alias("share_holds"),
        F.col("short").cast("int").alias("short_gaps"),
        F.col("bare").cast("int").alias("without_reason"),
    )


@query("ml_alerts")
def ml_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iforest.anomalies(_scored(spark, sf_dir), FOREST).select(
        "src_ip", "us", F.round("score", 6).alias("score"), F.array_join("reasons", "; ").alias("reasons")
    )


@query(
    "anomaly_reasons",
    f"""SELECT src_ip, us, CASE WHEN found <> '' THEN found ELSE 'statistical anomaly (score=-0.500)' END AS reasons FROM (
         SELECT src_ip, us, concat_ws('; ', CASE WHEN ssh_fails > 3 THEN ssh_fails || ' SSH failures in window' END,
           CASE WHEN web_events > 10 THEN web_events || ' web events in window' END, CASE WHEN db_fails > 2 THEN db_fails || ' DB failures in window' END,
           CASE WHEN fw_blocks > 1 THEN fw_blocks || ' firewall blocks' END, CASE WHEN unique_users > 3 THEN unique_users || ' distinct usernames' END,
           CASE WHEN source_count > 2 THEN source_count || ' different log sources' END,
           CASE WHEN events_per_min > 5 THEN printf('%.1f', events_per_min) || ' events/min' END) AS found FROM ({_FEATURE_SQL}))""",
)
def anomaly_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fe.anomaly_reasons(F.lit(-0.5))
    return _features(spark, sf_dir).select("src_ip", "us", F.array_join(found, "; ").alias("reasons"))


@query(
    "incidents_by_severity",
    f"""SELECT src_ip, severity, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM (
          WITH RECURSIVE s AS (SELECT src_ip, severity, min(us) AS us FROM cand GROUP BY ALL
            UNION ALL SELECT s.src_ip, s.severity, min(c.us) FROM s JOIN cand c ON c.src_ip = s.src_ip AND c.severity = s.severity AND c.us >= s.us + {2 * DAY}
            GROUP BY s.src_ip, s.severity) SELECT * FROM s) GROUP BY ALL""",
)
def incidents_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = de.incident_candidates(fx.sec_events(spark, sf_dir), LIMITS)
    kept = de.fired_incidents(candidates, LIMITS, severity_aware=True)
    return kept.groupBy("src_ip", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us")
    )
