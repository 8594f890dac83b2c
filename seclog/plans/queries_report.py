"""Report aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seclog.functions.scalar import country_flag
from seclog.operators import enrich as en
from seclog.operators import fim as fi
from seclog.plans import fixtures as fx
from seclog.plans import report as rp
from seclog.plans.catalog import query
from seclog.plans.fixture_sql import DAY
from seclog.plans.fixtures import AS_OF_US
from seclog.plans.queries_detect import final_incidents
from seclog.plans.queries_history import changes, intervals

_RANK = "CASE severity WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END"
_WORST = f"CASE max({_RANK}) WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END"


@query(
    "recent_incidents",
    "SELECT event_id, src_ip, us, severity, reason1 || '; ' || reason2 AS reasons FROM rinc ORDER BY us DESC, src_ip LIMIT 100",
)
def recent_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.recent_incidents(fx.report_incidents(spark, sf_dir), 100).select(
        "event_id", "src_ip", "us", "severity", F.array_join("reasons", "; ").alias("reasons")
    )


@query(
    "top_attackers",
    f"""SELECT src_ip, arg_max(country, us) AS country, arg_max(city, us) AS city, arg_max(isp, us) AS isp, count(*) AS incident_count,
          {_WORST} AS max_severity, max(us) AS last_seen_us FROM rinc GROUP BY src_ip ORDER BY incident_count DESC, src_ip LIMIT 20""",
)
def top_attackers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.top_attackers(fx.report_incidents(spark, sf_dir))


@query(
    "top_attackers_detected",
    f"""SELECT src_ip, count(*) AS incident_count, {_WORST} AS max_severity, max(us) AS last_seen_us
        FROM inc GROUP BY src_ip ORDER BY incident_count DESC, src_ip LIMIT 20""",
)
def top_attackers_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.top_attackers(final_incidents(spark, sf_dir))


@query(
    "timeline_24h",
    f"""SELECT CAST((us - {AS_OF_US - DAY}) // 3600000000 AS INTEGER) AS hour_offset, severity, count(*) AS n
        FROM rinc WHERE us >= {AS_OF_US - DAY} AND us <= {AS_OF_US} GROUP BY ALL""",
)
def timeline_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.timeline(fx.report_incidents(spark, sf_dir), AS_OF_US)


@query(
    "timeline_24h_filled",
    f"""SELECT CAST(h AS INTEGER) AS hour_offset, s AS severity, (SELECT count(*) FROM rinc WHERE severity = s AND us >= {AS_OF_US - DAY} AND us <= {AS_OF_US}
          AND least(23, (us - {AS_OF_US - DAY}) // 3600000000) = h) AS n
        FROM (SELECT unnest(range(24)) AS h), (SELECT unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW']) AS s)""",
)
def timeline_24h_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.timeline_filled(fx.report_incidents(spark, sf_dir), AS_OF_US)


@query(
    "incident_stats",
    """SELECT count(*) AS total, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
         count(*) FILTER (severity = 'LOW') AS low, count(DISTINCT src_ip) AS unique_ips FROM rinc""",
)
def incident_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.incident_stats(fx.report_incidents(spark, sf_dir))


_DAYS = 7
_SINCE = AS_OF_US - _DAYS * DAY
_TOTALS = f"""
  SELECT (SELECT count(*) FROM rinc WHERE us >= {_SINCE} AND us <= {AS_OF_US}) AS total,
    (SELECT count(*) FROM rinc WHERE us >= {_SINCE} AND us <= {AS_OF_US} AND severity = 'HIGH') AS high,
    (SELECT count(*) FROM rinc WHERE us >= {_SINCE} AND us <= {AS_OF_US} AND severity = 'MEDIUM') AS medium,
    (SELECT count(*) FROM blocks WHERE start_us <= {AS_OF_US} AND end_us > {AS_OF_US}) AS held,
    (SELECT count(*) FROM fim_alerts) AS fim, (SELECT count(*) FROM fim_alerts WHERE severity = 'CRITICAL') AS crit"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.period_report(
        fx.report_incidents(spark, sf_dir), intervals(spark, sf_dir), changes(spark, sf_dir), AS_OF_US, _DAYS
    )


@query(
    "period_report",
    f"""SELECT unnest(['total_incidents', 'high_count', 'medium_count', 'block_count', 'fim_alert_count', 'fim_critical']) AS metric,
          unnest([total, high, medium, held, fim, crit]) AS value FROM ({_TOTALS})""",
)
def period_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)


@query(
    "executive_summary",
    f"""SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS "position", unnest(['Total incidents', 'HIGH severity incidents', 'MEDIUM severity incidents', 'File integrity alerts', 'Currently blocked IPs']) AS metric,
          unnest([CAST(total AS VARCHAR), CAST(high AS VARCHAR), CAST(medium AS VARCHAR), CAST(fim AS VARCHAR), CAST(held AS VARCHAR)]) AS value,
          unnest([CASE WHEN total > 10 THEN '! Action needed' ELSE 'OK Normal' END, CASE WHEN high > 0 THEN '! Review required' ELSE 'OK None' END, '—',
            CASE WHEN crit > 0 THEN '! Review files' ELSE 'OK Clean' END, '—']) AS status FROM ({_TOTALS})""",
)
def executive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.executive_summary(_report(spark, sf_dir))


@query(
    "compliance_mapping",
    """SELECT unnest(['SOC 2 Type II', 'ISO 27001', 'PCI-DSS v4']) AS framework,
         unnest(['CC6.1, CC6.7, CC7.2, CC6.8', 'A.12.4, A.12.6, A.13.1, A.16.1', 'Req 10, Req 11.5, Req 11.5.2, Req 12.10']) AS controls,
         unnest([CASE WHEN c = 0 THEN 'OK Monitored' ELSE '! FIM alerts' END, 'OK Compliant', CASE WHEN c = 0 THEN 'OK Compliant' ELSE '! File changes detected' END]) AS status
       FROM (SELECT count(*) FILTER (severity = 'CRITICAL') AS c FROM fim_alerts)""",
)
def compliance_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.compliance_mapping(fi.alert_counts(changes(spark, sf_dir), _SINCE))


@query(
    "compliance_controls",
    """SELECT control, CASE WHEN control = 'CC6.8' THEN 'File integrity ' || CASE WHEN n = 0 THEN 'maintained' ELSE n || ' changes detected' END
         WHEN control = 'Req 11.5.2' THEN 'File integrity ' || CASE WHEN c = 0 THEN 'OK' ELSE c || ' critical changes' END ELSE text END AS finding
       FROM (SELECT count(*) AS n, count(*) FILTER (severity = 'CRITICAL') AS c FROM fim_alerts),
         (VALUES ('CC6.1', 'Access controls monitored'), ('CC6.7', 'Unauthorized access detection'), ('CC7.2', 'System anomaly monitoring'), ('CC6.8', ''),
           ('A.12.4', 'Event logging active'), ('A.12.6', 'Vulnerability monitoring'), ('A.13.1', 'Network monitoring'), ('A.16.1', 'Incident management'),
           ('Req 10', 'Log monitoring active'), ('Req 11.5', 'Intrusion detection'), ('Req 11.5.2', ''), ('Req 12.10', 'Incident response')) AS v(control, text)""",
)
def compliance_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.compliance_controls(fi.alert_counts(changes(spark, sf_dir), _SINCE)).select("control", "finding")


_COUNTERS = f"""
  SELECT 'events_processed_total' AS metric, '' AS label, count(*) AS value FROM sec
  UNION ALL SELECT 'ssh_fails_total', '', count(*) FROM sec WHERE kind = 'SSH_FAIL'
  UNION ALL SELECT 'blocks_total', '', count(*) FROM blocks
  UNION ALL SELECT 'blocks_active', '', count(*) FROM blocks WHERE start_us <= {AS_OF_US} AND end_us > {AS_OF_US}
  UNION ALL SELECT 'incidents_total', s, (SELECT count(*) FROM rinc WHERE severity = s) FROM (SELECT unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW']) AS s)"""


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.engine_counters(
        fx.sec_events(spark, sf_dir), fx.report_incidents(spark, sf_dir), intervals(spark, sf_dir), AS_OF_US
    )


@query("engine_counters", _COUNTERS)
def engine_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counters(spark, sf_dir)


@query(
    "expose_metrics",
    f"""SELECT 'seclog_' || metric || CASE WHEN label = '' THEN '' ELSE '{{severity="' || label || '"}}' END || ' ' || value AS line FROM ({_COUNTERS})
        UNION ALL SELECT unnest({rp.expose_headers()})""",
)
def expose_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.expose_metrics(_counters(spark, sf_dir), headers=True)


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.geo_lookup(
        fx.raw_events(spark, sf_dir), fx.geo_ranges(spark, sf_dir), prefixes=fx.GEO_PREFIXES
    )


@query(
    "top_failing_ips",
    """SELECT s.src_ip, count(*) AS fails, any_value(g.country) AS country FROM sec s JOIN ip_geo g ON s.src_ip = g.src_ip
       WHERE kind = 'SSH_FAIL' GROUP BY s.src_ip ORDER BY fails DESC, s.src_ip LIMIT 10""",
)
def top_failing_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.top_failing_ips(fx.sec_events(spark, sf_dir), _geo(spark, sf_dir))


@query("top_failing_ips_approx")
def top_failing_ips_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.top_failing_ips_approx(fx.sec_events(spark, sf_dir))


@query(
    "fails_by_country",
    """SELECT g.country, count(*) AS fails FROM sec s JOIN ip_geo g ON s.src_ip = g.src_ip WHERE kind = 'SSH_FAIL' GROUP BY g.country""",
)
def fails_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.fails_by_country(fx.sec_events(spark, sf_dir), _geo(spark, sf_dir))


def _sliding(rows: str, by: str, window: int, step: int) -> str:
    """Sliding counts by assigning a row to every window that holds it."""
    lag = window // step
    keys = f", {by}" if by else ""
    return f"""SELECT (us // {step} + i) * {step} AS window_end_us{keys}, count(*) AS n
      FROM {rows}, (SELECT unnest(range(1, {lag + 1})) AS i) GROUP BY ALL"""


_HOUR = 3_600_000_000


@query(
    "rate_series",
    f"""SELECT 'incidents' AS series, severity AS label, window_end_us, n, CAST(n AS DOUBLE) AS rate FROM ({_sliding('rinc', 'severity', 5 * _HOUR, _HOUR)})
        UNION ALL SELECT 'ssh_fails', '', window_end_us, n, n / 5.0 FROM ({_sliding("(SELECT us FROM sec WHERE kind = 'SSH_FAIL')", '', 5 * _HOUR, _HOUR)})
        UNION ALL SELECT 'events', '', window_end_us, n, CAST(n AS DOUBLE) FROM ({_sliding('(SELECT us FROM sec)', '', _HOUR, _HOUR)})""",
)
def rate_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, found = fx.sec_events(spark, sf_dir), fx.report_incidents(spark, sf_dir)
    hour = 3600
    parts = [
        ("incidents", rp.rate_series(found, 5 * hour, hour, 5 * hour, ["severity"])),
        ("ssh_fails", rp.rate_series(events.filter(F.col("kind") == "SSH_FAIL"), 5 * hour, hour, hour)),
        ("events", rp.rate_series(events, hour, hour, hour)),
    ]
    shown = [
        df.select(
            F.lit(name).alias("series"),
            (F.col("severity") if "severity" in df.columns else F.lit("")).alias("label"),
            "window_end_us",
            "n",
            "rate",
        )
        for name, df in parts
    ]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


@query(
    "expose_top_ips",
    """SELECT 'seclog_ip_fails_total{ip="' || src_ip || '",country="' || country || '"} ' || fails AS line FROM (
         SELECT s.src_ip, count(*) AS fails, any_value(g.country) AS country FROM sec s JOIN ip_geo g ON s.src_ip = g.src_ip
         WHERE kind = 'SSH_FAIL' GROUP BY s.src_ip ORDER BY fails DESC, s.src_ip LIMIT 10)""",
)
def expose_top_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.expose_top_ips(rp.top_failing_ips(fx.sec_events(spark, sf_dir), _geo(spark, sf_dir)))


@query(
    "report_document",
    f"""SELECT CAST(to_json({{'period_days': {_DAYS}, 'generated_at': strftime(make_timestamp({AS_OF_US}), '%Y-%m-%dT%H:%M:%SZ'),
          'since': strftime(make_timestamp({_SINCE}), '%Y-%m-%dT%H:%M:%SZ'),
          'totals': {{'block_count': held, 'fim_alert_count': fim, 'fim_critical': crit, 'high_count': high, 'medium_count': medium, 'total_incidents': total}},
          'top_attackers': (SELECT list({{'src_ip': src_ip, 'incident_count': n, 'max_severity': worst}} ORDER BY n DESC, src_ip) FROM (
            SELECT src_ip, count(*) AS n, {_WORST} AS worst FROM rinc WHERE us >= {_SINCE} AND us <= {AS_OF_US} GROUP BY src_ip ORDER BY n DESC, src_ip LIMIT 10))}})
          AS VARCHAR) AS document FROM ({_TOTALS})""",
)
def report_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fx.report_incidents(spark, sf_dir).withColumn("flag", country_flag(F.lit("AB")))
    found = found.filter(F.col("us").between(_SINCE, AS_OF_US))
    return rp.report_document(_report(spark, sf_dir), rp.top_attackers(found), AS_OF_US, _DAYS)
