"""The whole way from raw log lines to incidents as one query."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seclog.plans import fixtures as fx
from seclog.plans.catalog import query
from seclog.plans.fixture_sql import CTES, DAY
from seclog.plans.fixtures import LIMITS, RULES, YEAR
from seclog.plans.from_lines import incidents_from_lines
from seclog.plans.queries_parse import _SSH, _SSH_USER, _WEB, _WEB_KIND

# Times in lines are whole seconds, so several events share an instant: of them one fires, and each alert counts once.
_SECOND = "us - us % 1000000 AS us"
_LINE_EVENTS = f"""
      SELECT event_id, {_SECOND}, source, kind, src_ip, {_SSH_USER} AS "user", host, path, dst_port, k FROM sec WHERE {_SSH}
      UNION ALL SELECT event_id, {_SECOND}, source, {_WEB_KIND}, src_ip, NULL, NULL, path, NULL, k FROM {_WEB} WHERE {_WEB_KIND} IS NOT NULL
      UNION ALL SELECT event_id, {_SECOND}, source, kind, src_ip, "user", NULL, NULL, NULL, k FROM sec WHERE source = 'mysql' AND k % 9 <> 0
      UNION ALL SELECT event_id, {_SECOND}, source, CASE WHEN kind = 'FW_HONEYPOT_PORT' AND k % 7 <> 0 THEN kind ELSE 'FW_BLOCK' END,
             src_ip, NULL, host, NULL, dst_port, k FROM sec WHERE source = 'ufw' AND k % 11 <> 0
      UNION ALL SELECT event_id, {_SECOND}, source, kind, NULL, "user", host, NULL, NULL, k FROM sec
             WHERE source = 'syslog' AND (kind = 'SUDO_FAIL' OR k % 5 <> 0)"""
_STEPS = {
    "made": CTES["sec"],
    "line_events": f"SELECT *, us // 1000000 * 1000000000 + event_id AS place FROM ({re.sub(r'\bsec\b', 'made', _LINE_EVENTS)})",
    "sec": f"""
      SELECT * EXCLUDE (place) FROM line_events WHERE source <> 'syslog'
      UNION ALL SELECT p.* EXCLUDE (place) REPLACE (CASE WHEN p.us - l.us <= {5 * DAY} THEN l.src_ip END AS src_ip)
      FROM (SELECT * FROM line_events WHERE source = 'syslog') p
      ASOF JOIN (SELECT * FROM line_events WHERE kind = 'SSH_SUCCESS') l
      ON p.host = l.host AND p."user" = l."user" AND p.place >= l.place
      WHERE p.us - l.us <= {5 * DAY}""",
    "fired": CTES["fired"] + " QUALIFY row_number() OVER (PARTITION BY c.src_ip, c.us ORDER BY c.event_id) = 1",
    "corr_rows": CTES["corr"],
    "corr": "SELECT DISTINCT * FROM corr_rows",
}


@query(
    "lines_to_incidents",
    """SELECT src_ip, us, severity, reasons, fail_count, trigger FROM inc
       UNION ALL SELECT src_ip, us, severity, '[CORRELATION:' || rule || '] ' || description, 0, 'correlation' FROM corr_kept""",
    _STEPS,
)
def lines_to_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = incidents_from_lines(fx.log_lines(spark, sf_dir), YEAR, LIMITS, RULES, 5 * 86_400)
    return found.select("src_ip", "us", "severity", F.array_join("reasons", "; ").alias("reasons"), "fail_count", "trigger")
