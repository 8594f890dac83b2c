"""Parsing, scalar-function and routing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seclog.functions import ip as ipf
from seclog.functions import markup as mk
from seclog.functions import scalar as sc
from seclog.operators import outbox as ob
from seclog.plans import fixtures as fx
from seclog.plans.catalog import query
from seclog.plans.fixture_sql import BASE
from seclog.plans.fixtures import AS_OF_US, YEAR
from seclog.sources import audit
from seclog.sources import parsers as pa


def parsed(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """What the parser of a source makes of all lines, of which it must drop those of the others."""
    return pa.parse_lines(fx.log_lines(spark, sf_dir), source, YEAR)


_SSH = """kind IN ('SSH_FAIL', 'SSH_SUCCESS') AND NOT (kind = 'SSH_FAIL' AND k % 6 = 5)"""
_SSH_USER = """CASE WHEN kind = 'SSH_FAIL' AND k % 6 IN (2, 3) THEN NULL ELSE "user" END"""

SSH_LINES = f'SELECT kind, src_ip, {_SSH_USER} AS "user", us FROM sec WHERE {_SSH}'


@query("parse_sshd", f'SELECT event_id, kind, src_ip, {_SSH_USER} AS "user", host FROM sec WHERE {_SSH}')
def parse_sshd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir, "auth").select("event_id", "kind", "src_ip", "user", "host")


# What the access lines of the fixture contain, after the variations by k.
_WEB = """(SELECT *, CASE WHEN k % 7 = 0 THEN 200 ELSE status END AS st, CASE WHEN k % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
             CASE WHEN k % 11 = 0 THEN '' ELSE CASE k % 5 WHEN 0 THEN 'Mozilla/5.0' WHEN 1 THEN 'sqlmap/1.7' WHEN 2 THEN 'curl/8.1.2'
                  WHEN 3 THEN 'Mozilla/5.0' ELSE 'Nikto' END END AS agent,
             kind = 'WEB_EXPLOIT_ATTEMPT' AS attack FROM sec WHERE source = 'nginx' AND k % 13 <> 0)"""
_SCANNER = "agent IN ('sqlmap/1.7', 'curl/8.1.2', 'Nikto')"
_WEB_KIND = f"""CASE WHEN attack THEN 'WEB_EXPLOIT_ATTEMPT' WHEN st = 401 THEN 'WEB_AUTH_FAIL' WHEN st = 404 THEN 'WEB_SCAN'
                WHEN {_SCANNER} THEN 'WEB_SCAN' END"""
_SCORE = f"""CASE st WHEN 401 THEN 2 WHEN 404 THEN 1 ELSE 0 END + CASE WHEN attack THEN 3 ELSE 0 END
             + CASE WHEN {_SCANNER} THEN 2 ELSE 0 END + CASE WHEN attack AND method = 'POST' THEN 2 ELSE 0 END"""


@query(
    "parse_web_access",
    f"SELECT event_id, {_WEB_KIND} AS kind, src_ip, method, path, st AS status, agent AS ua FROM {_WEB} WHERE {_WEB_KIND} IS NOT NULL",
)
def parse_web_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir, "nginx").select(
        "event_id", "kind", "src_ip", "meta.method", "meta.path", "meta.status", "meta.ua"
    )


@query(
    "web_threat_score",
    f"SELECT event_id, {_SCORE} AS threat_score FROM {_WEB} WHERE {_WEB_KIND} IS NOT NULL",
)
def web_threat_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir, "nginx").select("event_id", "meta.threat_score")


@query(
    "parse_mysql_denied",
    "SELECT event_id, kind, src_ip, \"user\", 'mysql' AS db FROM sec WHERE source = 'mysql' AND k % 9 <> 0",
)
def parse_mysql_denied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir, "mysql").select("event_id", "kind", "src_ip", "user", "meta.db")


@query(
    "parse_firewall",
    """SELECT event_id, CASE WHEN kind = 'FW_HONEYPOT_PORT' AND k % 7 <> 0 THEN kind ELSE 'FW_BLOCK' END AS kind, src_ip,
         '10.0.0.5' AS dst_ip, CASE WHEN k % 7 = 0 THEN 0 ELSE dst_port END AS dst_port, 'BLOCK' AS action
       FROM sec WHERE source = 'ufw' AND k % 11 <> 0""",
)
def parse_firewall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir, "ufw").select(
        "event_id", "kind", "src_ip", "dst_ip", "meta.dst_port", "meta.action"
    )


@query(
    "parse_privilege",
    """SELECT event_id, kind, src_ip0 AS src_ip, "user", CASE WHEN kind = 'SU_FAIL' THEN 'root' END AS target_user, host
       FROM (SELECT *, CAST(NULL AS VARCHAR) AS src_ip0 FROM sec) WHERE source = 'syslog' AND (kind = 'SUDO_FAIL' OR k % 5 <> 0)""",
)
def parse_privilege(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir, "syslog").select(
        "event_id", "kind", "src_ip", "user", "meta.target_user", "host"
    )


# Any address ending in .139 looks like a NetBIOS port to the hint rules.
_HINT = """CASE WHEN src_ip LIKE '%.139' AND k % 9 NOT IN (0, 1) THEN 'ENUM_HINT' ELSE CASE k % 9 WHEN 0 THEN 'DISCOVERY' WHEN 1 THEN 'DISCOVERY' WHEN 3 THEN 'ENUM_HINT' WHEN 4 THEN 'SSH_NET' WHEN 6 THEN 'ENUM_HINT' END END"""


@query(
    "parse_packet_hint",
    f"""SELECT event_id AS line_id, 'NET_HINT' AS kind, {_HINT} AS hint, CASE WHEN k % 9 NOT IN (0, 1) THEN src_ip END AS src_ip,
          CASE k % 9 WHEN 2 THEN '224.0.0.251' WHEN 3 THEN '10.0.0.9' WHEN 4 THEN '10.0.0.9' WHEN 5 THEN '10.0.0.53' WHEN 6 THEN '10.0.0.255'
            WHEN 7 THEN '10.0.0.9' WHEN 8 THEN '10.0.0.53' END AS dst_ip
        FROM raw WHERE {_HINT} IS NOT NULL""",
)
def parse_packet_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.packet_lines(spark, sf_dir)
    return pa.parse_lines(lines, "net", YEAR, event_id="line_id").select(
        F.col("event_id").alias("line_id"), "kind", F.col("meta.hint").alias("hint"), "src_ip", "dst_ip"
    )


@query(
    "parse_network_identity",
    """SELECT event_id AS line_id, src_ip AS ip, 'seen' AS attribute, NULL AS value FROM raw WHERE k % 9 = 0
       UNION ALL SELECT event_id, src_ip, 'mac', 'aa:bb:cc:00:00:0' || (k % 10) FROM raw WHERE k % 9 = 1
       UNION ALL SELECT event_id, src_ip, 'service', 'http' || (k % 3) FROM raw WHERE k % 9 = 2
       UNION ALL SELECT event_id, src_ip, 'service', 'ssh' FROM raw WHERE k % 9 = 4 AND false
       UNION ALL SELECT event_id, src_ip, 'hostname', 'host' || (k % 4) || '.example.com' FROM raw WHERE k % 9 = 5
       UNION ALL SELECT event_id, src_ip, 'service', 'smb' FROM raw WHERE k % 9 = 6
       UNION ALL SELECT event_id, src_ip, 'hostname', '_srv' || (k % 2) || '.in-addr.arpa' FROM raw WHERE k % 9 = 8""",
)
def parse_network_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = pa.network_identity(F.col("line"), F.col("src_ip"))
    return fx.packet_lines(spark, sf_dir).select("line_id", F.explode(facts).alias("f")).select(
        "line_id", "f.ip", "f.attribute", "f.value"
    )


@query(
    "extract_event_time",
    "SELECT event_id, us - us % 1000000 AS us FROM sec",
)
def extract_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.log_lines(spark, sf_dir).select(
        "event_id", F.unix_micros(pa.event_time(F.col("line"), YEAR)).alias("us")
    )


@query(
    "union_sources",
    f"""SELECT event_id, 'auth' AS source, kind FROM sec WHERE {_SSH}
        UNION ALL SELECT event_id, 'nginx', {_WEB_KIND} FROM {_WEB} WHERE {_WEB_KIND} IS NOT NULL
        UNION ALL SELECT event_id, 'mysql', kind FROM sec WHERE source = 'mysql' AND k % 9 <> 0
        UNION ALL SELECT event_id, 'ufw', CASE WHEN kind = 'FW_HONEYPOT_PORT' AND k % 7 <> 0 THEN kind ELSE 'FW_BLOCK' END
          FROM sec WHERE source = 'ufw' AND k % 11 <> 0
        UNION ALL SELECT event_id, 'syslog', kind FROM sec WHERE source = 'syslog' AND (kind = 'SUDO_FAIL' OR k % 5 <> 0)""",
)
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pa.parse_mixed(fx.log_lines(spark, sf_dir), YEAR).select("event_id", "source", "kind")


@query(
    "read_audit_jsonl",
    """SELECT event_id, src_ip AS ip, k AS fail_count, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "time"
       FROM raw WHERE event_type = 'error' AND k % 2 = 0""",
)
def read_audit_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = audit.parse_audit(fx.audit_lines(spark, sf_dir), "line", fx.AUDIT_PAYLOAD)
    return records.filter(
        (F.col("type") == "incident") & (F.col("payload.severity") == "HIGH")
    ).select("event_id", "payload.ip", "payload.fail_count", "time")


@query(
    "ip_validity",
    """SELECT event_id, shape, CASE k % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false ELSE true END AS valid
       FROM (SELECT event_id, k, CASE k % 6 WHEN 0 THEN src_ip WHEN 1 THEN src_ip || '.9' WHEN 2 THEN '256.' || (k % 7) || '.0.1'
               WHEN 3 THEN 'fe80::' || k || '%eth0' WHEN 4 THEN 'host-' || k ELSE '::ffff:' || src_ip END AS shape FROM raw)""",
)
def ip_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, ip = F.col("k"), F.col("src_ip")
    shape = (
        F.when(k % 6 == 0, ip)
        .when(k % 6 == 1, F.concat(ip, F.lit(".9")))
        .when(k % 6 == 2, F.concat(F.lit("256."), k % 7, F.lit(".0.1")))
        .when(k % 6 == 3, F.concat(F.lit("fe80::"), k, F.lit("%eth0")))
        .when(k % 6 == 4, F.concat(F.lit("host-"), k))
        .otherwise(F.concat(F.lit("::ffff:"), ip))
    )
    return fx.raw_events(spark, sf_dir).select("event_id", shape.alias("shape")).select(
        "event_id", "shape", ipf.is_valid_ip(F.col("shape")).alias("valid")
    )


@query(
    "ip_classify_private",
    f"""SELECT event_id, ip, n BETWEEN 167772160 AND 184549375 OR n BETWEEN 2886729728 AND 2887778303 OR n BETWEEN 3232235520 AND 3232301055
          OR n BETWEEN 2130706432 AND 2147483647 OR n BETWEEN 2851995648 AND 2852061183 AS private
        FROM (SELECT event_id, (CASE k % 5 WHEN 0 THEN 10 WHEN 1 THEN 172 WHEN 2 THEN 192 WHEN 3 THEN 127 ELSE 169 END) || '.' ||
                (CASE k % 5 WHEN 1 THEN 10 + k % 30 WHEN 2 THEN 168 WHEN 4 THEN 253 + k % 3 ELSE k END) || '.' || (user_id % 256) || '.1' AS ip,
              (CASE k % 5 WHEN 0 THEN 10 WHEN 1 THEN 172 WHEN 2 THEN 192 WHEN 3 THEN 127 ELSE 169 END) * 16777216::BIGINT +
                (CASE k % 5 WHEN 1 THEN 10 + k % 30 WHEN 2 THEN 168 WHEN 4 THEN 253 + k % 3 ELSE k END) * 65536 + (user_id % 256) * 256 + 1 AS n FROM raw)""",
)
def ip_classify_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    first = F.element_at(F.array(*[F.lit(n) for n in (10, 172, 192, 127, 169)]), k % 5 + 1)
    second = (
        F.when(k % 5 == 1, 10 + k % 30).when(k % 5 == 2, 168).when(k % 5 == 4, 253 + k % 3).otherwise(k)
    )
    ip = F.concat(first, F.lit("."), second, F.lit("."), F.col("user_id") % 256, F.lit(".1"))
    return fx.raw_events(spark, sf_dir).select("event_id", ip.alias("ip")).select(
        "event_id", "ip", ipf.is_private(F.col("ip")).alias("private")
    )


@query(
    "country_flag",
    """SELECT n_nationkey, chr(127462 + n_nationkey % 26) || chr(127462 + n_regionkey) AS flag,
         CASE WHEN length(n_name) = 2 THEN n_name ELSE chr(127760) END AS other FROM nation""",
)
def country_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.array(*[F.lit(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"])
    code = F.concat(
        F.element_at(letters, F.col("n_nationkey") % 26 + 1), F.element_at(letters, F.col("n_regionkey") + 1)
    )
    return fx.read_table(spark, sf_dir, "nation").select(
        "n_nationkey", sc.country_flag(code).alias("flag"), sc.country_flag(F.col("n_name")).alias("other")
    )


@query("iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM raw")
def iso_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.raw_events(spark, sf_dir).select("event_id", sc.iso_time(F.col("ts")).alias("iso"))


@query(
    "time_ago_bucket",
    f"""SELECT event_id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago'
          WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS ago
        FROM (SELECT event_id, ({AS_OF_US} - us) // 1000000 // CASE WHEN k % 2 = 0 THEN 1000 ELSE 1 END AS s FROM raw)""",
)
def time_ago_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.floor(
        F.floor((F.lit(AS_OF_US) - F.col("us")) / 1_000_000) / F.when(F.col("k") % 2 == 0, 1000).otherwise(1)
    )
    return fx.raw_events(spark, sf_dir).select("event_id", sc.time_ago(age).alias("ago"))


@query("severity_filter", "SELECT event_id, severity FROM rinc WHERE severity IN ('MEDIUM', 'HIGH')")
def severity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.report_incidents(spark, sf_dir)
    return rows.filter(sc.at_least(F.col("severity"), "MEDIUM")).select("event_id", "severity")


@query(
    "file_severity",
    """SELECT path, severity FROM fim_changes""",
)
def file_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = fx.fim_baseline(spark, sf_dir).select("path").unionByName(
        fx.fim_current(spark, sf_dir).select("path")
    )
    return paths.distinct().select("path", sc.file_severity(F.col("path")).alias("severity"))


@query(
    "escape_markup",
    r"""SELECT event_id, regexp_replace(reason1 || '*' || isp || '[`]', '([_*`\[])', '\\\1', 'g') AS text FROM rinc""",
)
def escape_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("reasons")[0], F.lit("*"), "isp", F.lit("[`]"))
    return fx.report_incidents(spark, sf_dir).select("event_id", mk.escape_markup(text).alias("text"))


def _esc(column: str) -> str:
    return rf"regexp_replace({column}, '([_*`\[])', '\\\1', 'g')"


@query(
    "render_alert",
    f"""SELECT event_id, concat_ws(chr(10), '*ALERT — ' || severity || '*', '',
          'IP:       `' || src_ip || '`' || CASE WHEN proxy THEN ' [PROXY/VPN]' ELSE '' END || CASE WHEN hosting THEN ' [DATACENTER]' ELSE '' END,
          'Location: ' || {_esc('country')} || CASE WHEN city <> '' THEN ', ' || {_esc('city')} ELSE '' END,
          CASE WHEN isp <> '' THEN 'ISP:      ' || {_esc('isp')} ELSE '' END, '', 'Stats:',
          '  Fails:        ' || fail_count || ' (window: 86400s)', '  Unique users: ' || uniq_users, '', 'Reasons:',
          '  - ' || {_esc('reason1')}, '  - ' || {_esc('reason2')}, '',
          'Time: ' || strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%SZ')) AS body FROM rinc""",
)
def render_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.report_incidents(spark, sf_dir)
    return rows.select("event_id", ob.rendered(rows, "text", 86_400).alias("body"))


@query(
    "render_payload",
    """SELECT event_id, '{"type":"security_alert","time":"' || iso || '","ip":"' || src_ip || '","severity":"' || severity || '","reasons":["' || reason1 || '","' || reason2
         || '"],"fail_count":' || fail_count || ',"geo":{"country":"' || country || '","city":"' || city || '","isp":"' || isp || '","proxy":' || proxy || ',"hosting":' || hosting || '}}' AS webhook,
         '{"embeds":[{"title":"Alert — ' || severity || '","color":' || CASE severity WHEN 'HIGH' THEN 16711680 WHEN 'MEDIUM' THEN 16747520 ELSE 3447003 END
         || ',"fields":[{"name":"IP","value":"`' || src_ip || '`","inline":true},{"name":"Location","value":"' || country || '","inline":true},{"name":"Failed Logins","value":"'
         || fail_count || '","inline":true},{"name":"Unique Users","value":"' || uniq_users || '","inline":true},{"name":"Reasons","value":"- ' || reason1 || '\\n- ' || reason2
         || '"}],"footer":{"text":"' || iso || '"}}]}' AS embed
       FROM (SELECT *, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM rinc)""".replace("\\\\n", "\\n"),
)
def render_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.report_incidents(spark, sf_dir)
    return rows.select(
        "event_id",
        ob.rendered(rows, "json", 86_400).alias("webhook"),
        ob.rendered(rows, "embed", 86_400).alias("embed"),
    )


CHANNELS = (ob.Channel("chat", "text"), ob.Channel("hook", "json"), ob.Channel("off", "text", enabled=False))


@query(
    "route_channels",
    """SELECT src_ip, us, severity, channel FROM rinc, (SELECT unnest(['chat', 'hook']) AS channel) WHERE severity IN ('MEDIUM', 'HIGH')""",
)
def route_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ob.route_channels(fx.report_incidents(spark, sf_dir), CHANNELS).select(
        "src_ip", "us", "severity", "channel"
    )


@query(
    "ipv4_to_long",
    f"SELECT DISTINCT src_ip, {BASE} + user_id AS n, {BASE} + user_id - user_id % 64 AS net26 FROM raw",
)
def ipv4_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ipf.ipv4_to_long(F.col("src_ip"))
    return fx.raw_events(spark, sf_dir).select("src_ip").distinct().select(
        "src_ip", n.alias("n"), ipf.network_of(n, 26).alias("net26")
    )
