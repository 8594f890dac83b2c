"""The fixtures and shared steps once more, as SQL for DuckDB to check against."""

from __future__ import annotations

import re

from seclog.plans.fixtures import AS_OF_US
from seclog.schema import ALL_KINDS, ALL_SOURCES

DAY = 86_400_000_000
BASE = 198 * 256**3 + 18 * 256**2
#: Kinds, then sources, with what each has in the window, where that is not zero; then the total.
_SEEN_7 = [(k, f"kind = '{k}'") for k in ALL_KINDS] + [(f"source:{s}", f"source = '{s}'") for s in ALL_SOURCES] + [("total", "true")]
_EVIDENCE_7 = "concat_ws(',', " + ", ".join(f"'{name}=' || nullif(count(*) FILTER ({where}) OVER d7, 0)" for name, where in _SEEN_7) + ")"

CTES = {
    "raw": """
      SELECT event_id, ts, epoch_us(ts) AS us, user_id, event_type,
             CAST(props->>'$.k' AS INTEGER) AS k,
             '198.18.' || (user_id // 256) || '.' || (user_id % 256) AS src_ip,
             'u' || (CAST(props->>'$.k' AS INTEGER) % 8) AS "user",
             'h' || (user_id % 4) AS host
      FROM events""",
    "sec0": """
      SELECT *, CASE event_type WHEN 'error' THEN 'SSH_FAIL' WHEN 'purchase' THEN 'SSH_SUCCESS'
                WHEN 'signup' THEN 'DB_AUTH_FAIL'
                WHEN 'view' THEN CASE k % 3 WHEN 0 THEN 'WEB_SCAN' WHEN 1 THEN 'WEB_AUTH_FAIL' ELSE 'WEB_EXPLOIT_ATTEMPT' END
                ELSE CASE k % 4 WHEN 0 THEN 'FW_HONEYPOT_PORT' WHEN 1 THEN 'FW_BLOCK' WHEN 2 THEN 'SUDO_FAIL' ELSE 'SU_FAIL' END
                END AS kind FROM raw""",
    "sec": """
      SELECT *, CASE WHEN kind LIKE 'SSH%' THEN 'auth' WHEN kind LIKE 'WEB%' THEN 'nginx'
                WHEN kind LIKE 'DB%' THEN 'mysql' WHEN kind LIKE 'FW%' THEN 'ufw' ELSE 'syslog' END AS source,
             CASE kind WHEN 'WEB_SCAN' THEN '/missing/' || k WHEN 'WEB_AUTH_FAIL' THEN '/account/' || k
                WHEN 'WEB_EXPLOIT_ATTEMPT' THEN '/wp-login.php?x=' || k END AS path,
             CASE kind WHEN 'WEB_SCAN' THEN 404 WHEN 'WEB_AUTH_FAIL' THEN 401 WHEN 'WEB_EXPLOIT_ATTEMPT' THEN 200 END AS status,
             CASE kind WHEN 'FW_HONEYPOT_PORT' THEN 23 WHEN 'FW_BLOCK' THEN 8080 END AS dst_port
      FROM sec0""",
    "cnt": f"""
      SELECT *, count(*) FILTER (kind = 'SSH_FAIL') OVER w AS ssh_fails,
             count(*) FILTER (kind = 'WEB_SCAN') OVER w AS web_scans,
             count(*) FILTER (kind = 'WEB_AUTH_FAIL') OVER w AS web_auth_fails,
             count(*) FILTER (kind = 'WEB_EXPLOIT_ATTEMPT') OVER w AS web_exploits,
             count(*) FILTER (kind = 'DB_AUTH_FAIL') OVER w AS db_fails,
             count(DISTINCT CASE WHEN kind = 'SSH_FAIL' THEN "user" END) OVER w AS uniq_users
      FROM sec WINDOW w AS (PARTITION BY src_ip ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)""",
    "cand0": """
      SELECT event_id, src_ip, us, kind, "user",
        CASE WHEN kind = 'SSH_FAIL' AND ssh_fails >= 3 THEN 'brute_force: ' || ssh_fails || ' fails in 86400s' END AS r1,
        CASE WHEN kind = 'SSH_FAIL' AND uniq_users >= 3 THEN 'credential_stuffing: ' || uniq_users || ' unique users in 86400s' END AS r2,
        CASE WHEN kind = 'SSH_SUCCESS' AND ssh_fails >= 2 THEN 'credential_breach: success after ' || ssh_fails || ' fails' END AS r3,
        CASE WHEN kind LIKE 'WEB%' AND web_scans >= 2 THEN 'web_scan_flood: ' || web_scans || ' scan events in 86400s' END AS r4,
        CASE WHEN kind LIKE 'WEB%' AND web_auth_fails >= 2 THEN 'web_auth_flood: ' || web_auth_fails || ' 401/403 in 86400s' END AS r5,
        CASE WHEN kind LIKE 'WEB%' AND web_exploits >= 1 THEN 'web_exploit_attempt: path=' || path END AS r6,
        CASE WHEN kind = 'DB_AUTH_FAIL' AND db_fails >= 3 THEN 'db_brute_force: ' || db_fails || ' DB auth failures (user=' || "user" || ')' END AS r7,
        CASE WHEN kind = 'FW_HONEYPOT_PORT' THEN 'honeypot_port: connection to port ' || dst_port || ' (never legitimate)' END AS r8,
        CASE WHEN kind LIKE 'SSH%' THEN ssh_fails WHEN kind LIKE 'WEB%' THEN web_scans + web_auth_fails + web_exploits
             WHEN kind LIKE 'DB%' THEN db_fails ELSE 1 END AS fail_count,
        CASE WHEN kind LIKE 'SSH%' THEN uniq_users ELSE 0 END AS uniq_users,
        CASE WHEN kind = 'SSH_FAIL' THEN 'fail' WHEN kind = 'SSH_SUCCESS' THEN 'success' WHEN kind LIKE 'WEB%' THEN 'web'
             WHEN kind LIKE 'DB%' THEN 'db' ELSE 'fw' END AS trigger
      FROM cnt WHERE kind NOT IN ('FW_BLOCK', 'SUDO_FAIL', 'SU_FAIL')""",
    "cand": """
      SELECT event_id, src_ip, us, kind, "user", fail_count, uniq_users, trigger,
             CASE WHEN r3 IS NOT NULL OR r8 IS NOT NULL THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
             concat_ws('; ', r1, r2, r3, r4, r5, r6, r7, r8) AS reasons
      FROM cand0 WHERE coalesce(r1, r2, r3, r4, r5, r6, r7, r8) IS NOT NULL""",
    "fired_at": f"""
      SELECT src_ip, min(us) AS us FROM cand GROUP BY src_ip
      UNION ALL
      SELECT f.src_ip, min(c.us) AS us FROM fired_at f JOIN cand c ON c.src_ip = f.src_ip AND c.us >= f.us + {2 * DAY}
      GROUP BY f.src_ip""",
    "fired": "SELECT c.* FROM cand c JOIN fired_at f ON c.src_ip = f.src_ip AND c.us = f.us",
    "inc0": f"""
      SELECT *, trigger = 'fail' AND count(*) OVER (PARTITION BY src_ip ORDER BY us
             RANGE BETWEEN {10 * DAY - 1} PRECEDING AND 1 PRECEDING) >= 3 AS repeat FROM fired""",
    "inc": """
      SELECT event_id, src_ip, us, kind, "user", fail_count, uniq_users, trigger,
             CASE WHEN repeat THEN 'HIGH' ELSE severity END AS severity,
             reasons || CASE WHEN repeat THEN '; repeat_offender: 3+ incidents in last hour' ELSE '' END AS reasons
      FROM inc0""",
    "corr_cnt": f"""
      SELECT src_ip, us,
        count(*) FILTER (kind = 'SSH_FAIL') OVER d5 AS ssh5, count(*) FILTER (kind = 'DB_AUTH_FAIL') OVER d5 AS db5,
        count(*) FILTER (kind = 'SSH_SUCCESS') OVER d5 AS ok5, count(*) FILTER (kind = 'SUDO_FAIL') OVER d5 AS sudo5,
        count(*) FILTER (kind = 'SU_FAIL') OVER d5 AS su5,
        count(*) FILTER (kind = 'WEB_SCAN') OVER d10 AS scan10, count(*) FILTER (kind = 'WEB_EXPLOIT_ATTEMPT') OVER d10 AS exp10,
        count(*) FILTER (kind = 'SSH_FAIL') OVER d10 AS ssh10,
        count(*) FILTER (kind = 'FW_HONEYPOT_PORT') OVER d3 AS hp3, count(*) FILTER (kind = 'SSH_FAIL') OVER d3 AS ssh3,
        count(*) FILTER (kind = 'WEB_AUTH_FAIL') OVER d2 AS auth2,
        count(DISTINCT source) OVER d7 AS sources7, count(DISTINCT kind) OVER d7 AS kinds7, count(*) OVER d7 AS n7,
        {_EVIDENCE_7} AS evidence7
      FROM sec WINDOW
        d2 AS (PARTITION BY src_ip ORDER BY us RANGE BETWEEN {2 * DAY - 1} PRECEDING AND CURRENT ROW),
        d3 AS (PARTITION BY src_ip ORDER BY us RANGE BETWEEN {3 * DAY - 1} PRECEDING AND CURRENT ROW),
        d5 AS (PARTITION BY src_ip ORDER BY us RANGE BETWEEN {5 * DAY - 1} PRECEDING AND CURRENT ROW),
        d7 AS (PARTITION BY src_ip ORDER BY us RANGE BETWEEN {7 * DAY - 1} PRECEDING AND CURRENT ROW),
        d10 AS (PARTITION BY src_ip ORDER BY us RANGE BETWEEN {10 * DAY - 1} PRECEDING AND CURRENT ROW)""",
    "corr": """
      SELECT src_ip, us, 'multi_service_brute_force' AS rule, CAST(0.85 AS DOUBLE) AS confidence, 'HIGH' AS severity,
        'Credential spray: ' || ssh5 || ' SSH fails + ' || db5 || ' DB fails in 432000s' AS description,
        'SSH_FAIL=' || ssh5 || ',DB_AUTH_FAIL=' || db5 AS evidence
        FROM corr_cnt WHERE ssh5 >= 3 AND db5 >= 2
      UNION ALL SELECT src_ip, us, 'web_recon_then_ssh', 0.80, 'HIGH',
        'Coordinated attack: ' || scan10 || ' web scans, ' || exp10 || ' exploit attempts, ' || ssh10 || ' SSH fails',
        'WEB_SCAN=' || scan10 || ',WEB_EXPLOIT_ATTEMPT=' || exp10 || ',SSH_FAIL=' || ssh10
        FROM corr_cnt WHERE scan10 + exp10 >= 5 AND ssh10 >= 3
      UNION ALL SELECT src_ip, us, 'honeypot_then_ssh', 0.90, 'HIGH',
        'Automated scanner: hit honeypot port(s) then tried SSH', 'FW_HONEYPOT_PORT=' || hp3 || ',SSH_FAIL=' || ssh3
        FROM corr_cnt WHERE hp3 >= 1 AND ssh3 >= 1
      UNION ALL SELECT src_ip, us, 'web_auth_flood', 0.75, 'MEDIUM',
        'Web auth flood: ' || auth2 || ' 401/403 responses in 172800s', 'WEB_AUTH_FAIL=' || auth2
        FROM corr_cnt WHERE auth2 >= 2
      UNION ALL SELECT src_ip, us, 'privilege_escalation', 0.85, 'HIGH',
        'Privilege escalation after login: ' || sudo5 || ' sudo fails, ' || su5 || ' su fails',
        'SSH_SUCCESS=' || ok5 || ',SUDO_FAIL=' || sudo5 || ',SU_FAIL=' || su5
        FROM corr_cnt WHERE ok5 >= 1 AND sudo5 + su5 >= 2
      UNION ALL SELECT src_ip, us, 'persistent_recon', 0.70, 'MEDIUM',
        'Persistent recon: ' || n7 || ' events across ' || sources7 || ' sources, ' || kinds7 || ' attack types in 30min', evidence7
        FROM corr_cnt WHERE sources7 >= 3 AND kinds7 >= 4 AND n7 >= 20""",
    "corr_at": f"""
      SELECT src_ip, rule, min(us) AS us FROM corr GROUP BY src_ip, rule
      UNION ALL
      SELECT f.src_ip, f.rule, min(c.us) AS us FROM corr_at f
      JOIN corr c ON c.src_ip = f.src_ip AND c.rule = f.rule AND c.us >= f.us + {2 * DAY}
      GROUP BY f.src_ip, f.rule""",
    "corr_kept": "SELECT c.* FROM corr c JOIN corr_at f ON c.src_ip = f.src_ip AND c.rule = f.rule AND c.us = f.us",
    "logins": f"""
      SELECT event_id, src_ip, "user", us, CAST(us // 3600000000 % 24 AS INTEGER) AS hour, us // {DAY} AS day
      FROM sec WHERE kind = 'SSH_SUCCESS'""",
    "login_prior": """
      SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY us, event_id) - 1 AS prior,
             row_number() OVER (PARTITION BY src_ip, hour ORDER BY us, event_id) - 1 AS hour_prior,
             row_number() OVER (PARTITION BY src_ip, "user" ORDER BY us, event_id) - 1 AS user_prior,
             row_number() OVER (PARTITION BY src_ip, day ORDER BY us, event_id) - 1 AS day_prior
      FROM logins""",
    "login_days": """
      SELECT src_ip, day, count(n) OVER b AS earlier_days, coalesce(sum(n) OVER b, 0) AS earlier_logins
      FROM (SELECT src_ip, day, count(*) AS n FROM logins GROUP BY src_ip, day)
      WINDOW b AS (PARTITION BY src_ip ORDER BY day ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""",
    "login_seq": """
      SELECT *, lag(us) OVER w AS previous_us, lag(day) OVER w AS previous_day, coalesce(lag(day_prior) OVER w + 1, 0) AS today_count,
             count(*) FILTER (user_prior = 0) OVER p AS known_users,
             list_sort(list(CASE WHEN hour_prior = 1 THEN hour END) OVER p) AS usual0
      FROM login_prior WINDOW w AS (PARTITION BY src_ip ORDER BY us, event_id),
        p AS (PARTITION BY src_ip ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "login_hist": """
      SELECT s.*, list_filter(usual0, lambda x: x IS NOT NULL) AS usual,
             coalesce(d.earlier_days, 0) AS earlier_days, coalesce(d.earlier_logins, 0) AS earlier_logins
      FROM login_seq s LEFT JOIN login_days d ON s.src_ip = d.src_ip AND s.previous_day = d.day""",
    "geo": f"""
      SELECT {BASE} + n_nationkey * 64 AS lo, {BASE} + n_nationkey * 64 + 63 AS hi, 26 AS prefix_len, n_name AS country,
             substr(n_name, 1, 1) || chr(65 + n_nationkey) AS country_code, 'city' || n_nationkey AS city, 'isp' || (n_nationkey % 5) AS isp
      FROM nation
      UNION ALL SELECT {BASE}, {BASE} + 4095, 20, 'Wideland', 'WL', '', 'wide'""",
    "ips": "SELECT DISTINCT src_ip, user_id FROM raw",
    "ip_geo": f"""
      SELECT src_ip, coalesce(g.country, 'Unknown') AS country, coalesce(g.country_code, '??') AS country_code,
             coalesce(g.city, '') AS city, coalesce(g.isp, '') AS isp,
             CASE WHEN g.country IS NULL THEN chr(127760)
                  ELSE chr(127397 + ascii(g.country_code)) || chr(127397 + ascii(substr(g.country_code, 2, 1))) END AS flag
      FROM ips LEFT JOIN geo g ON {BASE} + user_id BETWEEN g.lo AND g.hi
      QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY g.prefix_len DESC) = 1""",
    "rep": f"""
      SELECT '198.18.' || (c_custkey // 256) || '.' || (c_custkey % 256) AS ip, CAST(c_custkey % 101 AS INTEGER) AS abuse_score,
             CAST(c_custkey % 17 AS INTEGER) AS total_reports, 'net' || (c_custkey % 5) AS isp, c_custkey % 7 <> 0 AS is_public,
             {AS_OF_US} - c_custkey % 40 * 3600000000 AS fetched_us
      FROM customer""",
    "allow": f"""
      SELECT {BASE} + s_suppkey * 3 AS lo, {BASE} + s_suppkey * 3 AS hi FROM supplier
      UNION ALL SELECT {BASE} + 64, {BASE} + 79""",
    "allowed": f"SELECT DISTINCT src_ip FROM ips JOIN allow ON {BASE} + user_id BETWEEN lo AND hi",
    "req": "SELECT src_ip AS ip, us, event_id AS request_id, reasons AS reason FROM inc WHERE severity = 'HIGH'",
    "block_at": f"""
      SELECT ip, min(us) AS us FROM req GROUP BY ip
      UNION ALL SELECT b.ip, min(r.us) FROM block_at b JOIN req r ON r.ip = b.ip AND r.us >= b.us + {15 * DAY} GROUP BY b.ip""",
    "blocks": f"""
      SELECT r.ip, r.us AS start_us, r.us + {15 * DAY} AS end_us, r.reason FROM req r JOIN block_at b ON r.ip = b.ip AND r.us = b.us""",
    "lifts": "SELECT src_ip AS ip, us, event_id AS request_id FROM raw WHERE event_type = 'view' AND k % 10 = 3",
    "req_epoch": """
      SELECT r.*, (SELECT count(*) FROM lifts l WHERE l.ip = r.ip AND (l.us < r.us OR (l.us = r.us AND l.request_id <= r.request_id))) AS epoch
      FROM req r""",
    "epoch_at": f"""
      SELECT ip, epoch, min(us) AS us FROM req_epoch GROUP BY ip, epoch
      UNION ALL SELECT b.ip, b.epoch, min(r.us) FROM epoch_at b
      JOIN req_epoch r ON r.ip = b.ip AND r.epoch = b.epoch AND r.us >= b.us + {15 * DAY} GROUP BY b.ip, b.epoch""",
    "port_req": "SELECT src_ip AS ip, us FROM sec WHERE kind = 'FW_HONEYPOT_PORT'",
    "port_at": f"""
      SELECT ip, min(us) AS us FROM port_req GROUP BY ip
      UNION ALL SELECT h.ip, min(q.us) FROM port_at h JOIN port_req q ON q.ip = h.ip AND q.us >= h.us + {5 * DAY} GROUP BY h.ip""",
    "msgs": """
      SELECT src_ip AS ip, us, event_id AS message_id, CASE WHEN k % 5 = 0 THEN 'unblock' ELSE 'block' END AS action,
             CASE WHEN k % 3 <> 0 THEN 'r' || (k % 4) END AS reason, CASE WHEN k % 2 = 0 THEN 432000 END AS ttl,
             'n' || (user_id % 3) AS node_id FROM raw""",
    "fim_old": f"""
      SELECT CASE doc_id % 8 WHEN 0 THEN '/etc/passwd' WHEN 1 THEN '/etc/cron.d/job' WHEN 2 THEN '/home/a/.ssh/authorized_keys'
             WHEN 3 THEN '/var/log/app' WHEN 4 THEN '/etc/hosts' WHEN 5 THEN '/opt/data' WHEN 6 THEN '/etc/sudoers.d/x'
             ELSE '/usr/bin/sudo' END || '.' || doc_id AS path,
             sha256(text) AS hash, n_chars AS size, {AS_OF_US - DAY} AS mtime, '0o100644' AS mode,
             {AS_OF_US - 9 * DAY} AS first_seen_us, {AS_OF_US - 2 * DAY} AS last_seen_us
      FROM documents WHERE doc_id % 10 <> 0 OR doc_id % 70 = 0""",
    "fim_new": f"""
      SELECT CASE doc_id % 8 WHEN 0 THEN '/etc/passwd' WHEN 1 THEN '/etc/cron.d/job' WHEN 2 THEN '/home/a/.ssh/authorized_keys'
             WHEN 3 THEN '/var/log/app' WHEN 4 THEN '/etc/hosts' WHEN 5 THEN '/opt/data' WHEN 6 THEN '/etc/sudoers.d/x'
             ELSE '/usr/bin/sudo' END || '.' || doc_id AS path,
             CASE WHEN doc_id % 23 <> 0 THEN sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) END AS hash,
             n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS size, {AS_OF_US} AS mtime,
             CASE WHEN doc_id % 11 = 0 THEN '0o100777' ELSE '0o100644' END AS mode
      FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 70 = 0""",
    "fim_pair": """
      SELECT coalesce(o.path, n.path) AS path, o.path IS NOT NULL AS had, n.path IS NOT NULL AS has,
             o.hash AS old_hash, n.hash AS new_hash, o.mode AS old_mode, n.mode AS new_mode, o.size AS old_size, n.size AS new_size,
             o.mtime AS old_mtime, n.mtime AS new_mtime, o.first_seen_us, o.last_seen_us
      FROM fim_old o FULL JOIN fim_new n ON o.path = n.path""",
    "fim_changes": """
      SELECT *, CASE WHEN NOT had THEN CASE WHEN new_hash IS NOT NULL THEN 'created' END WHEN NOT has THEN 'deleted'
             WHEN new_hash IS NULL THEN NULL WHEN new_hash <> old_hash THEN 'modified' WHEN new_mode <> old_mode THEN 'permission' END AS change,
             CASE WHEN path LIKE '/etc/passwd%' OR path LIKE '/etc/sudoers%' OR path LIKE '%authorized_keys%' THEN 'CRITICAL'
                  WHEN path LIKE '/etc/cron.d%' OR path LIKE '/etc/hosts%' OR path LIKE '/usr/bin/sudo%' THEN 'HIGH' ELSE 'MEDIUM' END AS severity
      FROM fim_pair""",
    "fim_alerts": "SELECT * FROM fim_changes WHERE change IS NOT NULL",
    "trust0": """
      SELECT src_ip, min(CASE WHEN kind = 'SSH_SUCCESS' THEN us END) AS ok_us,
             (list(us ORDER BY us) FILTER (kind = 'SSH_FAIL'))[3] AS third_us FROM sec GROUP BY src_ip""",
    "trust": f"""
      SELECT t.src_ip, CASE WHEN t.src_ip IN (SELECT ip FROM blocks WHERE start_us <= {AS_OF_US} AND end_us > {AS_OF_US}) THEN 'attacker'
             WHEN t.src_ip IN (SELECT src_ip FROM allowed) THEN 'allowlisted'
             WHEN third_us IS NOT NULL AND (ok_us IS NULL OR third_us < ok_us) THEN 'suspicious'
             WHEN ok_us IS NOT NULL THEN 'known' ELSE 'unknown' END AS trust FROM trust0 t""",
    "decoy": """
      SELECT src_ip AS ip, us, event_id AS record_id,
             CASE event_type WHEN 'signup' THEN 'honeypot_connection' WHEN 'error' THEN 'honeypot_credentials'
                  WHEN 'click' THEN 'honeypot_session_end' ELSE 'honeypot_command' END AS type,
             CASE WHEN event_type = 'error' THEN 'root' || (k % 3) END AS username,
             CASE WHEN event_type = 'error' THEN 'pw' || (k % 5) END AS password,
             CASE WHEN event_type IN ('view', 'purchase') THEN
                  CASE k % 4 WHEN 0 THEN 'ls -la' WHEN 1 THEN '  wget http://x/y' WHEN 2 THEN 'cat f' || k ELSE 'LS' END END AS command
      FROM raw""",
    "decoy_open": f"""
      SELECT *, CASE WHEN coalesce(us - lag(us) OVER (PARTITION BY ip ORDER BY us, record_id) >= {DAY}, true) THEN us END AS opens FROM decoy""",
    "decoy_session": """
      SELECT *, max(opens) OVER (PARTITION BY ip ORDER BY us, record_id ROWS UNBOUNDED PRECEDING) AS session_us FROM decoy_open""",
    "rinc": """
      SELECT event_id, src_ip, us, CASE WHEN kind IN ('FW_HONEYPOT_PORT', 'SSH_SUCCESS') THEN 'HIGH'
             WHEN kind IN ('SUDO_FAIL', 'SU_FAIL') THEN 'LOW' ELSE 'MEDIUM' END AS severity,
             kind || ' by ' || "user" AS reason1, 'k_' || k AS reason2, CAST(k AS BIGINT) AS fail_count, CAST(k % 5 AS BIGINT) AS uniq_users,
             CASE WHEN kind = 'SSH_SUCCESS' THEN 'success' WHEN kind LIKE 'FW%' THEN 'fw' ELSE 'fail' END AS trigger,
             'land_' || (k % 9) AS country, CASE WHEN k % 2 = 0 THEN 'town' || (k % 6) ELSE '' END AS city,
             CASE WHEN k % 3 = 0 THEN '' ELSE 'isp*' || (k % 4) END AS isp, k % 4 = 0 AS proxy, k % 6 = 0 AS hosting
      FROM sec WHERE kind <> 'FW_BLOCK'""",
}
_REUSED = {"cand", "corr", "req", "req_epoch", "fired", "port_req"}  # read again on every step of a recursion


def sql(body: str, own: dict[str, str] | None = None) -> str:
    """``body`` with the named steps it uses, directly or not, in front; ``own`` adds steps or replaces them."""
    known = {**CTES, **(own or {})}
    needed: list[str] = []

    def visit(text: str, inside: str | None = None) -> None:
        for name, step in known.items():
            if name != inside and name not in needed and re.search(rf"\b{name}\b", text):
                visit(step, name)
                needed.append(name)

    visit(body)
    if not needed:
        return body
    steps = ",\n".join(
        f"{n} AS {'MATERIALIZED ' if n in _REUSED else ''}({known[n]})" for n in needed
    )
    return f"WITH RECURSIVE {steps}\n{body}"
