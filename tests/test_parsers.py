"""Parsers on literal lines."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seclog.sources import parsers as pa


def parse(spark, source, lines):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "event_id long, line string")
    rows = {r.event_id: r for r in pa.parse_lines(df, source, 2026).collect()}
    return [rows.get(i) for i in range(len(lines))]


def test_sshd(spark):
    mail = "Mar 22 07:41:"
    lines = [
        mail + "03 mx7 sshd[881]: Failed password for deploy from 203.0.113.77 port 51022 ssh2",
        mail + "04 mx7 sshd[881]: Failed password for invalid user oracle from 198.51.100.9 port 4021 ssh2",
        "Mar  2 23:59:58 mx7 sshd[90]: Accepted password for lena from 192.0.2.14 port 60001 ssh2",
        mail + "05 mx7 sshd[90]: Accepted publickey for backup from 2001:db8:7::aa port 2200 ssh2",
        mail + "06 mx7 sshd[90]: pam_unix(sshd:auth): authentication failure; rhost=203.0.113.4",
        "2026-02-11T21:15:40+02:00 edge3 sshd-session[555]: Failed password for mika from fe80::5 port 7 ssh2",
        "2026-02-11T21:15:59+02:00 edge3 sshd-session[556]: Accepted password for mika from 192.0.2.200 port 8 ssh2",
        mail + "07 mx7 kernel: link up, peer 203.0.113.4",
        "",
        mail + "08 mx7 sshd[90]: Connection closed by authenticating user lena 203.0.113.4 port 1 [preauth]",
        mail + "09 mx7 sshd[91]: FAILED PASSWORD for Lena from ::ffff:203.0.113.9 port 3",
        mail + "10 mx7 sshd[91]: Failed password for Accepted from 203.0.113.66 port 2",
    ]
    got = parse(spark, "auth", lines)
    assert [(r.kind, r.src_ip, r.user) if r else None for r in got] == [
        ("SSH_FAIL", "203.0.113.77", "deploy"),
        ("SSH_FAIL", "198.51.100.9", "oracle"),
        ("SSH_SUCCESS", "192.0.2.14", "lena"),
        ("SSH_SUCCESS", "2001:db8:7::aa", "backup"),
        None,  # the prefix must be followed by the failure text
        ("SSH_FAIL", "fe80::5", "mika"),
        ("SSH_SUCCESS", "192.0.2.200", "mika"),
        None,
        None,
        None,
        ("SSH_FAIL", "::ffff:203.0.113.9", "Lena"),
        ("SSH_FAIL", "203.0.113.66", "Accepted"),
    ]
    assert got[2].ts == dt.datetime(2026, 3, 2, 23, 59, 58)
    assert got[5].ts == dt.datetime(2026, 2, 11, 19, 15, 40)
    assert (got[0].host, got[5].host) == ("mx7", "edge3")


def test_sshd_failure_without_user(spark):
    line = "Mar 22 07:41:11 mx7 sshd[92]: authentication failure; uid=0 tty=ssh rhost=198.51.100.31"
    (r,) = parse(spark, "auth", [line])
    assert (r.kind, r.src_ip, r.user) == ("SSH_FAIL", "198.51.100.31", None)


def web(request, status, agent='"Mozilla/5.0"', ident="- -"):
    return f'1.2.3.4 {ident} [01/Jan/2025:00:00:01 +0000] "{request} HTTP/1.1" {status} 12 "-" {agent}'


def test_web_kinds_and_scores(spark):
    lines = [
        web("GET /x", 401), web("GET /x", 403), web("GET /x", 404), web("GET /x", 200),
        web("GET /.env", 200), web("POST /wp-login.php", 401), web("GET /x", 200, '"sqlmap/1.7"'),
        web("GET /x", 404, '"curl/8.1"'), web("GET /x", 404, ident="- alice"),
        '1.2.3.4 - - [01/Jan/2025:00:00:01 +0000] "GET /a HTTP/1.1" 404 -',
        "prefix " + web("GET /x", 404), "  " + web("GET /A/.GIT/config", 500, '"NIKTO"'),
    ]
    got = parse(spark, "nginx", lines)
    assert [(r.kind, r.meta.threat_score) if r else None for r in got] == [
        ("WEB_AUTH_FAIL", 2), ("WEB_AUTH_FAIL", 2), ("WEB_SCAN", 1), None,
        ("WEB_EXPLOIT_ATTEMPT", 3), ("WEB_EXPLOIT_ATTEMPT", 7), ("WEB_SCAN", 2),
        ("WEB_SCAN", 3), None, ("WEB_SCAN", 1), None, ("WEB_EXPLOIT_ATTEMPT", 5),
    ]
    assert got[0].ts == dt.datetime(2025, 1, 1, 0, 0, 1)
    assert got[9].meta.ua == "" and got[5].meta.method == "POST" and got[5].meta.status == 401


def test_database_firewall_privilege(spark):
    (a, b) = parse(spark, "mysql", [
        "2025-01-01T00:00:00.000000Z 0 [Warning] Access denied for user 'root'@'1.2.3.4' (using password: YES)",
        "2025-01-01T00:00:00.000000Z 0 [Warning] Access denied for user ''@'1.2.3.4'",
    ])
    assert (a.kind, a.user, a.src_ip, a.meta.db) == ("DB_AUTH_FAIL", "root", "1.2.3.4", "mysql") and b is None
    head = "Jan  1 00:00:00 host kernel: "
    fw = parse(spark, "ufw", [
        head + "[UFW BLOCK] IN=eth0 SRC=1.2.3.4 DST=5.6.7.8 PROTO=TCP DPT=3389",
        head + "[UFW BLOCK] IN=eth0 SRC=1.2.3.4 DST=5.6.7.8 PROTO=ICMP",
        head + "[UFW ALLOW] IN=eth0 SRC=1.2.3.4 DST=5.6.7.8 DPT=23",
        head + "[ufw block] IN=eth0 SRC=1.2.3.4 DST=5.6.7.8 DPT=23",
    ])
    assert [(r.kind, r.meta.dst_port) if r else None for r in fw] == [
        ("FW_HONEYPOT_PORT", 3389), ("FW_BLOCK", 0), None, None,
    ]
    sys = parse(spark, "syslog", [
        "Mar  7 04:11:52 gate3 sudo: guest4 : user NOT in sudoers ; TTY=pts/0",
        "Mar  7 04:12:09 gate3 su[771]: FAILED su for admin2 by guest4",
        "Mar  7 04:12:30 gate3 sudo: pam_unix(sudo:auth): authentication failure; user=x",
        "Mar  7 04:13:01 gate3 cron[88]: nothing",
    ])
    assert [(r.kind, r.user, r.meta.target_user, r.src_ip) if r else None for r in sys] == [
        ("SUDO_FAIL", "guest4", None, None), ("SU_FAIL", "guest4", "admin2", None),
        ("SUDO_FAIL", None, None, None), None,
    ]


def test_packet_hints(spark):
    got = parse(spark, "net", [
        "ARP, Request who-has 172.20.4.9 tell 172.20.4.77, length 28",
        "IP 172.20.4.77.139 > 172.20.4.12.40400: Flags [P.]",
        "IP 203.0.113.5.8443 > 172.20.4.12.39000: Flags [R]",
        "IP 172.20.4.12.5000 > 203.0.113.5.53: domain query",
        "IP 172.20.4.31.5353 > 224.0.0.251.mdns: PTR",
    ])
    # a named port hides the addresses of a line
    assert [(r.meta.hint, r.src_ip, r.dst_ip) if r else None for r in got] == [
        ("DISCOVERY", None, None), ("ENUM_HINT", "172.20.4.77", "172.20.4.12"), None, None,
        ("DISCOVERY", None, None),
    ]


def test_custom_parser(spark):
    def parse_vpn(line):
        user = F.regexp_extract(line, r"vpn: denied (\S+) from (\S+)", 1)
        ip = F.regexp_extract(line, r"vpn: denied (\S+) from (\S+)", 2)
        return pa.event_struct(F.when(ip != "", "VPN_DENIED"), src_ip=ip, user=user)

    pa.register_parser("vpn", parse_vpn)
    try:
        hit, miss = parse(spark, "vpn", ["vpn: denied joe from 3.3.3.3", "vpn: ok"])
        assert (hit.kind, hit.user, hit.src_ip, miss) == ("VPN_DENIED", "joe", "3.3.3.3", None)
    finally:
        del pa.PARSERS["vpn"]


@pytest.mark.parametrize("line,want", [
    ("Feb 29 01:02:03 h x: y", dt.datetime(2024, 2, 29, 1, 2, 3)),
    ("2024-03-04T05:06:07.5+02:00 h x: y", dt.datetime(2024, 3, 4, 3, 6, 7, 500000)),
    ("no time here", None),
])
def test_event_time(spark, line, want):
    df = spark.createDataFrame([(line,)], "line string")
    assert df.select(pa.event_time(F.col("line"), 2024)).first()[0] == want
