"""Scalar functions against the standard library and edge cases."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from seclog import config
from seclog.functions import ip as ipf
from seclog.functions import markup as mk
from seclog.functions import scalar as sc
from seclog.operators import baseline, blocks, detect, iforest
from seclog.operators.enrich import (
    flat_networks, geo_enrich, geo_lookup, geo_lookup_by_range, innermost_networks, matching_networks, outside_networks,
    outside_networks_by_range,
)
from seclog.sources.tables import no_networks, with_network

ADDRESSES = [
    "1.2.3.4", "255.255.255.255", "256.1.1.1", "1.2.3", "1.2.3.4.5", "01.2.3.4", "", " 1.2.3.4", "a.b.c.d",
    "10.0.0.1", "172.15.255.255", "172.16.0.0", "172.31.255.255", "172.32.0.0", "192.168.255.1", "127.0.0.1",
    "169.254.1.1", "169.253.1.1", "11.0.0.1",
    "::", "::1", "1::", "fe80::1", "FC00::1", "fdff::", "fbff::1", "fe00::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7",
    "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", ":1", "1:", "12345::", "g::1", "::ffff:10.0.0.1", "::ffff:256.0.0.1",
    "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "0:0:0:0:0:0:0:1",
    "fe80::1%eth0", "fc00::1%1",
]
PRIVATE = [ipaddress.ip_network(n) for n in (
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "::1/128", "fc00::/7", "169.254.0.0/16")]


def valid(text):
    try:
        ipaddress.ip_address(text)
        return True
    except ValueError:
        return False


def private(text):
    try:
        a = ipaddress.ip_address(text.split("%")[0])
    except ValueError:
        return False
    return any(a in n for n in PRIVATE if n.version == a.version)


def test_addresses_like_the_standard_library(spark):
    df = spark.createDataFrame([(a,) for a in ADDRESSES], "ip string")
    rows = df.select("ip", ipf.is_valid_ip(F.col("ip")).alias("v"), ipf.is_private(F.col("ip")).alias("p")).collect()
    assert [(r.ip, r.v) for r in rows] == [(a, valid(a)) for a in ADDRESSES]
    assert [(r.ip, r.p) for r in rows] == [(a, private(a)) for a in ADDRESSES]


NETWORKS = [
    "10.1.2.3/8", "1.2.3.4", "x", "1.2.3.4/40", "1.2.3.4/x", "1.2.3.4/8/9", "0.0.0.0/0", "2001:db8:7:ffff::1/53", "2001:db8::/32",
    "fe80::1", "::/0", "2001:db8::1/129", "2001:db8:7:ffff::1/127", "::ffff:1.2.3.4/100", "", None,
]


def network(cidr):
    try:
        return ipaddress.ip_network(cidr, strict=False) if cidr else None
    except ValueError:
        return None


def test_networks_from_cidr(spark):
    df = spark.createDataFrame([(c,) for c in NETWORKS], "cidr string")
    got = {r.cidr: (r.lo if r.lo6 is None else int(r.lo6, 16), r.prefix_len) for r in with_network(df).collect()}
    assert got == {c: (int(n.network_address), n.prefixlen) for c in NETWORKS if (n := network(c))}
    assert {r.cidr for r in no_networks(df).collect()} == {c for c in NETWORKS if not network(c)}


def test_lookups_hold_both_families(spark):
    ips = ["1.2.3.4", "10.9.9.9", "2001:db8:7:f800::5", "2001:DB8::1%eth0", "2001:db9::", "::1", "::ffff:1.2.3.4", "nonsense", None]
    rows = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "event_id long, src_ip string")
    cidrs = ["10.0.0.0/8", "2001:db8:7:f800::/53", "2001:db8::/32", "::ffff:1.2.3.0/120"]
    table = with_network(spark.createDataFrame([(c,) for c in cidrs], "cidr string"))
    want = {
        (ip, c) for ip in ips[:7] for c in cidrs
        if (a := ipaddress.ip_address(ip.split("%")[0])).version == (n := ipaddress.ip_network(c)).version and a in n
    }
    assert {(r.ip, r.cidr) for r in matching_networks(rows.withColumnRenamed("src_ip", "ip"), table).collect()} == want
    left = {r.event_id for r in outside_networks(rows, table).collect()}
    assert left == {i for i, ip in enumerate(ips) if ip not in {a for a, _ in want}}
    places = table.withColumn("country", F.col("cidr")).withColumn("country_code", F.lit("DE"))
    found = {r.event_id: r.country for r in geo_enrich(rows, places).collect()}
    assert found == {0: "Unknown", 1: "Local/Private", 2: cidrs[1], 3: cidrs[2], 4: "Unknown", 5: "Local/Private", 6: cidrs[3], 7: "Unknown", 8: None}


def test_flat_networks_give_the_innermost_one(spark):
    rng = random.Random(4)
    nets = {"0.0.0.0/0", "255.255.255.0/24", "255.255.255.255/32", "::/0", "ffff::/16", "2001:db8::/33"}
    for _ in range(60):
        bits = rng.choice([8, 10, 12, 15, 16, 24, 31, 32])
        nets.add(str(ipaddress.ip_network((rng.choice([10 << 24, 172 << 24]) + rng.getrandbits(rng.choice([8, 16, 24])), bits), strict=False)))
        bits = rng.choice([16, 31, 33, 47, 48, 64, 65, 127, 128])
        nets.add(str(ipaddress.ip_network(((0x20010DB8 << 96) + rng.getrandbits(rng.choice([40, 64, 90])), bits), strict=False)))
    parsed = [ipaddress.ip_network(n) for n in nets]
    ips = {str(x) for n in parsed for at in (n.network_address, n.broadcast_address) for x in (at, *([at + 1] if int(at) + 1 < 2**n.max_prefixlen else []), *([at - 1] if int(at) else []))}
    rows = spark.createDataFrame([(ip,) for ip in [*ips, "nonsense", None]], "ip string")
    for kept in (parsed, [n for n in parsed if n.prefixlen]):
        table = with_network(spark.createDataFrame([(str(n),) for n in kept], "cidr string"))
        got = {r.ip: r.network and r.network.cidr for r in innermost_networks(rows, flat_networks(table, ["cidr"])).collect()}
        assert got.pop("nonsense") is None and got.keys() == ips
        for ip, cidr in got.items():
            held = [n for n in kept if n.version == ipaddress.ip_address(ip).version and ipaddress.ip_address(ip) in n]
            assert cidr == (str(max(held, key=lambda n: n.prefixlen)) if held else None), ip


def test_lookups_by_range_are_those_by_prefix(spark):
    ips = ["1.2.3.4", "10.9.9.9", "2001:db8:7:f800::5", "2001:DB8::1%eth0", "2001:db9::", "::1", "nonsense", None]
    rows = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "event_id long, src_ip string")
    table = with_network(spark.createDataFrame([("1.2.0.0/16",), ("2001:db8:7:f800::/53",), ("2001:db8::/32",)], "cidr string"))
    places = table.withColumn("country", F.col("cidr")).withColumn("country_code", F.lit("DE"))
    assert sorted(geo_lookup(rows, places).collect()) == sorted(geo_lookup_by_range(rows, places).collect())
    assert sorted(map(str, outside_networks(rows, table).collect())) == sorted(map(str, outside_networks_by_range(rows, table).collect()))


def test_labels(spark):
    df = spark.createDataFrame([("US", 59), ("USA", 60), ("DE", 3600), ("", 200000)], "code string, age long")
    rows = df.select(sc.country_flag(F.col("code")), sc.time_ago(F.col("age")), mk.escape_markup(F.lit("a_b*c`d[e]"))).collect()
    assert rows[0][0] == "\U0001f1fa\U0001f1f8" and rows[1][0] == "\U0001f310"
    assert [r[1] for r in rows] == ["59s ago", "1m ago", "1h ago", "2d ago"]
    assert rows[0][2] == r"a\_b\*c\`d\[e]"


def test_file_severity_and_ranks(spark):
    paths = ["/etc/passwd", "/etc/passwd-", "/home/x/.ssh/authorized_keys", "/etc/hosts.allow", "/var/log/x", "/etc/sudoers.d/y"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r[0] for r in df.select(sc.file_severity(F.col("p"))).collect()]
    assert got == ["CRITICAL", "CRITICAL", "CRITICAL", "HIGH", "MEDIUM", "CRITICAL"]


def test_limits():
    assert config.problems(config.DetectionLimits()) == []
    bad = config.DetectionLimits(window_sec=0, fails=5000, cooldown_sec=-1)
    assert {p.split()[0] for p in config.problems(bad)} == {"window_sec", "fails", "cooldown_sec"}


def test_operators_refuse_limits_that_make_no_sense(spark):
    events = spark.createDataFrame([], "event_id long, src_ip string, user string, us long, kind string, source string")
    for build in (
        lambda: detect.incident_candidates(events, config.DetectionLimits(fails=0)),
        lambda: baseline.login_history(events, config.BaselineLimits(active_days=-1)),
        lambda: blocks.block_intervals(events, config.BlockLimits(duration_sec=0)),
        lambda: iforest.fit(events, config.ForestLimits(trees=0)),
    ):
        with pytest.raises(ValueError, match="must be positive"):
            build()
