"""Detection, correlation and baseline against an event-at-a-time simulation; frame edges."""

import random
from collections import defaultdict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from seclog.config import SECOND_US, BaselineLimits, DetectionLimits
from seclog.operators import baseline, blocks, correlate, detect
from seclog.schema import meta_struct
from seclog.sources.staging import staged

KINDS = [
    ("auth", "SSH_FAIL"), ("auth", "SSH_SUCCESS"), ("nginx", "WEB_SCAN"), ("nginx", "WEB_AUTH_FAIL"),
    ("nginx", "WEB_EXPLOIT_ATTEMPT"), ("mysql", "DB_AUTH_FAIL"), ("ufw", "FW_BLOCK"), ("ufw", "FW_HONEYPOT_PORT"),
    ("syslog", "SUDO_FAIL"), ("syslog", "SU_FAIL"), ("net", "NET_HINT"),
]
LIMITS = DetectionLimits(
    fails=5, unique_users=3, success_after_fails=3, web_scan=4, web_auth_fail=4, db_fail=3, cooldown_sec=50,
    repeat_threshold=2, repeat_window_sec=300, chunk_us=37 * SECOND_US,
)


def random_events(seed, n=1500, horizon=4000):
    rng = random.Random(seed)
    times = rng.sample(range(horizon * 10), n)  # tenths of a second, all different
    out = []
    for i, t in enumerate(sorted(times)):
        ip = rng.choice(["1.1.1.1"] * 5 + ["2.2.2.2", "3.3.3.3"])
        source, kind = rng.choice(KINDS + KINDS[:1] * 6)
        user = rng.choice(["root", "bob", "eve", "dan", None])
        out.append((i, t * 100_000, ip, source, kind, user))
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, us long, src_ip string, source string, kind string, user string")
    return df.withColumn("meta", meta_struct(path=F.lit("/p"), dst_port=F.lit(23)))


def simulate(rows, lim):
    """One event at a time, with lists; returns {event_id: (severity, reasons, fails, users)}."""
    seen, last, fired, out = defaultdict(list), {}, defaultdict(list), {}
    for eid, us, ip, _, kind, user in sorted(rows, key=lambda r: r[1]):
        if kind == "NET_HINT":
            continue
        t = us / 1e6
        mine = seen[ip]
        mine.append((t, kind, user))
        win = [e for e in mine if e[0] >= t - lim.window_sec]
        n = lambda k: sum(e[1] == k for e in win)
        users = len({e[2] for e in win if e[1] == "SSH_FAIL" and e[2]})
        sev, why, fails, uniq = None, [], 0, 0
        w = lim.window_sec
        if kind == "SSH_FAIL":
            fails, uniq = n("SSH_FAIL"), users
            if fails >= lim.fails:
                sev = "MEDIUM"
                why.append(f"brute_force: {fails} fails in {w}s")
            if users >= lim.unique_users:
                sev = "MEDIUM"
                why.append(f"credential_stuffing: {users} unique users in {w}s")
            if sev and sum(f > t - lim.repeat_window_sec for f in fired[ip]) >= lim.repeat_threshold:
                sev = "HIGH"
                why.append(f"repeat_offender: {lim.repeat_threshold}+ incidents in last hour")
        elif kind == "SSH_SUCCESS":
            fails, uniq = n("SSH_FAIL"), users
            if fails >= lim.success_after_fails:
                sev = "HIGH"
                why.append(f"credential_breach: success after {fails} fails")
        elif kind.startswith("WEB"):
            s, a, x = n("WEB_SCAN"), n("WEB_AUTH_FAIL"), n("WEB_EXPLOIT_ATTEMPT")
            fails = s + a + x
            if s >= lim.web_scan:
                why.append(f"web_scan_flood: {s} scan events in {w}s")
            if a >= lim.web_auth_fail:
                why.append(f"web_auth_flood: {a} 401/403 in {w}s")
            if x:
                why.append("web_exploit_attempt: path=/p")
            sev = "MEDIUM" if why else None
        elif kind == "DB_AUTH_FAIL":
            fails = n("DB_AUTH_FAIL")
            if fails >= lim.db_fail:
                sev = "MEDIUM"
                why.append(f"db_brute_force: {fails} DB auth failures (user={user or 'unknown'})")
        elif kind == "FW_HONEYPOT_PORT":
            sev, fails = "HIGH", 1
            why.append("honeypot_port: connection to port 23 (never legitimate)")
        if sev and (ip not in last or t - last[ip] >= lim.cooldown_sec):
            last[ip] = t
            fired[ip].append(t)
            out[eid] = (sev, why, fails, uniq)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_incidents_equal_simulation(spark, seed):
    rows = random_events(seed)
    got = {
        r.event_id: (r.severity, list(r.reasons), r.fail_count, r.uniq_users)
        for r in detect.incidents(frame(spark, rows), LIMITS).collect()
    }
    assert got == simulate(rows, LIMITS)


def ssh(times, ip="1.1.1.1", kind="SSH_FAIL", start=0):
    return [(start + i, int(t * 1e6), ip, "auth", kind, f"u{i}") for i, t in enumerate(times)]


def test_window_edge_is_inside(spark):
    lim = replace(LIMITS, fails=3, unique_users=99)
    inside = ssh([0, 30, 60]) + ssh([100, 130, 160.000001], start=10, ip="2.2.2.2")
    got = detect.incident_candidates(frame(spark, inside), lim).collect()
    assert [(r.src_ip, r.us) for r in got] == [("1.1.1.1", 60_000_000)]


def test_correlation_edge_is_outside(spark):
    rule = replace(correlate.DEFAULT_RULES[2], window_sec=60)
    port = lambda t, ip, i: (i, int(t * 1e6), ip, "ufw", "FW_HONEYPOT_PORT", None)
    rows = [port(0, "1.1.1.1", 50), port(0, "2.2.2.2", 51)] + ssh([60]) + ssh([59.999999], ip="2.2.2.2", start=5)
    got = correlate.correlate(frame(spark, rows), [rule]).collect()
    assert [(r.src_ip, r.rule) for r in got] == [("2.2.2.2", "honeypot_then_ssh")]


def test_correlation_default_rules(spark):
    rows = random_events(5, 900, 3000)
    got = {(r.src_ip, r.us, r.rule) for r in correlate.correlate(frame(spark, rows)).collect()}
    want = set()
    for _, us, ip, *_ in rows:
        def window(sec):
            return [r for r in rows if r[2] == ip and us - sec * 1_000_000 < r[1] <= us]

        def n(sec, *kinds):
            return sum(r[4] in kinds for r in window(sec))

        if n(300, "SSH_FAIL") >= 3 and n(300, "DB_AUTH_FAIL") >= 2:
            want.add((ip, us, "multi_service_brute_force"))
        if n(600, "WEB_SCAN", "WEB_EXPLOIT_ATTEMPT") >= 5 and n(600, "SSH_FAIL") >= 3:
            want.add((ip, us, "web_recon_then_ssh"))
        if n(180, "FW_HONEYPOT_PORT") >= 1 and n(180, "SSH_FAIL") >= 1:
            want.add((ip, us, "honeypot_then_ssh"))
        if n(120, "WEB_AUTH_FAIL") >= 15:
            want.add((ip, us, "web_auth_flood"))
        if n(300, "SSH_SUCCESS") >= 1 and n(300, "SUDO_FAIL", "SU_FAIL") >= 2:
            want.add((ip, us, "privilege_escalation"))
        seen = window(1800)
        if len({r[3] for r in seen}) >= 3 and len({r[4] for r in seen}) >= 4 and len(seen) >= 20:
            want.add((ip, us, "persistent_recon"))
    assert got == want and len({r for _, _, r in got}) >= 5


def test_packet_hints_never_fire(spark):
    rows = [(i, i * 1000, "6.6.6.6", "net", "NET_HINT", None) for i in range(50)]
    assert detect.incident_candidates(frame(spark, rows), LIMITS).count() == 0


def test_login_baseline_equals_simulation(spark):
    rng = random.Random(3)
    day = 86400
    rows, t = [], 1_700_000_000.0
    for i in range(400):
        t += rng.choice([600, 1800, 7200, day // 2, day, 9 * day]) + rng.random()
        rows.append((i, int(t * 1e6), rng.choice(["1.1.1.1", "1.1.1.1", "2.2.2.2"]), "auth", "SSH_SUCCESS", rng.choice("abcdefgh")))
    lim = BaselineLimits(min_observations=5, spike_min_count=2, spike_factor=1)
    got = {r.event_id: r.anomaly for r in baseline.login_anomalies(frame(spark, rows), lim).collect()}
    want, profiles = {}, {}
    for eid, us, ip, _, _, user in rows:
        p = profiles.setdefault(ip, {"hours": defaultdict(int), "days": [], "users": set(), "n": 0, "last": None})
        ts, hour, today = us / 1e6, us // 3_600_000_000 % 24, us // 86_400_000_000
        if p["n"] >= 5:
            why = []
            usual = sorted(h for h, c in p["hours"].items() if c >= 2)
            if usual and hour not in usual:
                why.append(f"login at unusual hour {hour:02d}:xx (normal hours: {usual})")
            if user not in p["users"]:
                why.append(f"new username '{user}' for IP with {len(p['users'])} known users")
            if ts - p["last"] > 7 * day:
                why.append(f"login after {int((ts - p['last']) / day)}-day absence")
            counts = [c for _, c in p["days"][-7:]]
            if len(counts) >= 3:
                avg = sum(counts[:-1]) / (len(counts) - 1)
                if counts[-1] > avg and counts[-1] >= 2:
                    why.append(f"login frequency spike: {counts[-1]} today vs avg {avg:.1f}/day")
            if why:
                want[eid] = "; ".join(why)
        p["hours"][hour] += 1
        p["users"].add(user)
        p["n"] += 1
        p["last"] = ts
        if p["days"] and p["days"][-1][0] == today:
            p["days"][-1] = (today, p["days"][-1][1] + 1)
        else:
            p["days"].append((today, 1))
    assert got == want and any("spike" in a for a in got.values())


def test_block_intervals_and_unblock(spark):
    second = 1_000_000
    req = spark.createDataFrame(
        [("a", t * second, i, "r") for i, t in enumerate([0, 500, 899, 900, 2000])], "ip string, us long, request_id long, reason string"
    )
    plain = sorted((r.start_us // second, r.end_us // second) for r in blocks.block_intervals(req).collect())
    assert plain == [(0, 900), (900, 1800), (2000, 2900)]
    lift = spark.createDataFrame([("a", 600 * second, 100)], "ip string, us long, request_id long")
    cut = sorted((r.start_us // second, r.end_us // second) for r in blocks.block_intervals(req, unblocks=lift).collect())
    assert cut == [(0, 600), (899, 1799), (2000, 2900)]


def test_recent_kind_maps(spark):
    rows = ssh([1, 2, 3]) + [(9, 2_000_000, "1.1.1.1", "ufw", "FW_BLOCK", None)]
    counts = correlate.recent_kind_counts(frame(spark, rows), 4_000_000, window_sec=3)
    (row,) = correlate.kind_count_maps(counts).collect()
    assert (row.src_ip, row.counts) == ("1.1.1.1", {"SSH_FAIL": 2, "FW_BLOCK": 1})  # the edge at 1 s is outside


def test_logins_after_a_merged_state_are_judged_as_with_all_history(spark):
    rng = random.Random(8)
    hour = 3_600 * SECOND_US
    rows = [(i, rng.choice("aab"), rng.choice(["u", "v", "w"]), rng.randrange(24 * 30) // rng.choice([1, 5]) * hour + rng.randrange(hour), "SSH_SUCCESS") for i in range(1500)]
    events = spark.createDataFrame(rows, "event_id long, src_ip string, user string, us long, kind string")
    limits = BaselineLimits(min_observations=2, active_days=4, spike_min_days=2, spike_min_count=2, spike_factor=1)
    cuts = [0, 90 * hour, 91 * hour, 400 * hour, 24 * 30 * hour]
    state, got = None, []
    for low, high in zip(cuts, cuts[1:], strict=False):
        part = events.filter((F.col("us") >= low) & (F.col("us") < high))
        got += [tuple(r) for r in baseline.login_history(part, limits, state).collect()]
        state = staged(baseline.login_state(part, limits, state), "state")
    assert sorted(got) == sorted(tuple(r) for r in baseline.login_history(events, limits).collect())
    names = ["src_ip", "total_logins", "known_users", "first_seen_us", "last_seen_us", "login_hours"]
    want = baseline.login_profiles(events).select(*names).collect()
    assert sorted(map(str, baseline.profiles_of_state(state).select(*names).collect())) == sorted(map(str, want))
    assert state.groupBy("src_ip", "user").count().agg(F.max("count")).first()[0] <= 24 * 5
