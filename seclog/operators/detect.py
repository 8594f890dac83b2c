"""Per-address sliding-window detections, incidents and their escalation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclog.config import SECOND_US, DetectionLimits, ReputationLimits, checked
from seclog.functions.scalar import severity_of_rank, severity_rank
from seclog.operators.enrich import one_per_address
from seclog.operators.suppress import suppress_within
from seclog.operators.sweep import Count, Distinct, window_counts
from seclog.schema import HANDLED_KINDS, NET_HINT, SYS_KINDS, WEB_KINDS, within
from seclog.sources.staging import staged


def handled(events: DataFrame) -> DataFrame:
    """Events the detector judges: a handled kind with a source address."""
    return events.filter(F.col("kind").isin(*HANDLED_KINDS) & F.col("src_ip").isNotNull())


def context_events(events: DataFrame) -> DataFrame:
    """Events kept as context only: plain firewall blocks and failed sudo / su."""
    return handled(events).filter(F.col("kind").isin("FW_BLOCK", *SYS_KINDS))


COUNTED = ("ssh_fails", "web_scans", "web_auth_fails", "web_exploits", "db_fails", "uniq_users")

#: The count that a rule looks at.
RULE_COUNT = {
    "brute_force": "ssh_fails",
    "credential_stuffing": "uniq_users",
    "credential_breach": "ssh_fails",
    "web_scan_flood": "web_scans",
    "web_auth_flood": "web_auth_fails",
    "web_exploit": "web_exploits",
    "db_brute_force": "db_fails",
}


def _kind(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def detection_counts(
    events: DataFrame, limits: DetectionLimits, names: tuple[str, ...] = COUNTED
) -> DataFrame:
    """Counts behind the detections (those of ``names``), one row per (src_ip, instant)."""
    w = limits.window_sec * SECOND_US
    terms = [
        Count("ssh_fails", _kind("SSH_FAIL"), w),
        Count("web_scans", _kind("WEB_SCAN"), w),
        Count("web_auth_fails", _kind("WEB_AUTH_FAIL"), w),
        Count("web_exploits", _kind("WEB_EXPLOIT_ATTEMPT"), w),
        Count("db_fails", _kind("DB_AUTH_FAIL"), w),
        Distinct(
            "uniq_users",
            _kind("SSH_FAIL") & (F.col("user") != ""),
            w,
            value=F.col("user"),
        ),
    ]
    return window_counts(
        handled(events), [t for t in terms if t.name in names], chunk_us=limits.chunk_us
    )


def rule_hits(limits: DetectionLimits) -> dict[str, Column]:
    """Each rule as a condition over an event and the counts at its instant."""
    return {
        "brute_force": _kind("SSH_FAIL") & (F.col("ssh_fails") >= limits.fails),
        "credential_stuffing": _kind("SSH_FAIL") & (F.col("uniq_users") >= limits.unique_users),
        "credential_breach": _kind("SSH_SUCCESS")
        & (F.col("ssh_fails") >= limits.success_after_fails),
        "web_scan_flood": _kind(*WEB_KINDS) & (F.col("web_scans") >= limits.web_scan),
        "web_auth_flood": _kind(*WEB_KINDS) & (F.col("web_auth_fails") >= limits.web_auth_fail),
        "web_exploit": _kind(*WEB_KINDS) & (F.col("web_exploits") >= 1),
        "db_brute_force": _kind("DB_AUTH_FAIL") & (F.col("db_fails") >= limits.db_fail),
        "honeypot_port": _kind("FW_HONEYPOT_PORT"),
    }


def _possible(limits: DetectionLimits, names: tuple[str, ...] = COUNTED) -> Column:
    """Instants at which some counted rule can hold; keeps the join back small."""
    least = {
        "ssh_fails": min(limits.fails, limits.success_after_fails),
        "uniq_users": limits.unique_users,
        "web_scans": limits.web_scan,
        "web_auth_fails": limits.web_auth_fail,
        "web_exploits": 1,
        "db_fails": limits.db_fail,
    }
    return reduce(lambda a, b: a | b, [F.col(n) >= least[n] for n in names])


def rule_rows(events: DataFrame, rule: str, limits: DetectionLimits) -> DataFrame:
    """Events at which one counted rule holds, with its count at their instants."""
    name = RULE_COUNT[rule]
    counts = detection_counts(events, limits, (name,)).filter(_possible(limits, (name,)))
    return handled(events).join(counts, ["src_ip", "us"]).filter(rule_hits(limits)[rule])


def decoy_port_hits(events: DataFrame) -> DataFrame:
    return handled(events).filter(F.col("kind") == "FW_HONEYPOT_PORT")


def _text(*parts: object) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def incident_candidates(
    events: DataFrame,
    limits: DetectionLimits,
    reputation: DataFrame | None = None,
    reputation_limits: ReputationLimits | None = None,
) -> DataFrame:
    """Every event that would raise an incident, before suppression.

    With ``reputation`` (ip, abuse_score, total_reports, isp, is_public) any
    judged event of a flagged address is at least MEDIUM.
    """
    checked(limits)
    judged = handled(events).filter(~F.col("kind").isin("FW_BLOCK", *SYS_KINDS))
    # Only instants that can fire are joined back; decoy-port hits need no counts.
    instants = detection_counts(events, limits)
    decoys = judged.filter(_kind("FW_HONEYPOT_PORT"))
    if reputation is None:
        instants, flag = instants.filter(_possible(limits)), F.lit(None).cast("string")
    else:
        least = (reputation_limits or ReputationLimits()).flag_score
        flagged = one_per_address(reputation).filter((F.col("abuse_score") >= least) & F.col("is_public")).select(
            F.col("ip").alias("src_ip"),
            _text(
                "abuseipdb_score=", F.col("abuse_score"), " reports=", F.col("total_reports"),
                " isp=", F.col("isp"),
            ).alias("__flag"),
        )
        flag = F.col("__flag")
        instants = instants.join(flagged, "src_ip", "left").filter(_possible(limits) | flag.isNotNull())
        decoys = decoys.join(flagged, "src_ip", "left")
    counted = judged.filter(~_kind("FW_HONEYPOT_PORT")).join(instants, ["src_ip", "us"])
    rows = counted.unionByName(decoys.select("*", *[F.lit(0).cast("long").alias(c) for c in COUNTED]))

    hit = rule_hits(limits)
    w = limits.window_sec
    reasons = F.array_compact(
        F.array(
            F.when(hit["brute_force"], _text("brute_force: ", F.col("ssh_fails"), f" fails in {w}s")),
            F.when(
                hit["credential_stuffing"],
                _text("credential_stuffing: ", F.col("uniq_users"), f" unique users in {w}s"),
            ),
            F.when(
                hit["credential_breach"],
                _text("credential_breach: success after ", F.col("ssh_fails"), " fails"),
            ),
            F.when(
                hit["web_scan_flood"],
                _text("web_scan_flood: ", F.col("web_scans"), f" scan events in {w}s"),
            ),
            F.when(
                hit["web_auth_flood"],
                _text("web_auth_flood: ", F.col("web_auth_fails"), f" 401/403 in {w}s"),
            ),
            F.when(
                hit["web_exploit"],
                _text("web_exploit_attempt: path=", F.coalesce(F.col("meta.path"), F.lit(""))),
            ),
            F.when(
                hit["db_brute_force"],
                _text(
                    "db_brute_force: ", F.col("db_fails"), " DB auth failures (user=",
                    F.coalesce(F.nullif(F.col("user"), F.lit("")), F.lit("unknown")), ")",
                ),
            ),
            F.when(
                hit["honeypot_port"],
                _text(
                    "honeypot_port: connection to port ",
                    F.coalesce(F.col("meta.dst_port").cast("string"), F.lit("?")),
                    " (never legitimate)",
                ),
            ),
            flag,
        )
    )
    high = hit["credential_breach"] | hit["honeypot_port"]
    web_total = F.col("web_scans") + F.col("web_auth_fails") + F.col("web_exploits")
    return rows.select(
        "event_id",
        "src_ip",
        "us",
        "kind",
        "user",
        F.when(high, "HIGH").otherwise("MEDIUM").alias("severity"),
        reasons.alias("reasons"),
        F.when(_kind("SSH_FAIL", "SSH_SUCCESS"), F.col("ssh_fails"))
        .when(_kind(*WEB_KINDS), web_total)
        .when(_kind("DB_AUTH_FAIL"), F.col("db_fails"))
        .otherwise(F.lit(1))
        .cast("long")
        .alias("fail_count"),
        F.when(_kind("SSH_FAIL", "SSH_SUCCESS"), F.col("uniq_users"))
        .otherwise(F.lit(0))
        .cast("long")
        .alias("uniq_users"),
        F.when(_kind("SSH_FAIL"), "fail")
        .when(_kind("SSH_SUCCESS"), "success")
        .when(_kind(*WEB_KINDS), "web")
        .when(_kind("DB_AUTH_FAIL"), "db")
        .otherwise("fw")
        .alias("trigger"),
    ).filter(F.size("reasons") > 0)


def fired_incidents(
    candidates: DataFrame, limits: DetectionLimits, severity_aware: bool = False
) -> DataFrame:
    """Candidates left after the per-address cooldown.

    ``severity_aware`` suppresses per (address, severity), so that a MEDIUM
    incident does not hide a HIGH one that follows it.
    """
    keys = ["src_ip", "severity"] if severity_aware else ["src_ip"]
    return suppress_within(candidates, keys, limits.cooldown_sec * SECOND_US)


def escalate_repeat_offenders(incidents: DataFrame, limits: DetectionLimits) -> DataFrame:
    """SSH-failure incidents with enough earlier incidents in the repeat window turn HIGH.

    Whether an incident fires does not depend on its severity, so counting the
    survivors is exact.
    """
    window = limits.repeat_window_sec * SECOND_US
    at_instant = window_counts(
        incidents,
        [
            Count("__recent", F.lit(True), window, strict=True),
            Count("__now", F.lit(True), 0),
        ],
        chunk_us=max(limits.chunk_us, window),
    ).filter(F.col("__recent") - F.col("__now") >= limits.repeat_threshold)
    repeat = at_instant.select("src_ip", "us", F.lit(True).alias("__repeat"))
    escalated = F.coalesce(F.col("__repeat"), F.lit(False)) & (F.col("trigger") == "fail")
    note = F.lit(f"repeat_offender: {limits.repeat_threshold}+ incidents in last hour")
    joined = incidents.join(repeat, ["src_ip", "us"], "left")
    # An address's reputation reason comes after the escalation reason.
    own = F.filter(F.col("reasons"), lambda r: ~r.startswith("abuseipdb_score="))
    flags = F.filter(F.col("reasons"), lambda r: r.startswith("abuseipdb_score="))
    # A flag alone does not make an SSH failure a rule hit that can be escalated.
    escalated = escalated & (F.size(own) > 0)
    return joined.select(
        *[c for c in incidents.columns if c not in ("severity", "reasons")],
        F.when(escalated, "HIGH").otherwise(F.col("severity")).alias("severity"),
        F.when(escalated, F.concat(own, F.array(note), flags)).otherwise(F.col("reasons")).alias("reasons"),
    )


def incidents(
    events: DataFrame,
    limits: DetectionLimits,
    reputation: DataFrame | None = None,
    reputation_limits: ReputationLimits | None = None,
    severity_aware: bool = False,
) -> DataFrame:
    """Detection end to end: candidates, cooldown, repeat-offender escalation."""
    candidates = incident_candidates(events, limits, reputation, reputation_limits)
    fired = staged(fired_incidents(candidates, limits, severity_aware), "fired")
    return escalate_repeat_offenders(fired, limits)


def activity_snapshot(
    events: DataFrame,
    incident_table: DataFrame,
    as_of_us: int,
    limits: DetectionLimits,
    blocks: DataFrame | None = None,
    geo: DataFrame | None = None,
    login_anomalies: DataFrame | None = None,
    correlation: DataFrame | None = None,
) -> DataFrame:
    """State of every address at ``as_of_us``, the most failing first.

    ``blocks`` (ip, start_us, end_us), ``geo`` (src_ip, country, flag, isp), ``login_anomalies`` (src_ip, ...) and
    ``correlation`` (src_ip, counts: recent events by kind) are optional sides, one row per fact.
    """
    past = within(handled(events), until_us=as_of_us)
    recent = F.col("us") >= as_of_us - limits.window_sec * SECOND_US

    def seen(kind: str, within: Column = recent) -> Column:
        return F.sum(F.when((F.col("kind") == kind) & within, 1).otherwise(0))

    state = past.groupBy("src_ip").agg(
        seen("SSH_FAIL").alias("fails_in_window"),
        seen("WEB_SCAN").alias("web_scans"),
        seen("WEB_AUTH_FAIL").alias("web_auth_fails"),
        seen("DB_AUTH_FAIL").alias("db_fails"),
        seen("SSH_FAIL", F.lit(True)).alias("total_fails"),
    )
    users = (
        within(past, as_of_us - limits.window_sec * SECOND_US).filter((F.col("kind") == "SSH_FAIL") & (F.col("user") != ""))
        .groupBy("src_ip")
        .agg(F.countDistinct("user").alias("unique_users"))
    )
    fired = (
        within(incident_table, until_us=as_of_us)
        .groupBy("src_ip")
        .agg(F.count(F.lit(1)).alias("total_incidents"), F.max("us").alias("last_incident_us"))
    )
    out = state.join(users, "src_ip", "left").join(fired, "src_ip", "left")
    extra = []
    if blocks is not None:
        held = (
            blocks.filter((F.col("start_us") <= as_of_us) & (F.col("end_us") > as_of_us))
            .select(F.col("ip").alias("src_ip"), F.lit(True).alias("is_blocked"))
            .distinct()
        )
        out = out.join(held, "src_ip", "left")
        extra.append(F.coalesce("is_blocked", F.lit(False)).alias("is_blocked"))
    if geo is not None:
        out = out.join(geo, "src_ip", "left")
        extra += [F.col(c) for c in geo.columns if c != "src_ip"]
    if login_anomalies is not None:
        odd = login_anomalies.groupBy("src_ip").agg(F.count(F.lit(1)).alias("baseline_anomalies"))
        out = out.join(odd, "src_ip", "left")
        extra.append(F.coalesce("baseline_anomalies", F.lit(0)).alias("baseline_anomalies"))
    if correlation is not None:
        out = out.join(correlation.select("src_ip", F.col("counts").alias("correlation_events")), "src_ip", "left")
        extra.append(F.coalesce("correlation_events", F.create_map().cast("map<string,bigint>")).alias("correlation_events"))
    return out.select(
        "src_ip",
        "fails_in_window",
        F.coalesce("unique_users", F.lit(0)).alias("unique_users"),
        "web_scans",
        "web_auth_fails",
        "db_fails",
        "total_fails",
        F.coalesce("total_incidents", F.lit(0)).alias("total_incidents"),
        "last_incident_us",
        *extra,
    ).orderBy(F.desc("total_fails"), "src_ip")


def worst_severity(severity: Column) -> Column:
    """Aggregate: the highest severity of a group by rank, not by spelling."""
    return severity_of_rank(F.max(severity_rank(severity)))
