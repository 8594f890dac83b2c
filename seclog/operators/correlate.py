"""Cross-source correlation: declarative co-occurrence rules per source address."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclog.config import HOUR_US, SECOND_US
from seclog.operators.scan import Running, running
from seclog.operators.suppress import suppress_within
from seclog.operators.sweep import Count, window_counts
from seclog.schema import ALL_KINDS, ALL_SOURCES, SYS_KINDS, within


@dataclass(frozen=True)
class RuleSpec:
    """A rule: every ``needs`` entry (kinds, minimum) holds within the window.

    ``description`` may name kinds in braces for their counts, and ``{window}``.
    ``spread`` = (sources, kinds, events) asks for variety instead.
    """

    name: str
    window_sec: int
    needs: tuple[tuple[tuple[str, ...], int], ...]
    severity: str
    confidence: float
    description: str
    cooldown_sec: int = 120
    spread: tuple[int, int, int] | None = None
    kinds: tuple[str, ...] = field(default=ALL_KINDS)
    sources: tuple[str, ...] = field(default=ALL_SOURCES)

    @property
    def counted(self) -> list[str]:
        return [k for kinds, _ in self.needs for k in kinds]


# The built-in rules, their windows, thresholds and texts.
DEFAULT_RULES = (
    RuleSpec(
        "multi_service_brute_force", 300, ((("SSH_FAIL",), 3), (("DB_AUTH_FAIL",), 2)), "HIGH", 0.85,
        "Credential spray: {SSH_FAIL} SSH fails + {DB_AUTH_FAIL} DB fails in {window}s",
    ),
    RuleSpec(
        "web_recon_then_ssh", 600, ((("WEB_SCAN", "WEB_EXPLOIT_ATTEMPT"), 5), (("SSH_FAIL",), 3)), "HIGH", 0.80,
        "Coordinated attack: {WEB_SCAN} web scans, {WEB_EXPLOIT_ATTEMPT} exploit attempts, {SSH_FAIL} SSH fails",
    ),
    RuleSpec(
        "honeypot_then_ssh", 180, ((("FW_HONEYPOT_PORT",), 1), (("SSH_FAIL",), 1)), "HIGH", 0.90,
        "Automated scanner: hit honeypot port(s) then tried SSH",
    ),
    RuleSpec(
        "web_auth_flood", 120, ((("WEB_AUTH_FAIL",), 15),), "MEDIUM", 0.75,
        "Web auth flood: {WEB_AUTH_FAIL} 401/403 responses in {window}s",
    ),
    RuleSpec(
        "privilege_escalation", 300, ((("SSH_SUCCESS",), 1), (("SUDO_FAIL", "SU_FAIL"), 2)), "HIGH", 0.85,
        "Privilege escalation after login: {SUDO_FAIL} sudo fails, {SU_FAIL} su fails",
    ),
    RuleSpec(
        "persistent_recon", 1800, (), "MEDIUM", 0.70,
        "Persistent recon: {events} events across {sources} sources, {kinds} attack types in 30min",
        spread=(3, 4, 20),
    ),
)


def _column(rule: RuleSpec, what: str) -> str:
    return f"{rule.name}__{what}"


def _terms(rule: RuleSpec) -> list[Count]:
    w = rule.window_sec * SECOND_US

    def count(what: str, where: Column) -> Count:
        return Count(_column(rule, what), where, w, strict=True)

    terms = [count(k, F.col("kind") == k) for k in dict.fromkeys(rule.counted)]
    if rule.spread:
        # Kinds and sources form small closed sets, so "how many distinct" is
        # the number of them with a positive count.
        terms += [count(f"kind_{k}", F.col("kind") == k) for k in rule.kinds]
        terms += [count(f"source_{s}", F.col("source") == s) for s in rule.sources]
        terms.append(count("events", F.lit(True)))
    return terms


def _positive(rule: RuleSpec, prefix: str, values: Sequence[str]) -> Column:
    return sum(
        (F.when(F.col(_column(rule, f"{prefix}_{v}")) > 0, 1).otherwise(0) for v in values), F.lit(0)
    )


def _holds(rule: RuleSpec) -> Column:
    ok = F.lit(True)
    for kinds, least in rule.needs:
        ok = ok & (sum((F.col(_column(rule, k)) for k in kinds), F.lit(0)) >= least)
    if rule.spread:
        sources, kinds, events = rule.spread
        ok = (
            ok
            & (_positive(rule, "source", rule.sources) >= sources)
            & (_positive(rule, "kind", rule.kinds) >= kinds)
            & (F.col(_column(rule, "events")) >= events)
        )
    return ok


def _describe(rule: RuleSpec) -> Column:
    parts, rest = [], rule.description
    while rest:
        head, brace, tail = rest.partition("{")
        parts.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        if name == "window":
            parts.append(F.lit(str(rule.window_sec)))
        elif name in ("sources", "kinds") and rule.spread:
            values = rule.sources if name == "sources" else rule.kinds
            parts.append(_positive(rule, name[:-1], values).cast("string"))
        else:
            parts.append(F.col(_column(rule, name)).cast("string"))
    return F.concat(*parts)


def _evidence(rule: RuleSpec) -> Column:
    listed = list(dict.fromkeys(rule.counted))
    columns = {k: _column(rule, k) for k in listed}
    if rule.spread:
        columns |= {k: _column(rule, f"kind_{k}") for k in rule.kinds}
        columns |= {f"source:{s}": _column(rule, f"source_{s}") for s in rule.sources}
        columns["total"] = _column(rule, "events")
    items = F.array(
        *[
            F.struct(F.lit(label).alias("kind"), F.col(c).cast("long").alias("count"))
            for label, c in columns.items()
        ]
    )
    return F.filter(items, lambda e: e["count"] > 0) if rule.spread else items


def correlate(
    events: DataFrame, rules: Sequence[RuleSpec] = DEFAULT_RULES, chunk_us: int = HOUR_US
) -> DataFrame:
    """All rules at all instants: one row per (rule, src_ip, instant) that holds.

    All windows of all rules share one sweep, hence one shuffle of the events.
    """
    terms = [t for rule in rules for t in _terms(rule)]
    counts = window_counts(events, terms, chunk_us=chunk_us)
    alerts = F.array(
        *[
            F.when(
                _holds(rule),
                F.struct(
                    F.lit(rule.name).alias("rule"),
                    F.lit(float(rule.confidence)).alias("confidence"),
                    F.lit(rule.severity).alias("severity"),
                    _describe(rule).alias("description"),
                    _evidence(rule).alias("evidence"),
                ),
            )
            for rule in rules
        ]
    )
    return (
        counts.select("src_ip", "us", F.explode(alerts).alias("a"))
        .filter(F.col("a").isNotNull())
        .select("src_ip", "us", "a.rule", "a.confidence", "a.severity", "a.description", "a.evidence")
    )


def correlation_alerts(
    alerts: DataFrame, rules: Sequence[RuleSpec] = DEFAULT_RULES
) -> DataFrame:
    """Alerts after the cooldown of each (address, rule)."""
    by_cooldown: dict[int, list[str]] = {}
    for rule in rules:
        by_cooldown.setdefault(rule.cooldown_sec, []).append(rule.name)
    parts = []
    for seconds, names in by_cooldown.items():
        chosen = alerts if len(by_cooldown) == 1 else alerts.filter(F.col("rule").isin(*names))
        # The rule is part of the key, so it also serves as the (constant) tie-breaker.
        tied = chosen.withColumn("__n", F.lit(0))
        parts.append(
            suppress_within(tied, ["src_ip", "rule"], seconds * SECOND_US, tie="__n").drop("__n")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def recent_kind_counts(events: DataFrame, as_of_us: int, window_sec: int = 300) -> DataFrame:
    """Events per (address, kind) in the last ``window_sec`` before ``as_of_us``."""
    return (
        within(events.filter(F.col("src_ip").isNotNull()), as_of_us - window_sec * SECOND_US + 1, as_of_us)
        .groupBy("src_ip", "kind")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def kind_count_maps(counts: DataFrame) -> DataFrame:
    """The same counts as one map per address (at most one entry per kind)."""
    entry = F.struct(F.col("kind"), F.col("n"))
    return counts.groupBy("src_ip").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("counts")
    )


def alerts_as_incidents(alerts: DataFrame) -> DataFrame:
    """Correlation alerts in incident form; they bypass the incident cooldown."""
    text = F.concat(F.lit("[CORRELATION:"), F.col("rule"), F.lit("] "), F.col("description"))
    return alerts.select(
        "src_ip",
        "us",
        "severity",
        F.array(text).alias("reasons"),
        F.lit(0).cast("long").alias("fail_count"),
        F.lit(0).cast("long").alias("uniq_users"),
        F.lit("correlation").alias("trigger"),
    )


def attribute_privilege(events: DataFrame, window_sec: int) -> DataFrame:
    """Failed sudo / su rows with the address of the latest login of the same user.

    An as-of join on (host, user): the most recent SSH_SUCCESS at or before the
    row, at most ``window_sec`` old. Rows without one keep a null address.
    """
    relevant = events.filter(
        F.col("kind").isin("SSH_SUCCESS", *SYS_KINDS)
        & F.col("host").isNotNull()
        & F.col("user").isNotNull()
    )
    login = F.when(F.col("kind") == "SSH_SUCCESS", F.struct(F.col("us").alias("at"), F.col("src_ip").alias("ip")))
    linked = running(relevant, ["host", "user"], "us", {"__login": Running(login, "last")}, tie="event_id")
    fresh = F.col("us") - F.col("__login.at") <= window_sec * SECOND_US
    return linked.filter(F.col("kind").isin(*SYS_KINDS)).select(
        *[
            F.when(fresh, F.col("__login.ip")).alias("src_ip") if c == "src_ip" else F.col(c)
            for c in events.columns
        ]
    )


def with_attributed_privilege(events: DataFrame, window_sec: int) -> DataFrame:
    """All events, failed sudo / su rows with the address that ``attribute_privilege`` finds for them."""
    named = F.col("kind").isin(*SYS_KINDS) & F.col("host").isNotNull() & F.col("user").isNotNull()
    return events.filter(~F.coalesce(named, F.lit(False))).unionByName(attribute_privilege(events, window_sec))
