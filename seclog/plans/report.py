"""Report aggregates over incidents, blocks, file alerts and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclog.config import DAY_US, HOUR_US
from seclog.functions.scalar import iso_from_micros, severity_of_rank, severity_rank
from seclog.schema import within

REPORTED = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def recent_incidents(incidents: DataFrame, limit: int = 50) -> DataFrame:
    """The ``limit`` newest incidents."""
    if limit < 1:
        raise ValueError(f"limit must be at least 1, got {limit}")
    return incidents.orderBy(F.desc("us"), "src_ip").limit(limit)


def top_attackers(incidents: DataFrame, limit: int | None = 20) -> DataFrame:
    """Per address: incidents, worst severity by rank, last seen, location when last seen."""
    geo = [c for c in ("flag", "country", "city", "isp") if c in incidents.columns]
    location = [F.max_by(F.struct(*geo), F.col("us")).alias("g")] if geo else []
    out = (
        incidents.groupBy("src_ip")
        .agg(
            F.count(F.lit(1)).alias("incident_count"),
            severity_of_rank(F.max(severity_rank(F.col("severity")))).alias("max_severity"),
            F.max("us").alias("last_seen_us"),
            *location,
        )
        .select(
            "src_ip",
            *[F.col(f"g.{c}").alias(c) for c in geo],
            "incident_count",
            "max_severity",
            "last_seen_us",
        )
        .orderBy(F.desc("incident_count"), "src_ip")
    )
    return out if limit is None else out.limit(limit)


def timeline(incidents: DataFrame, as_of_us: int, span_us: int = DAY_US, step_us: int = HOUR_US) -> DataFrame:
    """Incidents per step and severity over the span before ``as_of_us``."""
    cutoff = as_of_us - span_us
    return (
        within(incidents, cutoff, as_of_us)
        .groupBy(
            F.floor((F.col("us") - cutoff) / step_us).cast("int").alias("hour_offset"), "severity"
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def timeline_filled(
    incidents: DataFrame, as_of_us: int, span_us: int = DAY_US, step_us: int = HOUR_US
) -> DataFrame:
    """The timeline with empty steps as zeros; the last step takes the closing edge."""
    steps = span_us // step_us
    counted = (
        timeline(incidents, as_of_us, span_us, step_us)
        .groupBy(F.least(F.col("hour_offset"), F.lit(steps - 1)).alias("hour_offset"), "severity")
        .agg(F.sum("n").alias("n"))
    )
    grid = (
        incidents.sparkSession.range(1)
        .select(F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("hour_offset"))
        .select("hour_offset", F.explode(F.array(*[F.lit(s) for s in REPORTED])).alias("severity"))
    )
    return grid.join(counted, ["hour_offset", "severity"], "left").select(
        "hour_offset", "severity", F.coalesce("n", F.lit(0)).alias("n")
    )


def _of(severity: str) -> Column:
    return F.count(F.when(F.col("severity") == severity, 1))


def incident_stats(incidents: DataFrame, approximate: bool = False) -> DataFrame:
    addresses = F.approx_count_distinct("src_ip") if approximate else F.countDistinct("src_ip")
    return incidents.agg(
        F.count(F.lit(1)).alias("total"),
        _of("HIGH").alias("high"),
        _of("MEDIUM").alias("medium"),
        _of("LOW").alias("low"),
        addresses.alias("unique_ips"),
    )


def _metrics(row: DataFrame, names: list[str]) -> DataFrame:
    """One row of totals as (metric, value) rows."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias("metric"), F.col(n).cast("long").alias("value")) for n in names]
    )
    return row.select(F.explode(pairs).alias("m")).select("m.metric", "m.value")


def period_report(
    incidents: DataFrame, blocks: DataFrame, fim_alerts: DataFrame, as_of_us: int, days: int
) -> DataFrame:
    """Totals of the period before ``as_of_us`` as (metric, value) rows."""
    since = as_of_us - days * DAY_US
    inc = within(incidents, since, as_of_us).agg(
        F.count(F.lit(1)).alias("total_incidents"),
        _of("HIGH").alias("high_count"),
        _of("MEDIUM").alias("medium_count"),
    )
    held = blocks.filter((F.col("start_us") <= as_of_us) & (F.col("end_us") > as_of_us)).agg(
        F.count(F.lit(1)).alias("block_count")
    )
    fim = within(fim_alerts, since, as_of_us).agg(
        F.count(F.lit(1)).alias("fim_alert_count"), _of("CRITICAL").alias("fim_critical")
    )
    return (
        _metrics(inc, ["total_incidents", "high_count", "medium_count"])
        .unionByName(_metrics(held, ["block_count"]))
        .unionByName(_metrics(fim, ["fim_alert_count", "fim_critical"]))
    )


def executive_summary(report: DataFrame) -> DataFrame:
    """Headline rows (position, metric, value, status) from a period report."""

    def value(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("metric") == name, F.col("value"))), F.lit(0))

    totals = report.agg(
        *[
            value(n).alias(n)
            for n in (
                "total_incidents", "high_count", "medium_count", "fim_alert_count",
                "fim_critical", "block_count",
            )
        ]
    )
    # Row labels, limits and status texts.
    rows = [
        ("Total incidents", "total_incidents",
         F.when(F.col("total_incidents") > 10, "! Action needed").otherwise("OK Normal")),
        ("HIGH severity incidents", "high_count",
         F.when(F.col("high_count") > 0, "! Review required").otherwise("OK None")),
        ("MEDIUM severity incidents", "medium_count", F.lit("—")),
        ("File integrity alerts", "fim_alert_count",
         F.when(F.col("fim_critical") > 0, "! Review files").otherwise("OK Clean")),
        ("Currently blocked IPs", "block_count", F.lit("—")),
    ]
    entries = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("position"),
                F.lit(label).alias("metric"),
                F.col(name).cast("string").alias("value"),
                status.alias("status"),
            )
            for i, (label, name, status) in enumerate(rows)
        ]
    )
    return totals.select(F.explode(entries).alias("e")).select("e.*")


# Frameworks, their controls and what each control watches.
CONTROLS = (
    ("SOC 2 Type II", "CC6.1", "Access controls monitored"),
    ("SOC 2 Type II", "CC6.7", "Unauthorized access detection"),
    ("SOC 2 Type II", "CC7.2", "System anomaly monitoring"),
    ("SOC 2 Type II", "CC6.8", "File integrity"),
    ("ISO 27001", "A.12.4", "Event logging active"),
    ("ISO 27001", "A.12.6", "Vulnerability monitoring"),
    ("ISO 27001", "A.13.1", "Network monitoring"),
    ("ISO 27001", "A.16.1", "Incident management"),
    ("PCI-DSS v4", "Req 10", "Log monitoring active"),
    ("PCI-DSS v4", "Req 11.5", "Intrusion detection"),
    ("PCI-DSS v4", "Req 11.5.2", "File integrity"),
    ("PCI-DSS v4", "Req 12.10", "Incident response"),
)
FRAMEWORK_STATUS = (
    ("SOC 2 Type II", "OK Monitored", "! FIM alerts"),
    ("ISO 27001", "OK Compliant", "OK Compliant"),
    ("PCI-DSS v4", "OK Compliant", "! File changes detected"),
)


def compliance_mapping(fim_counts: DataFrame) -> DataFrame:
    """Frameworks with their controls and a status that depends on file alerts.

    ``fim_counts`` is the one row (fim_alert_count, fim_critical).
    """
    clean = F.col("fim_critical") == 0
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("framework"),
                F.lit(", ".join(c for f, c, _ in CONTROLS if f == name)).alias("controls"),
                F.when(clean, good).otherwise(bad).alias("status"),
            )
            for name, good, bad in FRAMEWORK_STATUS
        ]
    )
    return fim_counts.select(F.explode(rows).alias("r")).select("r.*")


def compliance_controls(fim_counts: DataFrame) -> DataFrame:
    """Every control with its finding."""
    changes, critical = F.col("fim_alert_count"), F.col("fim_critical")

    def finding(control: str, text: str) -> Column:
        if control == "CC6.8":
            return F.when(changes == 0, f"{text} maintained").otherwise(
                F.concat(F.lit(f"{text} "), changes, F.lit(" changes detected"))
            )
        if control == "Req 11.5.2":
            return F.when(critical == 0, f"{text} OK").otherwise(
                F.concat(F.lit(f"{text} "), critical, F.lit(" critical changes"))
            )
        return F.lit(text)

    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("framework"), F.lit(c).alias("control"), finding(c, t).alias("finding")
            )
            for f, c, t in CONTROLS
        ]
    )
    return fim_counts.select(F.explode(rows).alias("r")).select("r.*")


def engine_counters(
    events: DataFrame, incidents: DataFrame, blocks: DataFrame, as_of_us: int
) -> DataFrame:
    """Counters and gauges as (metric, label, value) rows, each table read once."""
    seen = events.agg(
        F.count(F.lit(1)).alias("events_processed_total"),
        F.count(F.when(F.col("kind") == "SSH_FAIL", 1)).alias("ssh_fails_total"),
    )
    fired = incidents.agg(*[_of(s).alias(s) for s in REPORTED])
    held = blocks.agg(
        F.count(F.lit(1)).alias("blocks_total"),
        F.count(
            F.when((F.col("start_us") <= as_of_us) & (F.col("end_us") > as_of_us), 1)
        ).alias("blocks_active"),
    )
    plain = _metrics(seen, ["events_processed_total", "ssh_fails_total"]).unionByName(
        _metrics(held, ["blocks_total", "blocks_active"])
    )
    by_severity = _metrics(fired, list(REPORTED)).select(
        F.lit("incidents_total").alias("metric"), F.col("metric").alias("label"), "value"
    )
    return plain.select("metric", F.lit("").alias("label"), "value").unionByName(by_severity)


def top_failing_ips(events: DataFrame, geo: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """Addresses with the most SSH failures, exact; country where known."""
    top = (
        events.filter((F.col("kind") == "SSH_FAIL") & F.col("src_ip").isNotNull())
        .groupBy("src_ip")
        .agg(F.count(F.lit(1)).alias("fails"))
        .orderBy(F.desc("fails"), "src_ip")
        .limit(limit)
    )
    if geo is None:
        return top
    return top.join(geo.select("src_ip", "country"), "src_ip", "left").select(
        "src_ip", "fails", F.coalesce("country", F.lit("")).alias("country")
    )


def top_failing_ips_approx(events: DataFrame, limit: int = 10, tracked: int = 10_000) -> DataFrame:
    """The same from a mergeable sketch of ``tracked`` counters: one row, no shuffle of keys.

    A count is off by at most a share of 1 / (0.75 * tracked) of all failures once more addresses than
    0.75 * tracked occur; where that could reach the last of the top, the exact top is counted in a second pass.
    The sketch is made at once, since it decides.
    """
    rows = events.filter((F.col("kind") == "SSH_FAIL") & F.col("src_ip").isNotNull())
    top = rows.agg(
        F.expr(f"approx_top_k(src_ip, {limit}, {tracked})").alias("t"),
        F.count(F.lit(1)).alias("n"),
        F.approx_count_distinct("src_ip").alias("addresses"),
    )
    exact = F.col("addresses") * 1.2 < 0.75 * tracked
    least = F.array_min(F.transform("t", lambda i: i["count"]))
    # The sketch leaves out what it is not sure of, up to all of a flat table.
    sure = exact | ((F.size("t") == limit) & (least > F.col("n") / (0.75 * tracked)))
    sketch = top.select("t", sure.alias("sure"))
    found = sketch.first()
    if not found["sure"]:
        return top_failing_ips(events, limit=limit)
    return events.sparkSession.createDataFrame([found], sketch.schema).select(F.explode("t").alias("i")).select(
        F.col("i.item").alias("src_ip"), F.col("i.count").alias("fails")
    )


def fails_by_country(events: DataFrame, geo: DataFrame) -> DataFrame:
    """SSH failures per country: counted per address first, so the join is small."""
    per_ip = (
        events.filter((F.col("kind") == "SSH_FAIL") & F.col("src_ip").isNotNull())
        .groupBy("src_ip")
        .agg(F.count(F.lit(1)).alias("fails"))
    )
    return (
        per_ip.join(geo.select("src_ip", "country"), "src_ip", "left")
        .groupBy("country")
        .agg(F.sum("fails").alias("fails"))
    )


def rate_series(
    rows: DataFrame, window_sec: int, step_sec: int, per_sec: int, by: list[str] | None = None
) -> DataFrame:
    """Rows per ``per_sec`` in sliding windows; windows are named by their end."""
    by = by or []
    w = F.window(F.timestamp_micros(F.col("us")), f"{window_sec} seconds", f"{step_sec} seconds")
    return (
        rows.groupBy(w.alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.unix_micros(F.col("w.end")).alias("window_end_us"),
            *by,
            "n",
            (F.col("n") * F.lit(per_sec / window_sec)).alias("rate"),
        )
    )


def expose_metrics(counters: DataFrame, prefix: str = "seclog", headers: bool = False) -> DataFrame:
    """Counters as text exposition lines, with the HELP and TYPE lines of all metrics if asked for."""
    name = F.concat(F.lit(prefix + "_"), F.col("metric"))
    label = F.when(F.col("label") == "", "").otherwise(
        F.concat(F.lit('{severity="'), F.col("label"), F.lit('"}'))
    )
    lines = counters.select(F.concat(name, label, F.lit(" "), F.col("value")).alias("line"))
    if not headers:
        return lines
    described = F.explode(F.array(*map(F.lit, expose_headers(prefix)))).alias("line")
    return counters.sparkSession.range(1).select(described).unionByName(lines)


def expose_top_ips(top: DataFrame, prefix: str = "seclog") -> DataFrame:
    return top.select(
        F.format_string(
            prefix + '_ip_fails_total{ip="%s",country="%s"} %d', "src_ip", "country", "fails"
        ).alias("line")
    )


def expose_headers(prefix: str = "seclog") -> list[str]:
    """HELP and TYPE lines of all exposed metrics."""
    # Metric descriptions.
    described = (
        ("events_processed_total", "counter", "Total events processed"),
        ("ssh_fails_total", "counter", "Total SSH failures seen"),
        ("incidents_total", "counter", "Total incidents by severity"),
        ("blocks_total", "counter", "All-time blocks executed"),
        ("blocks_active", "gauge", "Currently blocked IPs"),
        ("ip_fails_total", "counter", "SSH failures per attacker IP"),
    )
    return [
        line
        for name, kind, text in described
        for line in (f"# HELP {prefix}_{name} {text}", f"# TYPE {prefix}_{name} {kind}")
    ]


def report_document(
    report: DataFrame, top: DataFrame, as_of_us: int, days: int, k: int = 10
) -> DataFrame:
    """The period report as one JSON text: totals and the ``k`` top attackers of ``top``."""
    totals = report.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("totals")
    )
    best = top.orderBy(F.desc("incident_count"), "src_ip").limit(k).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    (-F.col("incident_count")).alias("order"),
                    "src_ip",
                    "incident_count",
                    "max_severity",
                )
            )
        ).alias("top_attackers")
    )
    return totals.withColumn("top_attackers", best.scalar()).select(
        F.to_json(
            F.struct(
                F.lit(days).alias("period_days"),
                iso_from_micros(F.lit(as_of_us)).alias("generated_at"),
                iso_from_micros(F.lit(as_of_us - days * DAY_US)).alias("since"),
                "totals",
                F.transform(
                    "top_attackers",
                    lambda a: F.struct(a["src_ip"], a["incident_count"], a["max_severity"]),
                ).alias("top_attackers"),
            )
        ).alias("document")
    )
