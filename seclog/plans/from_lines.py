"""From raw log lines to incidents: parse, attribute, detect, correlate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from seclog.config import DetectionLimits
from seclog.operators import correlate as co
from seclog.operators import detect as de
from seclog.schema import with_micros
from seclog.sources.parsers import parse_mixed
from seclog.sources.staging import staged


def events_from_lines(lines: DataFrame, year: int | Column, attribution_sec: int) -> DataFrame:
    """Events of a table (event_id, source, line), with ``us``; failed sudo / su rows carry their login's address.

    Parsing costs more than all that follows, so its result is written once. Lines without a time, which no window
    can hold, and events without an address go.
    """
    parsed = staged(with_micros(parse_mixed(lines, year)), "events").dropna(subset=["us"])
    return co.with_attributed_privilege(parsed, attribution_sec).dropna(subset=["src_ip"])


def incidents_from_lines(
    lines: DataFrame,
    year: int | Column,
    limits: DetectionLimits = DetectionLimits(),
    rules: Sequence[co.RuleSpec] = co.DEFAULT_RULES,
    attribution_sec: int = 300,
) -> DataFrame:
    """Detected incidents and correlation alerts in incident form, all from one read of the lines."""
    events = events_from_lines(lines, year, attribution_sec)
    alerts = co.correlation_alerts(co.correlate(events, rules, limits.chunk_us), rules)
    return de.incidents(events, limits).unionByName(co.alerts_as_incidents(alerts), allowMissingColumns=True)
