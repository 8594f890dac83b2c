"""Alerts routed to channels as rows of an outbox table; delivery is left to a sender."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclog.functions.markup import alert_text, embed_payload, webhook_payload
from seclog.functions.scalar import at_least

GEO_FIELDS = ("country", "city", "isp", "proxy", "hosting")


@dataclass(frozen=True)
class Channel:
    """An outgoing channel; ``style`` is ``text``, ``embed`` or ``json``."""

    name: str
    style: str = "text"
    enabled: bool = True


DEFAULT_CHANNELS = (
    Channel("telegram", "text"),
    Channel("discord", "embed"),
    Channel("slack", "text"),
    Channel("webhook", "json"),
)


def _geo(alerts: DataFrame) -> dict[str, Column]:
    kinds = {"proxy": "boolean", "hosting": "boolean"}
    return {
        f: F.col(f) if f in alerts.columns else F.lit(None).cast(kinds.get(f, "string"))
        for f in GEO_FIELDS
    }


def rendered(alerts: DataFrame, style: str, window_sec: int) -> Column:
    geo = _geo(alerts)
    ip, severity, reasons, us = (F.col(c) for c in ("src_ip", "severity", "reasons", "us"))
    fails, users = F.col("fail_count"), F.col("uniq_users")
    if style == "text":
        return alert_text(
            ip, severity, reasons, fails, users, F.lit(window_sec), us,
            geo["country"], geo["city"], geo["isp"],
            F.coalesce(geo["proxy"], F.lit(False)), F.coalesce(geo["hosting"], F.lit(False)),
        )
    if style == "embed":
        return embed_payload(ip, severity, reasons, fails, users, us, geo["country"])
    if style == "json":
        return webhook_payload(
            ip, severity, reasons, fails, us, F.struct(*[c.alias(n) for n, c in geo.items()])
        )
    raise ValueError(f"unknown style {style!r}")


def route_channels(
    alerts: DataFrame,
    channels: Sequence[Channel] = DEFAULT_CHANNELS,
    minimum: str = "MEDIUM",
    window_sec: int = 60,
) -> DataFrame:
    """One outbox row per alert at or above ``minimum`` and enabled channel."""
    enabled = [c for c in channels if c.enabled]
    rows = alerts.filter(at_least(F.col("severity"), minimum))
    if not enabled:
        return rows.select("src_ip", "us", "severity", F.lit("").alias("channel"), F.lit("").alias("body")).limit(0)
    messages = F.array(
        *[
            F.struct(F.lit(c.name).alias("channel"), rendered(alerts, c.style, window_sec).alias("body"))
            for c in enabled
        ]
    )
    return rows.select("src_ip", "us", "severity", F.explode(messages).alias("m")).select(
        "src_ip", "us", "severity", "m.channel", "m.body"
    )
