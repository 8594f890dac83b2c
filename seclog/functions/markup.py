"""Alert texts and outgoing payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seclog.functions.scalar import iso_from_micros

# Characters with a meaning in the chat markup, and embed colours.
MARKUP_CHARACTERS = r"([_*`\[])"
EMBED_COLOURS = {"HIGH": 0xFF0000, "MEDIUM": 0xFF8C00, "LOW": 0x3498DB}
EMBED_COLOUR_OTHER = 0x95A5A6


def escape_markup(text: Column) -> Column:
    return F.regexp_replace(text, MARKUP_CHARACTERS, r"\\$1")


def alert_text(
    src_ip: Column,
    severity: Column,
    reasons: Column,
    fail_count: Column,
    uniq_users: Column,
    window_sec: Column,
    us: Column,
    country: Column,
    city: Column,
    isp: Column,
    proxy: Column,
    hosting: Column,
) -> Column:
    """The alert as a multi-line text; unknown geo fields may be null."""
    place = escape_markup(F.coalesce(country, F.lit("Unknown")))
    town = escape_markup(F.coalesce(city, F.lit("")))
    provider = escape_markup(F.coalesce(isp, F.lit("")))
    tags = F.concat(
        F.when(proxy, " [PROXY/VPN]").otherwise(""), F.when(hosting, " [DATACENTER]").otherwise("")
    )
    lines = F.array(
        F.concat(F.lit("*ALERT — "), severity, F.lit("*")),
        F.lit(""),
        F.concat(F.lit("IP:       `"), src_ip, F.lit("`"), tags),
        F.concat(F.lit("Location: "), place, F.when(town != "", F.concat(F.lit(", "), town)).otherwise("")),
        F.when(provider != "", F.concat(F.lit("ISP:      "), provider)).otherwise(""),
        F.lit(""),
        F.lit("Stats:"),
        F.concat(F.lit("  Fails:        "), fail_count, F.lit(" (window: "), window_sec, F.lit("s)")),
        F.concat(F.lit("  Unique users: "), uniq_users),
        F.lit(""),
        F.lit("Reasons:"),
    )
    listed = F.transform(reasons, lambda r: F.concat(F.lit("  - "), escape_markup(r)))
    tail = F.array(F.lit(""), F.concat(F.lit("Time: "), iso_from_micros(us)))
    return F.array_join(F.concat(lines, listed, tail), "\n")


def webhook_payload(
    src_ip: Column, severity: Column, reasons: Column, fail_count: Column, us: Column, geo: Column
) -> Column:
    return F.to_json(
        F.struct(
            F.lit("security_alert").alias("type"),
            iso_from_micros(us).alias("time"),
            src_ip.alias("ip"),
            severity.alias("severity"),
            reasons.alias("reasons"),
            fail_count.alias("fail_count"),
            geo.alias("geo"),
        )
    )


def embed_payload(
    src_ip: Column,
    severity: Column,
    reasons: Column,
    fail_count: Column,
    uniq_users: Column,
    us: Column,
    country: Column,
) -> Column:
    colour = F.lit(EMBED_COLOUR_OTHER)
    for name, value in EMBED_COLOURS.items():
        colour = F.when(severity == name, value).otherwise(colour)

    def field(name: str, value: Column, inline: bool | None = True) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            value.cast("string").alias("value"),
            F.lit(inline).cast("boolean").alias("inline"),
        )

    fields = F.array(
        field("IP", F.concat(F.lit("`"), src_ip, F.lit("`"))),
        field("Location", F.coalesce(country, F.lit("Unknown"))),
        field("Failed Logins", fail_count),
        field("Unique Users", uniq_users),
        field("Reasons", F.array_join(F.transform(reasons, lambda r: F.concat(F.lit("- "), r)), "\n"), None),
    )
    embed = F.struct(
        F.concat(F.lit("Alert — "), severity).alias("title"),
        colour.alias("color"),
        fields.alias("fields"),
        F.struct(iso_from_micros(us).alias("text")).alias("footer"),
    )
    return F.to_json(F.struct(F.array(embed).alias("embeds")))
