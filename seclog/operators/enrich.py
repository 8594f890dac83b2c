"""Geo, reputation and allowlist lookups as equi-joins on network prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclog.config import SECOND_US, ReputationLimits
from seclog.functions.ip import ipv4_to_long, ipv6_network_of, ipv6_to_hex, is_private, network_of
from seclog.functions.scalar import GLOBE, HOUSE, country_flag
from seclog.operators.scan import Running, running

ALL_PREFIXES = tuple(range(33))
ALL_PREFIXES_6 = tuple(range(129))

# Labels of local and unknown addresses.
LOCAL_COUNTRY, LOCAL_CODE, LOCAL_ISP = "Local/Private", "LO", "Local network"
UNKNOWN_COUNTRY, UNKNOWN_CODE = "Unknown", "??"

GEO_TEXT = ("country", "country_code", "city", "isp", "org", "asn")
GEO_BOOL = ("proxy", "hosting")


def _key(lo: Column, lo6: Column) -> Column:
    """One name for a network of either family; with the prefix length it is unique."""
    return F.coalesce(F.concat(F.lit("v4/"), lo), lo6)


def _proposed(addresses: DataFrame, ip: str, prefixes: Sequence[int], prefixes6: Sequence[int]) -> DataFrame:
    """(__ip, prefix_len, __net): per distinct address one network of each length; ``__net`` is null if it is no address."""
    distinct = addresses.select(F.col(ip).alias("__ip")).distinct()
    both = distinct.select("__ip", ipv4_to_long(F.col("__ip")).alias("__number"), ipv6_to_hex(F.col("__ip")).alias("__digits"))
    lengths = F.when(F.col("__number").isNotNull(), F.array(*map(F.lit, prefixes))).when(
        F.col("__digits").isNotNull(), F.array(*map(F.lit, prefixes6))
    )
    bits = F.col("prefix_len")
    return both.select("*", F.explode_outer(lengths).alias("prefix_len")).select(
        "__ip", "prefix_len", _key(network_of(F.col("__number"), bits), ipv6_network_of(F.col("__digits"), bits)).alias("__net")
    )


def _keyed(networks: DataFrame) -> DataFrame:
    lo6 = F.col("lo6") if "lo6" in networks.columns else F.lit(None).cast("string")
    return networks.withColumn("prefix_len", F.col("prefix_len").cast("int")).withColumn("__net", _key(F.col("lo"), lo6))


def matching_networks(
    addresses: DataFrame,
    networks: DataFrame,
    ip: str = "ip",
    prefixes: Sequence[int] = ALL_PREFIXES,
    prefixes6: Sequence[int] = ALL_PREFIXES_6,
) -> DataFrame:
    """(address, network) pairs where the network contains the address, IPv4 and IPv6.

    ``networks`` has ``prefix_len`` and the first address as ``with_network`` gives it (``lo``; ``lo6`` may be
    missing). Each distinct address proposes one network per prefix length and meets the table by equality -- no
    range comparison, so no nested-loop join and no pairs that fail. Name only the prefix lengths that occur to
    explode less.
    """
    proposed = _proposed(addresses, ip, prefixes, prefixes6).filter(F.col("__net").isNotNull())
    return proposed.join(_keyed(networks), ["prefix_len", "__net"]).drop("__net").withColumnRenamed("__ip", ip)


def geo_lookup(
    addresses: DataFrame,
    ranges: DataFrame,
    ip: str = "src_ip",
    prefixes: Sequence[int] = ALL_PREFIXES,
    prefixes6: Sequence[int] = ALL_PREFIXES_6,
) -> DataFrame:
    """One row per distinct address: location of the most specific network holding it."""
    have = set(ranges.columns)
    fields = [c for c in GEO_TEXT + GEO_BOOL if c in have]
    # Addresses are read once: proposals that meet no network stay, as rows without location.
    proposed = _proposed(addresses.filter(F.col(ip).isNotNull()), ip, prefixes, prefixes6)
    table = _keyed(ranges).withColumn("__met", F.lit(True))
    met = F.when(F.col("__met"), F.col("prefix_len"))
    found = (
        proposed.join(table, ["prefix_len", "__net"], "left")
        .groupBy("__ip")
        .agg(F.max_by(F.struct(*fields), met).alias("g"))
        .withColumnRenamed("__ip", ip)
    )
    return _located(found, have, ip)


def geo_lookup_by_range(addresses: DataFrame, ranges: DataFrame, ip: str = "src_ip") -> DataFrame:
    """``geo_lookup`` by one pass in order over addresses and networks, whatever prefix lengths occur.

    An address is one row here instead of 33 or 129 proposals; worth it where there are many different addresses.
    """
    fields = [c for c in GEO_TEXT + GEO_BOOL if c in ranges.columns]
    found = innermost_networks(addresses, flat_networks(ranges, fields), ip)
    met = F.when(F.col("network.prefix_len").isNotNull(), F.struct(*[F.col(f"network.{c}") for c in fields]))
    return _located(found.select(ip, met.alias("g")), set(fields), ip)


def _place(number: Column, digits: Column) -> tuple[Column, Column, Column]:
    """(family, us, digits) of an address: ``us`` goes by the leading bits, the digits by all of them."""
    four = F.lower(F.lpad(F.hex(number), 8, "0"))
    return (
        F.when(number.isNotNull(), 4).when(digits.isNotNull(), 6).alias("family"),
        F.coalesce(number, F.conv(F.substring(digits, 1, 15), 16, 10).cast("long")).alias("us"),
        F.coalesce(F.when(number.isNotNull(), four), digits),
    )


def _last_address(lo: Column, lo6: Column, bits: Column) -> tuple[Column, Column]:
    """The last address of a network, as number or digits."""
    rest = bits % 4
    whole = F.floor(bits / 4).cast("int")
    digit = F.conv(F.substr(lo6, whole + 1, F.lit(1)), 16, 10).cast("long")
    filled = F.lower(F.hex(digit + (F.lit(16) / F.pow(F.lit(2), rest) - 1).cast("long")))
    last6 = F.rpad(F.concat(F.substr(lo6, F.lit(1), whole), F.when(rest > 0, filled).otherwise("")), 32, "f")
    return lo + F.pow(F.lit(2), F.lit(32) - bits).cast("long") - 1, F.when(lo6.isNotNull(), last6)


def flat_networks(networks: DataFrame, fields: Sequence[str] = ()) -> DataFrame:
    """Nested networks as borders in order: (family, us, at, network), the innermost network from each border on.

    A network begins a stretch of its own and ends in one of the network around it, or of none; so the stretches are
    disjoint and each has the most specific network. ``network`` holds ``prefix_len`` (null: none) and ``fields``.
    Made once for a table, at most two rows a network.
    """
    lo6 = F.col("lo6") if "lo6" in networks.columns else F.lit(None).cast("string")
    one = (
        _keyed(networks.withColumn("lo6", lo6))
        .groupBy("__net", "prefix_len")
        .agg(F.first("lo").alias("lo"), F.first("lo6").alias("lo6"), F.max(F.struct("prefix_len", *fields)).alias("network"))
    )
    bits = F.col("prefix_len")
    wider = one.filter(bits > 0).select(F.col("__net").alias("child"), bits.alias("child_len"), "lo", "lo6", F.explode(F.sequence(F.lit(0), bits - 1)).alias("prefix_len"))
    wider = wider.select("child", "child_len", "prefix_len", _key(network_of(F.col("lo"), bits), ipv6_network_of(F.col("lo6"), bits)).alias("__net"))
    around = wider.join(one.select("__net", "prefix_len", "network"), ["__net", "prefix_len"]).groupBy("child", "child_len").agg(F.max_by("network", "prefix_len").alias("around"))
    both = one.join(around, (F.col("__net") == F.col("child")) & (bits == F.col("child_len")), "left")
    none = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in one.schema["network"].dataType.fields])
    # at one address: wide networks begin before narrow ones, addresses come next, narrow networks end before wide ones
    family, us, digits = _place(F.col("lo"), F.col("lo6"))
    begins = both.select(family, us, F.concat(digits, F.lit("0"), F.lpad(bits.cast("string"), 3, "0")).alias("at"), "network")
    family, us, digits = _place(*_last_address(F.col("lo"), F.col("lo6"), bits))
    ends = both.select(family, us, F.concat(digits, F.lit("2"), F.lpad((128 - bits).cast("string"), 3, "0")).alias("at"), F.coalesce("around", none).alias("network"))
    return begins.unionByName(ends)


def innermost_networks(addresses: DataFrame, borders: DataFrame, ip: str = "ip") -> DataFrame:
    """(ip, network): per distinct address the innermost network of ``flat_networks``, null for what is no address.

    Addresses and borders are dealt by ranges together; each address takes the latest border before it.
    """
    distinct = addresses.filter(F.col(ip).isNotNull()).select(F.col(ip).alias("ip")).distinct()
    family, us, digits = _place(ipv4_to_long(F.col("ip")), ipv6_to_hex(F.col("ip")))
    placed = distinct.select("ip", family, us, F.concat(digits, F.lit("1")).alias("at"))
    rows = placed.filter("family is not null").unionByName(borders, allowMissingColumns=True)
    found = running(rows, ["family"], "us", {"network": Running(F.col("network"), "last")}, tie="at")
    known = found.filter("ip is not null").select(F.col("ip").alias(ip), "network")
    return known.unionByName(placed.filter("family is null").select(F.col("ip").alias(ip)), allowMissingColumns=True)


def _located(found: DataFrame, have: set[str], ip: str) -> DataFrame:
    """Locations from (ip, g), with what is said of local and unknown addresses."""
    local = is_private(F.col(ip))

    def text(name: str, at_home: str, otherwise: str):
        known = F.col(f"g.{name}") if name in have else F.lit(None).cast("string")
        return F.when(local, at_home).otherwise(F.coalesce(known, F.lit(otherwise))).alias(name)

    def flag(name: str):
        known = F.col(f"g.{name}") if name in have else F.lit(None).cast("boolean")
        return F.when(local, False).otherwise(F.coalesce(known, F.lit(False))).alias(name)

    code = F.coalesce(F.col("g.country_code"), F.lit(UNKNOWN_CODE))
    return found.select(
        ip,
        text("country", LOCAL_COUNTRY, UNKNOWN_COUNTRY),
        text("country_code", LOCAL_CODE, UNKNOWN_CODE),
        text("city", "", ""),
        text("isp", LOCAL_ISP, ""),
        text("org", "", ""),
        text("asn", "", ""),
        flag("proxy"),
        flag("hosting"),
        F.when(local, HOUSE)
        .when(F.col("g").isNull(), GLOBE)
        .otherwise(country_flag(code))
        .alias("flag"),
    )


def geo_enrich(
    events: DataFrame,
    ranges: DataFrame,
    ip: str = "src_ip",
    prefixes: Sequence[int] = ALL_PREFIXES,
    prefixes6: Sequence[int] = ALL_PREFIXES_6,
) -> DataFrame:
    """Events with the location of their address.

    The lookup runs once per distinct address. The join back is on the address;
    the planner broadcasts the lookup when it measures small and splits hot
    addresses (adaptive skew join) when it does not.
    """
    return events.join(geo_lookup(events, ranges, ip, prefixes, prefixes6), ip, "left")


def reputation_enrich(
    events: DataFrame, reputation: DataFrame, limits: ReputationLimits = ReputationLimits()
) -> DataFrame:
    """Events with abuse score, reports and provider; ``flagged`` if bad and public.

    Of several records of an address the latest counts, so events are never multiplied.
    """
    side = one_per_address(reputation).select(
        F.col("ip").alias("src_ip"),
        "abuse_score",
        "total_reports",
        F.col("isp").alias("reputation_isp"),
        ((F.col("abuse_score") >= limits.flag_score) & F.col("is_public")).alias("__flag"),
    )
    return (
        events.join(side, "src_ip", "left")
        .withColumn("flagged", F.coalesce("__flag", F.lit(False)))
        .drop("__flag")
    )


def one_per_address(records: DataFrame, ip: str = "ip") -> DataFrame:
    """The latest record per address; without ``fetched_us``, the one with the highest score."""
    payload = [c for c in records.columns if c != ip]
    latest = F.coalesce("fetched_us", F.lit(0)) if "fetched_us" in payload else F.coalesce("abuse_score", F.lit(0))
    return records.groupBy(ip).agg(F.max_by(F.struct(*payload), latest).alias("r")).select(
        ip, *[F.col(f"r.{c}").alias(c) for c in payload]
    )


def fresh_records(records: DataFrame, as_of_us: int, ttl_sec: int, ip: str = "ip") -> DataFrame:
    """Latest record per address if it is younger than ``ttl_sec`` at ``as_of_us``.

    ``records`` carries ``fetched_us``; later fetches replace earlier ones.
    """
    payload = [c for c in records.columns if c != ip]
    latest = (
        records.filter(F.col("fetched_us") <= as_of_us)
        .groupBy(ip)
        .agg(F.max_by(F.struct(*payload), F.col("fetched_us")).alias("r"))
    )
    return latest.filter(as_of_us - F.col("r.fetched_us") < ttl_sec * SECOND_US).select(
        ip, *[F.col(f"r.{c}").alias(c) for c in payload]
    )


def lookup_worklist(
    addresses: DataFrame, records: DataFrame, as_of_us: int, ttl_sec: int, ip: str = "ip"
) -> DataFrame:
    """Addresses without a fresh record, to be fetched by a lookup service."""
    fresh = fresh_records(records, as_of_us, ttl_sec, ip)
    return addresses.select(ip).distinct().join(fresh, ip, "left_anti")


def outside_networks(
    rows: DataFrame,
    networks: DataFrame,
    ip: str = "src_ip",
    prefixes: Sequence[int] = ALL_PREFIXES,
    prefixes6: Sequence[int] = ALL_PREFIXES_6,
) -> DataFrame:
    """Rows whose address is in none of the networks (allowlist filter, CIDR-aware)."""
    inside = matching_networks(rows, networks, ip, prefixes, prefixes6).select(ip).distinct()
    return rows.join(inside, ip, "left_anti")


def outside_networks_by_range(rows: DataFrame, networks: DataFrame, ip: str = "src_ip") -> DataFrame:
    """``outside_networks`` by one pass in order, whatever prefix lengths occur."""
    inside = innermost_networks(rows, flat_networks(networks), ip).filter("network.prefix_len is not null")
    return rows.join(inside.select(ip), ip, "left_anti")
