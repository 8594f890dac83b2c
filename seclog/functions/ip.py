"""Address validity and classification as Column expressions (no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seclog.functions.binding import let

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = rf"^({_OCTET}\.){{3}}{_OCTET}$"

# Networks that count as local.
PRIVATE_IPV4 = (
    ("10.0.0.0", 8),
    ("172.16.0.0", 12),
    ("192.168.0.0", 16),
    ("127.0.0.0", 8),
    ("169.254.0.0", 16),
)
PRIVATE_IPV6_FIRST_BYTES = ("fc", "fd")  # fc00::/7; ::1/128 is checked on its own


def is_ipv4(ip: Column) -> Column:
    return ip.rlike(IPV4_PATTERN)


def ipv4_to_long(ip: Column) -> Column:
    """Address as a number, null unless it is a valid IPv4 literal."""

    def number(part: Column) -> Column:
        return sum((part[i].cast("long") * F.lit(256 ** (3 - i)) for i in range(4)), F.lit(0))

    return F.when(is_ipv4(ip), let(F.split(ip, r"\."), number))


def _long(ip: str) -> int:
    a, b, c, d = (int(x) for x in ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def _without_zone(ip: Column) -> Column:
    return F.regexp_replace(ip, "%[^%]+$", "")


def ipv6_groups(ip: Column) -> Column:
    """The eight lower-case groups of an IPv6 literal, each four digits; null if invalid."""
    none = F.array().cast("array<string>")

    def two_groups(number: Column) -> Column:
        return F.concat(
            F.lower(F.hex(F.shiftright(number, 16))),
            F.lit(":"),
            F.lower(F.hex(number.bitwiseAND(F.lit(0xFFFF)))),
        )

    def without_quad(text: Column) -> Column:
        # A trailing dotted quad stands for two groups; an invalid one makes all null.
        quad = F.regexp_extract(text, r":([0-9.]+)$", 1)
        plain = F.regexp_replace(text, r"[0-9.]+$", "")
        return F.when(
            quad.contains("."), F.concat(plain, let(ipv4_to_long(quad), two_groups))
        ).otherwise(text)

    def halves(text: Column) -> Column:
        return F.when(
            text.contains(":") & ~text.contains(":::"),
            F.transform(
                F.split(text, "::", -1),
                lambda half: F.when(half == "", none).otherwise(F.split(half, ":", -1)),
            ),
        )

    def filled(parts: Column) -> Column:
        left, right = parts[0], F.coalesce(F.get(parts, F.lit(1)), none)
        given = F.size(left) + F.size(right)
        zeros = F.array_repeat(F.lit("0"), F.lit(8) - given)
        return (
            F.when((F.size(parts) == 1) & (given == 8), left)
            .when((F.size(parts) == 2) & (given <= 7), F.concat(left, zeros, right))
        )

    def padded(groups: Column) -> Column:
        digits = F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(digits, F.transform(groups, lambda g: F.lpad(g, 4, "0")))

    text = let(F.lower(ip), without_quad)
    return F.when(ip.contains(":"), let(let(let(text, halves), filled), padded))


def is_valid_ip(ip: Column) -> Column:
    """True for an IPv4 or IPv6 literal; an IPv6 literal may carry a ``%zone``."""
    return F.coalesce(
        is_ipv4(ip) | ipv6_groups(_without_zone(ip)).isNotNull(), F.lit(False)
    )


def is_private(ip: Column) -> Column:
    """True for addresses in the local networks; invalid input gives false."""
    bare = F.substring_index(ip, "%", 1)

    def local_v4(number: Column) -> Column:
        inside = F.lit(False)
        for net, bits in PRIVATE_IPV4:
            low = _long(net)
            inside = inside | number.between(low, low + 2 ** (32 - bits) - 1)
        return inside

    def local_v6(groups: Column) -> Column:
        loopback = F.concat_ws("", groups) == "0" * 31 + "1"
        first_byte = F.substring(groups[0], 1, 2)
        return loopback | first_byte.isin(*PRIVATE_IPV6_FIRST_BYTES)

    judged = F.when(bare.contains(":"), let(ipv6_groups(bare), local_v6)).otherwise(
        let(ipv4_to_long(bare), local_v4)
    )
    return F.coalesce(judged, F.lit(False))


def network_of(address: Column, prefix_len: Column | int) -> Column:
    """First address of the IPv4 network of the given prefix length."""
    bits = F.lit(prefix_len) if isinstance(prefix_len, int) else prefix_len
    size = F.pow(F.lit(2), F.lit(32) - bits).cast("long")
    return address - F.pmod(address, size)


def ipv6_to_hex(ip: Column) -> Column:
    """Address as 32 lower-case hexadecimal digits, null unless it is a valid IPv6 literal; a ``%zone`` is ignored."""
    return let(ipv6_groups(_without_zone(ip)), lambda groups: F.when(groups.isNotNull(), F.array_join(groups, "")))


def ipv6_network_of(digits: Column, prefix_len: Column) -> Column:
    """First address of the IPv6 network of the given prefix length, as 32 hexadecimal digits."""
    whole, rest = F.floor(prefix_len / 4).cast("int"), prefix_len % 4
    digit = F.conv(F.substr(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    size = F.lit(16) / F.pow(F.lit(2), rest)
    part = F.when(rest > 0, F.lower(F.hex((digit - digit % size).cast("long")))).otherwise("")
    return F.rpad(F.concat(F.substr(digits, F.lit(1), whole), part), 32, "0")
