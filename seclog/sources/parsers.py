"""Log-line parsers: Column of text in, event struct Column out, null when the line is dropped.

A parser is a function ``line -> struct(kind, src_ip, dst_ip, user, meta)``. All
of them are Catalyst expressions; each pattern runs once per line and its groups
are split out of one rewritten string. A line must hold no newline; white space
around it does not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclog.functions.binding import let, only_if
from seclog.schema import NET_HINT, SEC_EVENT, meta_struct

# --- Fixed values: line formats and word lists the parsers recognise. -------------
_ADDRESS = r"([0-9a-fA-F.:]+)"
SSHD_PREFIX = r"sshd(?:-session)?\[\d+\]:\s+"
SSHD_ACCEPTED = SSHD_PREFIX + r"Accepted\s+(?:password|publickey)\s+for\s+(\S+)\s+from\s+" + _ADDRESS
SSHD_FAILURES = (
    "Failed password",
    "authentication failure",
    "Invalid user",
    "error: PAM: Authentication failure",
    "Connection closed by authenticating user",
)
SSHD_FAILED = SSHD_PREFIX + "(?:" + "|".join(SSHD_FAILURES) + r").*?(?:from|rhost=)\s*" + _ADDRESS
SSHD_FAILED_USER = r"for invalid user\s+(\S+)|for\s+(\S+)"

ACCESS_LINE = (
    _ADDRESS
    + r"\s+-\s+-\s+\[.*?\]\s+"
    + r'"(\w+)\s+(\S+)\s+HTTP/[\d.]+"\s+'
    + r"(\d{3})\s+(?:\d+|-)"
    + r'(?:\s+"[^"]*"\s+"([^"]*)")?'
)
ATTACK_PATHS = (
    r"/\.env", "/wp-admin", "/wp-login", "/phpmyadmin", "/admin", "/config", r"\.php\?",
    "/cgi-bin", "/xmlrpc", "/shell", "/cmd", "/passwd", "/etc/", "/proc/", r"\.git/",
    "/backup", "/dump", "/sql",
)
SCANNER_AGENTS = (
    "sqlmap", "nikto", "nmap", "masscan", "zgrab", "dirbuster", "gobuster", "nuclei",
    "wfuzz", "hydra", "medusa", "metasploit", "nessus", "burpsuite", "python-requests/",
    "go-http-client", "curl/[0-9]",
)
MYSQL_DENIED = r"Access denied for user '([^']+)'@'" + _ADDRESS + "'"
FIREWALL_LINE = r"\[UFW (BLOCK|ALLOW|LIMIT)\].*?SRC=" + _ADDRESS + r".*?DST=" + _ADDRESS
FIREWALL_PORT = r"DPT=(\d+)"
DECOY_PORTS = (23, 2323, 3389, 5900, 5985, 6379, 27017, 9200)
SUDO_FAILED = r"sudo:.*NOT in sudoers|sudo:.*authentication failure"
SUDO_USER = r"sudo:\s+(\S+)\s+:"
SU_FAILED = r"su\[\d+\].*FAILED su for (\S+) by (\S+)"
PACKET_ADDRESSES = (
    r"IP6?\s+([0-9a-fA-F.:]+?)(?:\.\d+)?\s+>\s+([0-9a-fA-F.:]+?)(?:\.\d+)?[\s:]"
)
ARP_REQUEST = r"who-has\s+([\d.]+)\s+tell\s+([\d.]+)"
ARP_REPLY = r"([\d.]+)\s+is-at\s+([0-9a-f:]{17})"
DNS_NAME = r"A\?\s+([\w.-]+)\."
DNS_POINTER = r"PTR\?\s+([\w.-]+)\."
MDNS_SERVICE = r"_([\w-]+)\._tcp\.local"
SSH_PORT = r"\.22\s+>|>\s+\.22\s"
WEB_TIME = r"\[(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4})\]"
ISO_TIME = r"^\s*(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2}))"
SYSLOG_HOST = (
    r"^\s*(?:[A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2}|\d{4}-\S+) (\S+) [A-Za-z][\w-]*(?:\[\d+\])?:"
)
SYSLOG_TIME = r"([A-Z][a-z]{2}) +(\d{1,2}) (\d{2}:\d{2}:\d{2})"
# ----------------------------------------------------------------------------------

LineParser = Callable[[Column], Column]


def _no_case(pattern: str) -> str:
    return "(?i)" + pattern


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null when absent or empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _groups(text: Column, pattern: str, count: int, anchored: bool = False) -> Column:
    """All groups of the first match as an array, null when there is no match."""
    start = r"^\s*" if anchored else "^.*?"
    flags = "(?s)"
    if pattern.startswith("(?i)"):
        flags, pattern = "(?is)", pattern[4:]
    joined = F.regexp_replace(
        text, f"{flags}{start}{pattern}.*$", "\n".join(f"${i + 1}" for i in range(count))
    )
    return only_if(F.split(joined, "\n", -1), lambda parts: F.size(parts) == count)


def _event(kind: Column, **fields: Column) -> Column:
    meta = fields.pop("meta", None)
    text = {n: fields.get(n, F.lit(None)).cast("string").alias(n) for n in ("src_ip", "dst_ip", "user")}
    return F.when(
        kind.isNotNull(),
        F.struct(
            kind.alias("kind"),
            *text.values(),
            (meta_struct() if meta is None else meta).alias("meta"),
        ),
    )


def parse_sshd(line: Column) -> Column:
    """SSH logins; a success pattern wins over a failure pattern.

    Plain substring checks come first: most lines need at most one pattern.
    """

    def judge(text: Column) -> Column:
        low = F.lower(text)
        failures = reduce(lambda a, b: a | b, [low.contains(f.lower()) for f in SSHD_FAILURES])
        user = F.coalesce(
            _found(text, _no_case(SSHD_FAILED_USER), 1), _found(text, _no_case(SSHD_FAILED_USER), 2)
        )
        failed = let(
            F.when(failures, _found(text, _no_case(SSHD_FAILED))),
            lambda ip: _event(F.when(ip.isNotNull(), "SSH_FAIL"), src_ip=ip, user=user),
        )
        accepted = F.when(low.contains("accepted"), _groups(text, _no_case(SSHD_ACCEPTED), 2))
        return let(
            accepted,
            lambda part: F.when(
                part.isNotNull(), _event(F.lit("SSH_SUCCESS"), src_ip=part[1], user=part[0])
            ).otherwise(failed),
        )

    return F.when(F.lower(line).contains("sshd"), judge(line))


def attack_path(path: Column) -> Column:
    return path.rlike(_no_case("|".join(ATTACK_PATHS)))


def scanner_agent(agent: Column) -> Column:
    return agent.rlike(_no_case("|".join(SCANNER_AGENTS)))


def _threat_score(post: Column, status: Column, attack: Column, scanner: Column) -> Column:
    return (
        F.when(status.isin(401, 403), 2).when(status == 404, 1).otherwise(0)
        + F.when(attack, 3).otherwise(0)
        + F.when(scanner, 2).otherwise(0)
        + F.when(attack & post, 2).otherwise(0)
    )


def web_threat_score(method: Column, path: Column, status: Column, agent: Column) -> Column:
    return _threat_score(method == "POST", status, attack_path(path), scanner_agent(agent))


def parse_web_access(line: Column) -> Column:
    """Combined-format access lines; an attack path outranks the status."""

    def judge(part: Column) -> Column:
        method, path, agent = part[1], part[2], part[4]
        seen = F.struct(
            part[3].cast("int").alias("status"),
            attack_path(path).alias("attack"),
            scanner_agent(agent).alias("scanner"),
        )

        def event(s: Column) -> Column:
            status, attack, scanner = s["status"], s["attack"], s["scanner"]
            kind = (
                F.when(attack, "WEB_EXPLOIT_ATTEMPT")
                .when(status.isin(401, 403), "WEB_AUTH_FAIL")
                .when((status == 404) | scanner, "WEB_SCAN")
            )
            meta = meta_struct(
                method=method,
                path=path,
                status=status,
                ua=agent,
                threat_score=_threat_score(method == "POST", status, attack, scanner),
            )
            return _event(kind, src_ip=part[0], meta=meta)

        return F.when(part.isNotNull(), let(seen, event))

    return let(_groups(line, ACCESS_LINE, 5, anchored=True), judge)


def parse_mysql_denied(line: Column) -> Column:
    return let(
        _groups(line, _no_case(MYSQL_DENIED), 2),
        lambda part: _event(
            F.when(part.isNotNull(), "DB_AUTH_FAIL"),
            src_ip=part[1],
            user=part[0],
            meta=meta_struct(db=F.lit("mysql")),
        ),
    )


def parse_firewall(line: Column) -> Column:
    """Blocked packets (upper-case BLOCK only); decoy ports have their own kind."""
    port = F.coalesce(_found(line, FIREWALL_PORT).cast("int"), F.lit(0))

    def event(part: Column) -> Column:
        def with_port(dpt: Column) -> Column:
            kind = F.when(dpt.isin(*DECOY_PORTS), "FW_HONEYPOT_PORT").otherwise("FW_BLOCK")
            meta = meta_struct(dst_port=dpt, action=part[0])
            return _event(kind, src_ip=part[1], dst_ip=part[2], meta=meta)

        return F.when(part[0] == "BLOCK", let(port, with_port))

    found = let(_groups(line, _no_case(FIREWALL_LINE), 3), event)
    return F.when(F.lower(line).contains("[ufw "), found)


def parse_privilege(line: Column) -> Column:
    """Failed sudo and su; these lines carry no address (see attribute_privilege)."""
    kind_of_abuse = F.lit("privilege_escalation")
    sudo = _event(
        F.lit("SUDO_FAIL"), user=_found(line, SUDO_USER), meta=meta_struct(type=kind_of_abuse)
    )
    su = let(
        _groups(line, _no_case(SU_FAILED), 2),
        lambda part: _event(
            F.when(part.isNotNull(), "SU_FAIL"),
            user=part[1],
            meta=meta_struct(target_user=part[0], type=kind_of_abuse),
        ),
    )
    return F.when(line.rlike(_no_case(SUDO_FAILED)), sudo).when(
        F.lower(line).contains("failed su"), su
    )


def packet_hint(line: Column) -> Column:
    """What a packet line hints at; the first rule that matches decides."""

    def judge(text: Column) -> Column:
        def has(*words: str) -> Column:
            return reduce(lambda a, b: a | b, [text.contains(w) for w in words])

        return (
            F.when(has(" arp", "who-has") | text.startswith("arp,"), "DISCOVERY")
            .when(has(".mdns", " mdns", "_googlecast"), "DISCOVERY")
            .when(has(" nbns", " netbios", " smb"), "ENUM_HINT")
            .when(text.rlike(r"\.(445|139)\b"), "ENUM_HINT")
            .when(has(" tcp ") & has(".22 "), "SSH_NET")
        )

    return let(F.ltrim(F.lower(line)), judge)


def parse_packet_hint(line: Column) -> Column:
    addresses = _groups(line, PACKET_ADDRESSES, 2)

    def event(hint: Column) -> Column:
        known = let(
            addresses,
            lambda part: _event(
                F.lit(NET_HINT), src_ip=part[0], dst_ip=part[1], meta=meta_struct(hint=hint)
            ),
        )
        return F.when(hint.isNotNull(), known)

    return let(packet_hint(line), event)


# Parser and source label per log source; extend with ``register_parser``.
PARSERS: dict[str, LineParser] = {
    "auth": parse_sshd,
    "net": parse_packet_hint,
    "nginx": parse_web_access,
    "apache": parse_web_access,
    "mysql": parse_mysql_denied,
    "ufw": parse_firewall,
    "syslog": parse_privilege,
}


def register_parser(source: str, parser: LineParser) -> None:
    """Add a parser for a new log source; it must return the event struct or null."""
    PARSERS[source] = parser


def event_struct(kind: Column, **fields: Column) -> Column:
    """Build the struct a custom parser returns; a null ``kind`` drops the line."""
    return _event(kind, **fields)


def event_time(line: Column, year: int | Column, zone: str = "UTC") -> Column:
    """Time written in the line: access-log, ISO-8601 with offset, or syslog stamp."""
    year = F.lit(year) if isinstance(year, int) else year
    web = F.try_to_timestamp(_found(line, WEB_TIME), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    iso = _found(line, ISO_TIME).try_cast("timestamp")

    def dated(stamp: Column) -> Column:
        plain = F.try_to_timestamp(
            F.concat_ws(" ", year.cast("string"), stamp), F.lit("yyyy MMM d HH:mm:ss")
        )
        return F.when(stamp.isNotNull(), plain if zone == "UTC" else F.to_utc_timestamp(plain, zone))

    return F.coalesce(iso, web, let(_groups(line, SYSLOG_TIME, 3, anchored=True), dated))


def parse_lines(
    lines: DataFrame,
    source: str,
    year: int | Column,
    line: str = "line",
    event_id: str = "event_id",
    arrived: Column | None = None,
) -> DataFrame:
    """Parse one source's lines into events; lines the parser drops are filtered out.

    The event time is the time in the line, or ``arrived`` where the line has none.
    """
    return _as_events(lines, PARSERS[source](F.col(line)), F.lit(source), year, line, event_id, arrived)


def parse_mixed(
    lines: DataFrame,
    year: int | Column,
    source: str = "source",
    sources: Sequence[str] | None = None,
    line: str = "line",
    event_id: str = "event_id",
    arrived: Column | None = None,
) -> DataFrame:
    """Parse a table with lines of several sources in one read, each line by the parser of its source.

    Lines of a source without parser (or not among ``sources``) are dropped, as are those their parser drops.
    """
    label = F.col(source)
    chosen = F.lit(None)
    for name in PARSERS if sources is None else sources:
        chosen = F.when(label == name, PARSERS[name](F.col(line))).otherwise(chosen)
    return _as_events(lines, chosen, label, year, line, event_id, arrived)


def _as_events(
    lines: DataFrame, event: Column, label: Column, year: int | Column, line: str, event_id: str, arrived: Column | None
) -> DataFrame:
    # The one-element explode keeps the parse in one place: a filter on a plain column
    # would be pushed below the projection and run the patterns twice.
    parsed = lines.select(
        F.col(event_id).alias("event_id"),
        F.col(line).alias("raw"),
        label.alias("source"),
        *([] if arrived is None else [arrived.alias("arrived")]),
        F.explode(F.array(event)).alias("ev"),
    ).filter(F.col("ev").isNotNull())
    stamp = event_time(F.col("raw"), year)
    return parsed.select(
        "event_id",
        (stamp if arrived is None else F.coalesce(stamp, F.col("arrived"))).alias("ts"),
        "source",
        F.col("ev.kind").alias("kind"),
        F.col("ev.src_ip").alias("src_ip"),
        F.col("ev.dst_ip").alias("dst_ip"),
        F.col("ev.user").alias("user"),
        _found(F.col("raw"), SYSLOG_HOST).alias("host"),
        "raw",
        F.col("ev.meta").alias("meta"),
    ).to(SEC_EVENT)


def union_sources(*events: DataFrame) -> DataFrame:
    """All sources as one event table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), events)


def network_identity(line: Column, src_ip: Column) -> Column:
    """What a packet line tells about hosts: array of (ip, attribute, value).

    An ARP line says nothing else; other lines describe ``src_ip``.
    """

    def fact(ip: Column, attribute: str, value: Column) -> Column:
        return F.struct(
            ip.alias("ip"), F.lit(attribute).alias("attribute"), value.cast("string").alias("value")
        )

    lower = F.lower(line)
    known = src_ip.isNotNull()

    def about_source(hostname: Column, service: Column) -> Column:
        smb = lower.contains(" smb") | lower.contains(" nbns")
        return F.array_compact(
            F.array(
                F.when(known & hostname.isNotNull(), fact(src_ip, "hostname", hostname)),
                F.when(known & service.isNotNull(), fact(src_ip, "service", service)),
                F.when(known & smb, fact(src_ip, "service", F.lit("smb"))),
                F.when(known & line.rlike(SSH_PORT), fact(src_ip, "service", F.lit("ssh"))),
            )
        )

    name = F.coalesce(_found(line, _no_case(DNS_NAME)), _found(line, _no_case(DNS_POINTER)))
    other = let(name, lambda n: let(_found(lower, MDNS_SERVICE), lambda s: about_source(n, s)))
    reply = let(
        _groups(line, _no_case(ARP_REPLY), 2),
        lambda part: F.when(
            part.isNotNull(), F.array(fact(part[0], "mac", F.lower(part[1])))
        ).otherwise(other),
    )
    return let(
        _found(lower, ARP_REQUEST, 2),
        lambda sender: F.when(
            sender.isNotNull(), F.array(fact(sender, "seen", F.lit(None)))
        ).otherwise(reply),
    )
