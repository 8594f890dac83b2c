"""Scalar rules: severities, times, labels and response texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities in ascending order.
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")

# Path prefixes that make a file change critical or high.
CRITICAL_PREFIXES = (
    "/etc/passwd",
    "/etc/shadow",
    "/etc/gshadow",
    "/etc/sudoers",
    "/etc/sudoers.d",
    "/root/.ssh/authorized_keys",
    "/root/.ssh/id_rsa",
    "/etc/ld.so.preload",
    "/etc/pam.d/sshd",
    "/etc/pam.d/su",
)
HIGH_PREFIXES = (
    "/etc/crontab",
    "/etc/cron.d",
    "/etc/cron.daily",
    "/etc/hosts",
    "/etc/resolv.conf",
    "/etc/ssh/sshd_config",
    "/sbin/init",
    "/bin/bash",
    "/bin/sh",
    "/usr/bin/sudo",
    "/etc/profile",
    "/etc/bashrc",
    "/etc/environment",
)
KEY_FILE_MARK = "authorized_keys"

# Follow-up steps listed with an incident, by severity and trigger.
BLOCK_STEP = "[AUTO] TEMP-BLOCK "
STEPS_AFTER_LOGIN = (
    "[MANUAL] Audit the successful session — check what was accessed",
    "[MANUAL] Rotate SSH credentials and keys immediately",
    "[MANUAL] Check for new cron jobs, authorized_keys, .bashrc changes",
)
STEPS_AFTER_DECOY_PORT = (
    "[MANUAL] Check if this IP is scanning other ports too",
    "[MANUAL] Consider permanent block if attack persists",
)
STEPS_OTHER_HIGH = (
    "[MANUAL] Review open ports and firewall rules",
    "[MANUAL] Check server logs for signs of compromise",
)
MONITOR_STEP = ("[PLAN] Monitor ", " for further activity")
STEPS_MONITOR = (
    "[PLAN] Consider fail2ban / rate-limiting",
    "[PLAN] Check AbuseIPDB / Shodan for known-bad IP info",
)

GLOBE = "\U0001f310"
HOUSE = "\U0001f3e0"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_INDICATORS = "".join(chr(0x1F1E6 + i) for i in range(26))


def severity_rank(severity: Column) -> Column:
    """LOW 0 < MEDIUM 1 < HIGH 2 < CRITICAL 3; anything else ranks lowest."""
    rank = F.lit(0)
    for i, name in enumerate(SEVERITIES):
        rank = F.when(severity == name, i).otherwise(rank)
    return rank


def severity_of_rank(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank + 1)


def at_least(severity: Column, minimum: Column | str) -> Column:
    minimum = F.lit(minimum) if isinstance(minimum, str) else minimum
    return severity_rank(severity) >= severity_rank(minimum)


def country_flag(code: Column) -> Column:
    """Two-letter country code as a flag, a globe for any other length."""
    return F.when(F.length(code) == 2, F.translate(code, _LETTERS, _INDICATORS)).otherwise(
        F.lit(GLOBE)
    )


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_from_micros(us: Column) -> Column:
    return iso_time(F.timestamp_micros(us))


def time_ago(seconds: Column) -> Column:
    """``Ns ago``, ``Nm ago``, ``Nh ago`` or ``Nd ago``, rounded down."""

    def unit(size: int, letter: str) -> Column:
        return F.concat(F.floor(seconds / size).cast("string"), F.lit(f"{letter} ago"))

    return (
        F.when(seconds < 60, unit(1, "s"))
        .when(seconds < 3600, unit(60, "m"))
        .when(seconds < 86400, unit(3600, "h"))
        .otherwise(unit(86400, "d"))
    )


def _starts_with_any(path: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [path.startswith(p) for p in prefixes])


def file_severity(path: Column) -> Column:
    return (
        F.when(_starts_with_any(path, CRITICAL_PREFIXES) | path.contains(KEY_FILE_MARK), "CRITICAL")
        .when(_starts_with_any(path, HIGH_PREFIXES), "HIGH")
        .otherwise("MEDIUM")
    )


def response_plan(severity: Column, ip: Column, trigger: Column) -> Column:
    """Follow-up steps as an array of strings."""

    def steps(first: Column, texts: tuple[str, ...]) -> Column:
        return F.array(first, *[F.lit(t) for t in texts])

    block = F.concat(F.lit(BLOCK_STEP), ip)
    monitor = F.concat(F.lit(MONITOR_STEP[0]), ip, F.lit(MONITOR_STEP[1]))
    high = (
        F.when(trigger == "success", steps(block, STEPS_AFTER_LOGIN))
        .when(trigger == "fw", steps(block, STEPS_AFTER_DECOY_PORT))
        .otherwise(steps(block, STEPS_OTHER_HIGH))
    )
    return F.when(severity == "HIGH", high).otherwise(steps(monitor, STEPS_MONITOR))


def response_decision(
    severity: Column,
    enabled: bool = False,
    minimum: str = "HIGH",
    mode: str = "drop",
    dry_run: bool = True,
) -> Column:
    """What active response would be taken; carrying it out is left to the host."""
    if not enabled:
        return F.lit("disabled")
    action = f"dry_run:{mode}" if dry_run else mode
    return F.when(at_least(severity, minimum), action).otherwise("severity_below_threshold")
