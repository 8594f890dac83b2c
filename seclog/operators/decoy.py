"""Decoy-session analytics over logged decoy records.

Records: ip, us, record_id, type (honeypot_connection, honeypot_credentials,
honeypot_command, honeypot_session_end), username, password, command.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seclog.config import SECOND_US
from seclog.operators.scan import Running, running

IDLE_SEC = 180  # a session ends after this long without a record


def with_session(records: DataFrame, idle_sec: int = IDLE_SEC) -> DataFrame:
    """Records with the start of their session (``session_us``), which names it with ``ip``.

    A record opens a session when the previous one of its address is at least
    ``idle_sec`` old; the session of a record is the latest opening so far.
    """
    session = Running(F.col("us"), "session", idle_sec * SECOND_US)
    return running(records.filter(F.col("ip").isNotNull()), ["ip"], "us", {"session_us": session}, tie="record_id")


def decoy_sessions(records: DataFrame, idle_sec: int = IDLE_SEC) -> DataFrame:
    """One row per session: start, end, duration, numbers of commands and login attempts."""
    return (
        with_session(records, idle_sec)
        .groupBy("ip", "session_us")
        .agg(
            F.max("us").alias("end_us"),
            F.count(F.when(F.col("type") == "honeypot_command", 1)).alias("commands"),
            F.count(F.when(F.col("type") == "honeypot_credentials", 1)).alias("auth_attempts"),
            F.count(F.lit(1)).alias("records"),
        )
        .withColumn("duration_us", F.col("end_us") - F.col("session_us"))
    )


def session_commands(records: DataFrame, idle_sec: int = IDLE_SEC) -> DataFrame:
    """The commands of all sessions in order: (ip, session_us, seq, command).

    One row per command: a session's number of commands has no bound.
    """
    commands = with_session(records, idle_sec).filter(F.col("type") == "honeypot_command")
    return running(
        commands, ["ip", "session_us"], "us", {"seq": Running(F.lit(1))}, tie="record_id"
    ).select("ip", "session_us", "seq", "us", "command")


def session_attempts(records: DataFrame, idle_sec: int = IDLE_SEC) -> DataFrame:
    """Login attempts of all sessions: (ip, session_us, us, username, password)."""
    return (
        with_session(records, idle_sec)
        .filter(F.col("type") == "honeypot_credentials")
        .select("ip", "session_us", "us", "username", "password")
    )


def recent_sessions(sessions: DataFrame, limit: int = 20) -> DataFrame:
    return sessions.orderBy(F.desc("session_us"), "ip").limit(limit)


def top_credentials(records: DataFrame, limit: int = 20) -> DataFrame:
    return (
        records.filter(F.col("type") == "honeypot_credentials")
        .groupBy("username", "password")
        .agg(F.count(F.lit(1)).alias("tries"))
        .orderBy(F.desc("tries"), "username", "password")
        .limit(limit)
    )


def top_commands(records: DataFrame, limit: int = 20) -> DataFrame:
    """Most used commands by their first word."""
    word = F.lower(F.element_at(F.split(F.btrim("command"), r"\s+"), 1))
    return (
        records.filter((F.col("type") == "honeypot_command") & (F.btrim("command") != ""))
        .groupBy(word.alias("word"))
        .agg(F.count(F.lit(1)).alias("uses"))
        .orderBy(F.desc("uses"), "word")
        .limit(limit)
    )
