"""Tunable limits, one frozen dataclass per operator family."""

from __future__ import annotations

from dataclasses import dataclass, fields

SECOND_US = 1_000_000
HOUR_US = 3_600 * SECOND_US
DAY_US = 86_400 * SECOND_US


@dataclass(frozen=True)
class DetectionLimits:
    window_sec: int = 60
    fails: int = 8
    unique_users: int = 4
    success_after_fails: int = 5
    web_scan: int = 20
    web_auth_fail: int = 15
    db_fail: int = 5
    cooldown_sec: int = 120
    repeat_threshold: int = 3
    repeat_window_sec: int = 3600
    chunk_us: int = HOUR_US  # unit in which one address's history is split over tasks


@dataclass(frozen=True)
class ReputationLimits:
    flag_score: int = 50
    ttl_sec: int = 12 * 3600


@dataclass(frozen=True)
class BlockLimits:
    duration_sec: int = 900
    default_ttl_sec: int = 900
    heartbeat_sec: int = 30


@dataclass(frozen=True)
class BaselineLimits:
    min_observations: int = 10
    absence_sec: int = 7 * 86400
    active_days: int = 7
    spike_min_days: int = 3
    spike_min_count: int = 5
    spike_factor: int = 3


@dataclass(frozen=True)
class ForestLimits:
    trees: int = 100
    sample_size: int = 256
    seed: int = 42
    contamination: float = 0.05
    min_samples: int = 100
    cooldown_sec: int = 300
    window_sec: int = 60
    retrain_sec: int = 3600  # event time between two trainings of a stream
    buffer_sec: int = 7 * 86400  # newest span that a stream's model is trained on


# Accepted upper bounds per limit; every limit must be a positive integer.
UPPER_BOUNDS = {
    "window_sec": 3600,
    "fails": 1000,
    "unique_users": 100,
    "success_after_fails": 100,
    "cooldown_sec": 86400,
    "duration_sec": 86400 * 30,
}


def checked(limits: object) -> None:
    """Stop an operator whose limits make no sense: every one must be positive, however large it may be."""
    wrong = [p for p in problems(limits) if "must be positive" in p]
    if wrong:
        raise ValueError("; ".join(wrong))


def problems(limits: object) -> list[str]:
    """Names of the limits that are not positive or exceed their accepted bound."""
    found = []
    for f in fields(limits):
        value = getattr(limits, f.name)
        if isinstance(value, bool) or not isinstance(value, (int, float)) or value <= 0:
            found.append(f"{f.name} must be positive, got {value!r}")
        elif f.name in UPPER_BOUNDS and value > UPPER_BOUNDS[f.name]:
            found.append(f"{f.name} must be at most {UPPER_BOUNDS[f.name]}, got {value}")
    return found
