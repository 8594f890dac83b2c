"""Sliding-window counts per key in O(n log n), split over (key, time chunk).

A windowed count is the running sum up to an instant less the running sum up to
what has left the window. Both edges only move on, so unlike a moving RANGE frame
the cost does not grow with the window width.

Chunks overlap: an instant goes to its own (key, chunk) and to the next one if
it is still in a window there, so each chunk is complete in itself. The input
is read once; copies of an event at one instant are combined before the first
shuffle, and the second one (on key and chunk) serves all windows of all terms.
What a row counts for is a bit per term: rows stay narrow through both shuffles and the
sort, and the counts are only made as the sorted rows stream by.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seclog.config import HOUR_US
from seclog.operators.scan import CHUNK, changes, chunk_of, whole_groups


@dataclass(frozen=True)
class Count:
    """Rows matching ``where`` in the last ``window_us``.

    The lower edge ``now - window_us`` is inside the window unless ``strict``.
    """

    name: str
    where: Column
    window_us: int
    strict: bool = False

    @property
    def leaves_after(self) -> int:
        return self.window_us if self.strict else self.window_us + 1


@dataclass(frozen=True)
class Distinct(Count):
    """Distinct non-null ``value`` among rows matching ``where``."""

    value: Column | None = None


@dataclass(frozen=True)
class GapSum(Count):
    """Microseconds between the first and the last matching row in the window."""


#: Terms whose bits share a long.
_BITS = 62
#: Instants whose counts are made at a time.
_SLICE = 1 << 16


@dataclass(frozen=True)
class _Term:
    """A term without its columns, which do not travel: its bit, or the column of its value."""

    name: str
    after: int
    column: str
    bit: int = 0
    gaps: bool = False

    def rows(self, table: dict[str, np.ndarray], begin: int, end: int) -> np.ndarray:
        return (table[self.column][begin:end] >> self.bit) & 1


class _RunningCount:
    """Rows of a term before a position that only moves on."""

    def __init__(self, term: _Term, table: dict[str, np.ndarray]) -> None:
        self.term, self.table, self.at, self.total = term, table, 0, 0

    def before(self, positions: np.ndarray) -> np.ndarray:
        end = int(positions[-1])
        counts = self.term.rows(self.table, self.at, end) * self.table["n"][self.at : end]
        sums = self.total + np.concatenate(([0], np.cumsum(counts)))
        out = sums[positions - self.at]
        self.at, self.total = end, int(sums[-1])
        return out


def _distinct_edges(codes: np.ndarray, t: np.ndarray, group: np.ndarray, after: int) -> tuple[np.ndarray, np.ndarray]:
    """When values come to count and when they cease to, each sorted.

    A value counts once while any of its occurrences is in the window: a repeat inside the window
    comes to count when the occurrence before it leaves. One that the chunk does not hold has left every
    window before the chunk began.
    """
    there = np.flatnonzero(codes >= 0)
    order = there[np.lexsort((t[there], codes[there]))]
    again = (codes[order][1:] == codes[order][:-1]) & (group[order][1:] == group[order][:-1])
    enter = t[order].copy()
    enter[1:] = np.where(again, np.maximum(enter[1:], t[order][:-1] + after), enter[1:])
    return np.sort(enter), t[there] + after


def _gap_edges(hit: np.ndarray, t: np.ndarray, group: np.ndarray, after: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """When gaps come into the window, when they leave it, and the running sums of both.

    A gap belongs to the window from its later row until its earlier row leaves.
    """
    rows = np.flatnonzero(hit)
    now, before = t[rows][1:], t[rows][:-1]
    held = (group[rows][1:] == group[rows][:-1]) & (now > before) & (before + after > now)
    now, before = now[held], before[held]
    return now, before + after, np.concatenate(([0], np.cumsum(now - before)))


def _swept(
    batches: Iterator[pa.RecordBatch], key: str, chunk_us: int, longest: int, terms: Sequence[_Term]
) -> Iterator[pa.RecordBatch]:
    """Counts of all terms at the instants of whole (key, chunk) groups, sorted by time."""
    for rows in whole_groups(batches, [key, CHUNK]):
        group = np.cumsum(changes(rows, [key, CHUNK])) - 1
        us, chunk = (rows.column(c).to_numpy() for c in ("us", CHUNK))
        # one axis of time on which groups lie further apart than any window is long
        t = us - (chunk * chunk_us - longest) + group * (chunk_us + 3 * longest)
        table = {c: rows.column(c).to_numpy() for c in rows.column_names if c.startswith("__word")} | {"n": rows.column("__n").to_numpy()}
        first = np.concatenate(([True], t[1:] != t[:-1]))
        instants = np.flatnonzero(first & (us // chunk_us == chunk))
        edges, sums = {}, {}
        for term in terms:
            if term.column.startswith("__value"):
                values = rows.column(term.column).combine_chunks().dictionary_encode()
                values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
                codes = values.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                edges[term.name] = _distinct_edges(codes, t, group, term.after)
            elif term.gaps:
                edges[term.name] = _gap_edges(term.rows(table, 0, len(t)) > 0, t, group, term.after)
            else:
                sums[term.name] = _RunningCount(term, table), _RunningCount(term, table)
        for begin in range(0, len(instants), _SLICE):
            picked = instants[begin : begin + _SLICE]
            at = t[picked]
            upto = np.searchsorted(t, at, "right")
            left = {after: np.searchsorted(t, at - after, "right") for after in {term.after for term in terms}}
            out = []
            for term in terms:
                if term.name in sums:
                    came, went = sums[term.name]
                    counts = came.before(upto) - went.before(left[term.after])
                else:
                    enter, leave, *total = edges[term.name]
                    came, went = np.searchsorted(enter, at, "right"), np.searchsorted(leave, at, "right")
                    counts = total[0][came] - total[0][went] if total else came - went
                out.append(pa.array(counts, pa.int64()))
            taken = pa.array(picked)
            keys, times = (rows.column(c).take(taken).combine_chunks() for c in (key, "us"))
            yield from pa.table([keys, times, *out], names=[key, "us", *[term.name for term in terms]]).to_batches()


def window_counts(
    events: DataFrame,
    terms: Sequence[Count],
    key: str = "src_ip",
    us: str = "us",
    chunk_us: int = HOUR_US,
) -> DataFrame:
    """One row per (key, instant) of ``events`` with every term's windowed count.

    Rows without key or instant are left out. A chunk is at least as long as
    the longest window, so an instant has at most one copy in a later chunk.
    """
    longest = max([1, *[t.leaves_after for t in terms]])
    chunk_us = max(chunk_us, longest)
    events = events.filter(F.col(key).isNotNull() & F.col(us).isNotNull())
    if us != "us":
        events = events.withColumn("us", F.col(us))
    words: dict[str, list[Column]] = {}
    values: dict[str, Column] = {}
    plain = []
    for t in terms:
        if isinstance(t, Distinct):
            column = f"__value{len(values)}"
            values[column] = F.when(t.where, t.value)
            plain.append(_Term(t.name, t.leaves_after, column))
        else:
            bit = len(plain) - len(values)
            column = f"__word{bit // _BITS}"
            words.setdefault(column, []).append(F.when(t.where, F.lit(1 << bit % _BITS).cast("long")).otherwise(0))
            plain.append(_Term(t.name, t.leaves_after, column, bit % _BITS, isinstance(t, GapSum)))
    own = chunk_of(F.col("us"), chunk_us)
    instants = events.groupBy(
        key,
        "us",
        *[reduce(lambda a, b: a.bitwiseOR(b), bits).alias(w) for w, bits in words.items()],
        *[value.alias(v) for v, value in values.items()],
    ).agg(F.count(F.lit(1)).alias("__n"))
    chunked = instants.withColumn(
        CHUNK, F.explode(F.sequence(own, chunk_of(F.col("us") + (longest - 1), chunk_us)))
    ).repartition(key, CHUNK)
    schema = T.StructType([events.schema[key], T.StructField("us", T.LongType()), *[T.StructField(t.name, T.LongType()) for t in plain]])
    return chunked.sortWithinPartitions(key, CHUNK, "us").mapInArrow(
        lambda batches: _swept(batches, key, chunk_us, longest, plain), schema
    )
