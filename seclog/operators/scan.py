"""Running aggregates over one key's history that never put the key in one task.

A plain ``Window.partitionBy(key)`` sorts a whole key in a single task, so an
address that sends a third of all events stalls the job. Here rows are dealt by
ranges of (key, time): a long key has several partitions in a row. Each partition is
scanned in order by itself, and its last row also tells the state it ends with. Only the
first key of a partition can go on from the one before it, so one state per
partition is carried over the partitions in order, and then put into the rows of
those first keys. Rows are shuffled once and joined with nothing but these states.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seclog.sources.staging import staged

CHUNK = "__chunk"


@dataclass(frozen=True)
class Running:
    """One running value: ``how`` is ``"sum"``, ``"last"`` (not null), or ``"session"``.

    A session is a stretch of rows each less than ``gap`` after the one before; its value
    is the time of its first row, and ``value`` is not looked at.
    """

    value: Column | None
    how: str = "sum"
    gap: int = 0


def chunk_of(us: Column, chunk_us: int) -> Column:
    # A multiple of chunk_us divides exactly; plain us / chunk_us could round up.
    return ((us - F.pmod(us, F.lit(chunk_us))) / F.lit(chunk_us)).cast("long")


def changes(table: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    """True where a row's group differs from the row before it (row 0 is True)."""
    n = table.num_rows
    flags = np.zeros(n, dtype=bool)
    flags[:1] = True
    for name in names:
        column = table.column(name)
        if n > 1:
            flags[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return flags


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Re-cut sorted batches so that no group spans two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        same = held and all(
            held[0].column(n)[0] == batch.column(n)[batch.num_rows - 1] for n in names
        )
        held.append(batch)
        if same:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = int(np.flatnonzero(changes(table, names))[-1])
        if last:
            yield table.slice(0, last)
        held = table.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _fill(at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row the latest index in ``at`` so far that is not before ``first`` of its group, else -1."""
    latest = np.maximum.accumulate(at)
    return np.where(latest >= first, latest, -1)


class _Scanner:
    """Scans the sorted rows of one partition, table by table."""

    def __init__(self, keys: list[str], us: str, aggregates: dict[str, Running], peers: bool, current: bool) -> None:
        self.keys, self.us, self.aggregates, self.peers, self.current = keys, us, aggregates, peers, current
        self.key: tuple | None = None
        self.state: dict[str, object] = {}

    def key_at(self, table: pa.Table, row: int) -> tuple:
        return tuple(table.column(k)[row].as_py() for k in self.keys)

    def scan(self, table: pa.Table) -> tuple[dict[str, pa.Array], np.ndarray]:
        """Values of each aggregate, and which rows are of the key that the partition began with."""
        n = table.num_rows
        starts = changes(table, self.keys)
        goes_on = self.key == self.key_at(table, 0)
        if not goes_on:
            self.state = {}
        group = np.cumsum(starts) - 1
        first = np.flatnonzero(starts)[group]
        known = goes_on & (group == 0)  # rows that the state so far is about
        us = table.column(self.us).to_numpy()
        shown = np.arange(n)
        if self.peers:
            instant = changes(table, [*self.keys, self.us])
            ends = np.r_[np.flatnonzero(instant)[1:], n] - 1
            shown = ends[np.cumsum(instant) - 1]
        out = {}
        for name, a in self.aggregates.items():
            before = self.state.get(name)
            value = table.column(f"__v_{name}")
            value = value.combine_chunks() if isinstance(value, pa.ChunkedArray) else value
            if a.how == "sum":
                v = pc.fill_null(value, 0).to_numpy(zero_copy_only=False)
                total = np.cumsum(v)
                total = total - (total - v)[first] + np.where(known, before or 0, 0)
                self.state[name] = total[-1].item()
                seen = total[shown] if self.current else np.where(np.arange(n) > first, np.roll(total, 1), np.where(known, before or 0, 0))
                out[name] = pa.array(seen, value.type)
            elif a.how == "last":
                filled = _fill(np.where(value.is_valid().to_numpy(zero_copy_only=False), np.arange(n), -1), first)
                seen = filled[shown] if self.current else np.where(np.arange(n) > first, np.roll(filled, 1), -1)
                # behind the values lies the one that the state holds
                pool = pa.concat_arrays([value, pa.array([before], value.type)])
                pick = np.where((seen < 0) & known, n, seen)
                out[name] = pool.take(pa.array(pick, pa.int64(), mask=pick < 0))
                end = n if filled[-1] < 0 and known[-1] else filled[-1]
                self.state[name] = pool[int(end)].as_py() if end >= 0 else None
            else:
                gap = np.r_[0, us[1:] - us[:-1]]
                opens = starts | (gap >= a.gap)
                if goes_on:
                    opens[0] = us[0] - before[0] >= a.gap
                filled = _fill(np.where(opens, np.arange(n), -1), first)
                begun = np.where(filled < 0, before[1] if goes_on else 0, us[np.maximum(filled, 0)])
                out[name] = pa.array(begun, pa.int64())
                self.state[name] = (int(us[-1]), int(begun[-1]))
        self.key = self.key_at(table, n - 1)
        return out, group == 0


def _carried(ends: dict[int, Row], aggregates: dict[str, Running]) -> list[tuple]:
    """(partition, state to put in) for partitions whose first key began in an earlier one."""
    out, key, state = [], None, {}
    for part, end in sorted(ends.items()):
        mine = {n: end[f"end_{n}"] for n in aggregates}
        if key is not None and tuple(end["first_key"]) == key:
            out.append((part, *state.values()))
            if end["whole"]:
                for n, a in aggregates.items():
                    if a.how == "sum":
                        mine[n] = (state[n] or 0) + (mine[n] or 0)
                    elif a.how == "last":
                        mine[n] = state[n] if mine[n] is None else mine[n]
                    elif mine[n]["begun"] == end["first_us"] and end["first_us"] - state[n]["last"] < a.gap:
                        mine[n] = {"last": mine[n]["last"], "begun": state[n]["begun"]}
        key, state = tuple(end["last_key"]), mine
    return out


def running(
    df: DataFrame,
    keys: list[str],
    us: str,
    aggregates: dict[str, Running],
    tie: str | None = None,
    include_current: bool = True,
) -> DataFrame:
    """Add running values per ``keys`` in ``us`` order.

    Without ``tie`` rows at the same instant see each other (RANGE peers). With
    ``tie`` rows are totally ordered by (us, tie); ``include_current=False``
    then leaves the row itself out. Keys must not be null. The input is shuffled once and
    the result written and read back; what the driver sees is one state a partition.
    """
    if tie is None and not include_current:
        raise ValueError("leaving out the current row needs a tie-breaking column")
    kept = [c for c in df.columns if c not in aggregates]
    rows = df.select(*kept, *[a.value.alias(f"__v_{n}") for n, a in aggregates.items()])
    order = [*keys, us, *([tie] if tie else [])]
    session = T.StructType().add("last", "long").add("begun", "long")
    kinds = {n: T.LongType() if a.how == "session" else rows.schema[f"__v_{n}"].dataType for n, a in aggregates.items()}
    states = {n: session if a.how == "session" else kinds[n] for n, a in aggregates.items()}
    key_type = T.StructType([T.StructField(f"k{i}", df.schema[k].dataType) for i, k in enumerate(keys)])
    end_type = T.StructType([T.StructField("first_key", key_type), T.StructField("first_us", T.LongType()), T.StructField("last_key", key_type), T.StructField("whole", T.BooleanType()), *[T.StructField(f"end_{n}", t) for n, t in states.items()]])
    schema = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(n, t) for n, t in kinds.items()], T.StructField("__part", T.IntegerType()), T.StructField("__lead", T.BooleanType()), T.StructField("__end", end_type)])

    plain = {n: replace(a, value=None) for n, a in aggregates.items()}  # columns do not travel

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        part = TaskContext.get().partitionId()
        scanner = _Scanner(keys, us, plain, tie is None, include_current)
        tables = whole_groups(batches, [*keys, us]) if tie is None else (pa.Table.from_batches([b]) for b in batches if b.num_rows)
        first, held = None, None
        for table in tables:
            if first is None:
                first = scanner.key_at(table, 0), table.column(us)[0].as_py()
            lead = scanner.key_at(table, 0) == first[0]
            values, opening = scanner.scan(table)
            lead = opening & lead
            n = table.num_rows
            extra = {"__part": pa.array(np.full(n, part, np.int32)), "__lead": pa.array(lead), "__end": pa.nulls(n, arrow.field("__end").type)}
            columns = [values[f.name] if f.name in values else extra[f.name] if f.name in extra else table.column(f.name) for f in arrow]
            if held is not None:
                yield from held.to_batches()
            held = pa.table(columns, names=arrow.names).cast(arrow)
        if held is not None:
            # the last row tells the state that the partition ends with
            named = lambda key: {f"k{i}": x for i, x in enumerate(key)}
            states_at = {f"end_{n}": {"last": s[0], "begun": s[1]} if plain[n].how == "session" else s for n, s in scanner.state.items()}
            end = {"first_key": named(first[0]), "first_us": first[1], "last_key": named(scanner.key), "whole": scanner.key == first[0], **states_at}
            marks = pa.array([None] * (held.num_rows - 1) + [end], arrow.field("__end").type)
            yield from held.set_column(arrow.get_field_index("__end"), arrow.field("__end"), marks).to_batches()

    done = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(scan, schema), "running")
    ends = dict(done.filter("__end is not null").select("__part", "__end").collect())
    carried = _carried(ends, aggregates)
    columns = [F.col(c) for c in kept]
    if not carried:
        return done.select(*columns, *aggregates)
    given = T.StructType([T.StructField("__part", T.IntegerType()), *[T.StructField(f"__in_{n}", t) for n, t in states.items()], T.StructField("__first_us", T.LongType())])
    # one row a partition at most
    states_in = done.sparkSession.createDataFrame([(*c, ends[c[0]]["first_us"]) for c in carried], given)
    out = []
    for n, a in aggregates.items():
        here, before = F.col(n), F.col(f"__in_{n}")
        if a.how == "sum":
            full = (here + F.coalesce(before, F.lit(0))).cast(kinds[n])
        elif a.how == "last":
            full = F.coalesce(here, before)
        else:
            same = (here == F.col("__first_us")) & (F.col("__first_us") - before["last"] < a.gap)
            full = F.when(same, before["begun"]).otherwise(here)
        out.append(F.when(F.col("__lead") & F.col("__first_us").isNotNull(), full).otherwise(here).alias(n))
    return done.join(F.broadcast(states_in), "__part", "left").select(*columns, *out)
