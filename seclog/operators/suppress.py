"""Greedy suppression: keep a row only if no kept row lies in the previous c.

Keeping a row depends on what was kept before it, so a naive job walks a whole
key in one task. Time is cut into chunks of many cooldowns instead:

1. per (key, chunk): for every row that could be the first one kept, the last
   row kept in the chunk. This map is a step function, stored by its steps;
2. the maps of neighbouring chunks are composed, ``fan`` to one, until a key has at
   most ``fan`` left; these are walked to learn when each opens, and then, down the
   same tree, the maps that each was made of;
3. per (key, chunk): thin the rows, knowing when the chunk opens.

All steps run in parallel over chunks, also within one key: a task that composes or
walks passes at most ``fan`` maps of a key, with two of them at a time in memory. Tasks grow in
number, not in size, with the rows. Only
keys, instants and row ids pass through Arrow; the payload never leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seclog.operators.scan import CHUNK, changes, chunk_of, whole_groups
from seclog.sources.staging import staged

_OPEN = -(2**62)  # "nothing kept so far"; also sorts a chunk's opening before its rows
_BLOCK = "__block"
#: Maps of one key that one task composes or walks.
FAN = 1024
#: Rows that one task sorts, about.
TASK_ROWS = 1 << 18


def _dealt(df: DataFrame, names: list[str], parts: int) -> DataFrame:
    """Dealt by ``names``, to ``parts`` partitions if that is not 0, else to the session's number."""
    return df.repartition(parts, *names) if parts else df.repartition(*names)


def suppress_within(
    df: DataFrame,
    keys: list[str],
    cooldown_us: int,
    us: str = "us",
    tie: str = "event_id",
    chunk_cooldowns: int = 64,
    stage: bool = True,
    fan: int = FAN,
) -> DataFrame:
    """Rows of ``df`` that survive suppression per ``keys``; ``tie`` orders equal instants.

    (keys, us, tie) identifies a row; copies of a kept row come out once. Null keys
    are dropped. The input is read three times and therefore staged; pass
    ``stage=False`` for a plain table.
    """
    if cooldown_us <= 0:
        raise ValueError("cooldown must be positive")
    span = cooldown_us * chunk_cooldowns
    usable = df.dropna(subset=keys)
    if stage:
        usable = staged(usable, "candidates")
    # The range of time says how many levels the tree needs, the number of rows how many tasks.
    count, low, high = usable.agg(F.count(F.lit(1)), F.min(us), F.max(us)).first()
    tasks = -(-count // TASK_ROWS)
    if tasks <= usable.sparkSession.sparkContext.defaultParallelism:
        tasks = 0
    # Of several rows at one instant only the first can survive: combine before shuffling.
    instants = (
        usable.groupBy(*keys, F.col(us).alias("__us"))
        .agg(F.min(tie).alias("__tie"))
        .withColumn(CHUNK, chunk_of(F.col("__us"), span))
        .select(*keys, CHUNK, "__us", "__tie")
    )
    key_fields = [df.schema[k] for k in keys]
    chunk_field = T.StructField(CHUNK, T.LongType())
    step_schema = T.StructType(
        [*key_fields, chunk_field, T.StructField("__entry", T.LongType()), T.StructField("__exit", T.LongType())]
    )
    open_schema = T.StructType([*key_fields, chunk_field, T.StructField("__us", T.LongType())])
    kept_schema = T.StructType(
        [*key_fields, T.StructField("__us", T.LongType()), instants.schema["__tie"]]
    )
    group = [*keys, CHUNK]

    steps = (
        _dealt(instants, group, tasks)
        .sortWithinPartitions(*group, "__us")
        .mapInArrow(_step_finder(group, cooldown_us, span), step_schema)
    )
    low, high = (low // span, high // span) if low is not None else (0, 0)
    levels = [steps]
    while high - low >= fan:
        levels[-1] = staged(levels[-1], "steps")
        begin = span * fan ** (len(levels) - 1)
        parts = levels[-1].withColumn(_BLOCK, F.floor(F.col(CHUNK) / fan))
        composed = (
            _dealt(parts, [*keys, _BLOCK], tasks)
            .sortWithinPartitions(*keys, _BLOCK, CHUNK, "__entry")
            .mapInArrow(_composer(keys, cooldown_us, begin), step_schema)
        )
        levels.append(composed)
        low, high = low // fan, high // fan
    openings = (
        _dealt(levels[-1], keys, tasks)
        .sortWithinPartitions(*group, "__entry")
        .mapInArrow(_chunk_walker(keys, cooldown_us, span * fan ** (len(levels) - 1)), open_schema)
    )
    for k in range(len(levels) - 2, -1, -1):
        # What a block was left with when it opened is one more map, before all of the block's own.
        given = openings.select(
            *keys,
            F.lit(_OPEN).cast("long").alias(CHUNK),
            F.lit(_OPEN).cast("long").alias("__entry"),
            F.when(F.col("__us") == _OPEN, F.lit(_OPEN)).otherwise(F.col("__us") - cooldown_us).cast("long").alias("__exit"),
            F.col(CHUNK).alias(_BLOCK),
        )
        parts = levels[k].withColumn(_BLOCK, F.floor(F.col(CHUNK) / fan)).unionByName(given)
        inner = [*keys, _BLOCK]
        below = T.StructType([*key_fields, T.StructField(_BLOCK, T.LongType()), *open_schema.fields[len(keys) :]])
        openings = (
            _dealt(parts, inner, tasks)
            .sortWithinPartitions(*inner, CHUNK, "__entry")
            .mapInArrow(_chunk_walker(inner, cooldown_us, span * fan**k), below)
            .filter(F.col(CHUNK) != _OPEN)
            .drop(_BLOCK)
        )
    # __open carries when the chunk opens; such a row sorts before all rows of its chunk.
    rows = instants.withColumn("__open", F.lit(None).cast("long")).unionByName(
        openings.select(
            *group,
            F.lit(_OPEN).cast("long").alias("__us"),
            F.lit(None).cast(instants.schema["__tie"].dataType).alias("__tie"),
            F.col("__us").alias("__open"),
        )
    )
    kept = (
        _dealt(rows, group, tasks)
        .sortWithinPartitions(*group, "__us")
        .mapInArrow(_thinner(keys, group, cooldown_us, span), kept_schema)
        .withColumnsRenamed({"__us": us, "__tie": tie})
    )
    identity = [*keys, us, tie]
    if tasks:
        # The join sorts whole rows, which may be wide.
        usable, kept = _dealt(usable, identity, tasks), _dealt(kept, identity, tasks)
    return usable.join(kept, identity, "left_semi").dropDuplicates(identity)


def _next_allowed(us: np.ndarray, starts: np.ndarray, offset: np.ndarray, cooldown: int, stride: int):
    """Index of the first row of the same group at least ``cooldown`` later, else -1."""
    group = np.cumsum(starts) - 1
    result = np.full(len(us), -1, dtype=np.int64)
    per_slice = max(1, int((2**62) // stride))
    for low in range(0, int(group[-1]) + 1, per_slice):
        a, b = np.searchsorted(group, [low, low + per_slice])
        line = offset[a:b] + (group[a:b] - low) * stride
        nxt = np.searchsorted(line, line + cooldown) + a
        inside = nxt < b
        inside[inside] = group[nxt[inside]] == group[a:b][inside]
        result[a:b] = np.where(inside, nxt, -1)
    return group, result


def _step_finder(group: list[str], cooldown: int, span: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, group):
            us = table.column("__us").to_numpy()
            starts = changes(table, group)
            offset = us - table.column(CHUNK).to_numpy() * span
            ids, nxt = _next_allowed(us, starts, offset, cooldown, span + cooldown + 1)
            # Possible first rows: those in the chunk's first cooldown and the one after.
            late = offset >= cooldown
            before_early = np.r_[True, ~late[:-1]]
            entry = np.flatnonzero(~late | starts | before_early)
            end = entry.copy()
            while True:
                following = nxt[end]
                going = following >= 0
                if not going.any():
                    break
                end = np.where(going, following, end)
            changed = (ids[entry][1:] != ids[entry][:-1]) | (end[1:] != end[:-1])
            pick = np.r_[changed, True]
            rows = table.select(group).take(pa.array(entry[pick]))
            rows = rows.append_column("__entry", pa.array(us[entry[pick]]))
            rows = rows.append_column("__exit", pa.array(us[end[pick]]))
            yield from rows.to_batches()

    return find


def _compose(first: tuple, then: tuple, cooldown: int, latest: int) -> tuple[np.ndarray, np.ndarray]:
    """The map of two neighbouring stretches of time from those of each: (entries, exits).

    ``latest`` is the last instant at which the first stretch can open.
    """
    (entry, leave), (entry2, leave2) = first, then
    j = np.searchsorted(entry2, leave + cooldown)
    out = np.where(j < len(entry2), leave2[np.minimum(j, len(entry2) - 1)], leave)
    # An opening after all rows of the first stretch goes on to the second.
    a = np.searchsorted(entry2, entry[-1], "right")
    b = np.searchsorted(entry2, latest) + 1 if entry[-1] < latest else a
    entry, out = np.r_[entry, entry2[a:b]], np.r_[out, leave2[a:b]]
    pick = np.r_[out[1:] != out[:-1], True]
    return entry[pick], out[pick]


def _composer(keys: list[str], cooldown: int, span: int):
    """One map for all chunks of a (key, block), composed in order."""
    block = [*keys, _BLOCK]

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, latest = None, None, 0

        def done() -> pa.RecordBatch:
            n = len(held[0])
            named = [pa.array([v] * n, f) for v, f in zip(place, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*named, pa.array(held[0]), pa.array(held[1])], names=[*keys, CHUNK, "__entry", "__exit"])

        for table in whole_groups(batches, [*block, CHUNK]):
            first = np.flatnonzero(changes(table, [*block, CHUNK]))
            heads = table.select([*block, CHUNK]).take(pa.array(first))
            kinds = [heads.schema.field(c).type for c in block]
            entry = table.column("__entry").to_numpy()
            leave = table.column("__exit").to_numpy()
            begins = [c * span for c in heads.column(CHUNK).to_pylist()]
            places = list(zip(*(heads.column(c).to_pylist() for c in block), strict=True))
            for i, (a, b) in enumerate(zip(first, np.r_[first[1:], len(entry)], strict=True)):
                mine = entry[a:b], leave[a:b]
                if places[i] != place:
                    if place is not None:
                        yield done()
                    place, held, latest = places[i], mine, begins[i] + cooldown
                else:
                    held = _compose(held, mine, cooldown, latest)
        if place is not None:
            yield done()

    return compose


def _chunk_walker(keys: list[str], cooldown: int, span: int):
    """When each chunk opens. Only chunks that an earlier one can still silence are walked."""
    group = [*keys, CHUNK]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_exit = None, _OPEN
        for table in whole_groups(batches, group):
            first = np.flatnonzero(changes(table, group))
            heads = table.select(group).take(pa.array(first))
            entry = table.column("__entry").to_numpy()
            leave = table.column("__exit").to_numpy()
            stop = np.r_[first[1:], len(entry)]
            new_key = changes(heads, keys)
            # The latest exit the chunk before can have.
            latest = np.r_[_OPEN, np.maximum.reduceat(leave, first)[:-1]]
            left = leave[first].copy()  # the exit of each chunk if nothing silences it
            opens = np.full(len(first), _OPEN, dtype=np.int64)
            new_key[0] = _key_at(heads, keys, 0) != last_key
            if not new_key[0]:
                latest[0] = last_exit
            begins = np.maximum(heads.column(CHUNK).to_numpy(), _OPEN // span) * span
            for i in np.flatnonzero(~new_key & (latest + cooldown > begins)):
                before = left[i - 1] if i else last_exit
                opens[i] = before + cooldown
                j = first[i] + np.searchsorted(entry[first[i] : stop[i]], opens[i])
                left[i] = leave[j] if j < stop[i] else before
            last_key, last_exit = _key_at(heads, keys, len(first) - 1), int(left[-1])
            yield from heads.append_column("__us", pa.array(opens)).to_batches()

    return walk


def _key_at(table: pa.Table, keys: list[str], row: int) -> tuple:
    return tuple(table.column(k)[row].as_py() for k in keys)


def _thinner(keys: list[str], group: list[str], cooldown: int, span: int):
    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, group):
            opening = table.column("__us").to_numpy() == _OPEN
            opens = table.column("__open").filter(pa.array(opening)).to_numpy()
            rows = table.filter(pa.array(~opening))
            us = rows.column("__us").to_numpy()
            starts = changes(rows, group)
            offset = us - rows.column(CHUNK).to_numpy() * span
            ids, nxt = _next_allowed(us, starts, offset, cooldown, span + cooldown + 1)
            allowed = np.flatnonzero(us >= opens[ids])
            first = allowed[np.r_[True, ids[allowed][1:] != ids[allowed][:-1]]] if len(allowed) else allowed
            keep = np.zeros(len(us), dtype=bool)
            current = first
            while len(current):
                keep[current] = True
                current = nxt[current]
                current = current[current >= 0]
            if keep.any():
                kept = rows.filter(pa.array(keep)).select([*keys, "__us", "__tie"])
                yield from kept.to_batches()

    return thin
