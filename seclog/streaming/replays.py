"""Lines that come again, dropped by the bytes of a file that were taken already."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Bytes of a file that share one state: a long file is dealt to many tasks.
SEGMENT = 64 << 20


def joined(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals merged where they touch or overlap, in order."""
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    apart = np.flatnonzero(np.concatenate(([True], begins[1:] > ends[:-1])))
    return begins[apart], ends[np.append(apart[1:], len(ends)) - 1]


def covered(at: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each position lies in one of the (disjoint, sorted) intervals."""
    if not len(begins):
        return np.zeros(len(at), bool)
    i = np.searchsorted(begins, at, "right") - 1
    return (i >= 0) & (at < ends[np.maximum(i, 0)])


def drop_replayed(lines: DataFrame, segment: int = SEGMENT, forget_ms: int | None = None) -> DataFrame:
    """Rows of a stream of lines (file_id, position, size, ...) whose bytes did not come before, each line once.

    The state of a file's segment is the set of byte intervals taken so far, merged where they touch: one interval for a
    file read from its start, whatever its number of lines. Lines that are equal but lie elsewhere in the file are
    other lines. Give it all lines, empty ones too, else the intervals have holes. With ``forget_ms`` a segment
    that had no line for so long (processing time) is forgotten.
    """
    columns = lines.columns

    def take(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        begins, ends = (np.array(x, np.int64) for x in (state.get if state.exists else ([], [])))
        for frame in frames:
            frame = frame.drop_duplicates("position")
            at = frame["position"].to_numpy()
            new = ~covered(at, begins, ends)
            if new.any():
                begins, ends = joined(np.concatenate((begins, at[new])), np.concatenate((ends, (at + frame["size"].to_numpy())[new])))
                yield frame.loc[new, columns]
        state.update((begins.tolist(), ends.tolist()))
        if forget_ms is not None:
            state.setTimeoutDuration(forget_ms)

    timeout = GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    keyed = lines.withColumn("__segment", F.floor(F.col("position") / segment))
    return keyed.groupBy("file_id", "__segment").applyInPandasWithState(take, lines.schema, "begins array<long>, ends array<long>", "append", timeout)
