"""Streaming sinks: tables, outbox and user handlers, idempotent per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from seclog.operators.rollup import hourly_states
from seclog.sources.sinks import append_table

Handler = Callable[[DataFrame, int], None]


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream to a Parquet table (exactly once), taking what is there and stopping."""
    return (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def for_each_batch(stream: DataFrame, handlers: list[Handler], checkpoint: str) -> StreamingQuery:
    """Call every handler with each micro-batch and its id.

    Handlers may see a batch again after a failure and must be idempotent by id.
    The batch is cached while several handlers read it.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if len(handlers) > 1:
            batch = batch.persist()
        try:
            for handle in handlers:
                handle(batch, batch_id)
        finally:
            if len(handlers) > 1:
                batch.unpersist()

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def hourly_handler(path: str) -> Handler:
    """A handler that appends the hourly states of each batch (``operators.rollup``), replacing its own earlier attempt."""
    return lambda batch, batch_id: append_table(hourly_states(batch), path, "us", batch_id)


def table_handler(path: str, us: str = "us") -> Handler:
    """A handler that appends the batch to a table, replacing its own earlier attempt."""
    return lambda batch, batch_id: append_table(batch, path, us, batch_id)
