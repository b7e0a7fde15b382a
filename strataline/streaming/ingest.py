"""Structured Streaming ingestion: micro-batches of datoms are admitted and appended exactly once.

The batch id is the idempotency key: a batch that is replayed after a failure finds its receipt and is not appended again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.journal import Journal


def ingest(stream: DataFrame, journal: Journal, checkpoint: str, name: str = "ingest") -> StreamingQuery:
    """Append a stream of datoms (the journal's columns without seq) to a journal; rows of a batch come by element."""

    def admit(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            journal.append(batch.orderBy("element"), idempotency_key=f"{name}-{number}")

    return stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(admit).start()
