"""Continuous ingest: each micro-batch is flushed as one part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from logsift.plans.store import LogStore
from logsift.sources.ingest import ENVELOPE, envelope_rows


def flush_stream(entries: DataFrame, store: LogStore, checkpoint: str, stream: str = "s", interval: str = "5 seconds", once: bool = False) -> StreamingQuery:
    """Writes entries(timestamp, data) to the store. Late rows are taken as they come. A batch
    that is run again after a failure has the same id, so it is not stored twice."""

    def flush(batch: DataFrame, batch_id: int) -> None:
        store.append(batch, f"{stream}-{batch_id}")

    writer = entries.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def envelope_stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder of request bodies as a stream of entries."""
    return envelope_rows(spark.readStream.schema(ENVELOPE).option("multiLine", True).json(path))


def compact_stream(store: LogStore, rounds: int = 1) -> int:
    """Compacts until nothing is left to merge, at most `rounds` times; how many parts were made."""
    made = 0
    for _ in range(rounds):
        new = store.compact()
        made += len(new)
        if not new:
            break
    return made
