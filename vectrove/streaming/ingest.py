"""Streams into collections."""

from __future__ import annotations

from pyspark.sql import DataFrame


def ingest_stream(database, collection: str, stream: DataFrame, checkpoint: str, trigger: dict | None = None, flush_rows: int | None = 100_000):
    """Write a stream of ``_id``, ``vector`` and metadata columns into a collection.

    Each micro-batch is one insert, flushed to a segment from ``flush_rows``
    un-flushed rows.  A batch that is replayed after a failure is inserted
    again: delivery is at least once.
    """

    def write(batch: DataFrame, _: int) -> None:
        database.insert_dataframe(collection, batch)
        if flush_rows:
            database.storage.maybe_flush(collection, flush_rows)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
