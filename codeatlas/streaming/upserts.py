"""Streaming upserts: micro-batches of rows merged into a versioned table. Extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from codeatlas.plans import index as plans


def upsert_stream(rows: DataFrame, index: str, checkpoint: str, seq: str = "seq", **trigger) -> StreamingQuery:
    """Merge a stream of vector rows (with seq) into the index; a batch that is run again gives the same table.

    A batch rewrites the buckets that its keys fall into; where another writer published meanwhile it is merged again.
    """

    def merge(batch: DataFrame, _: int) -> None:
        while True:
            try:
                plans.upsert(batch.sparkSession, index, batch, seq)
                return
            except plans.Conflict:
                continue

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
