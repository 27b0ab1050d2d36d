"""Extraction over a stream of notes: a stream-static join with no state, since documents don't depend on each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import extract


def extract_stream(notes: DataFrame, path: str, checkpoint: str, phrases: DataFrame | None = None, seeds: DataFrame | None = None, **options) -> StreamingQuery:
    """Run extract() on each micro-batch of notes(doc_id, text); a batch that is run again replaces its own folder."""

    def batch(rows: DataFrame, number: int) -> None:
        extract(rows, seeds, phrases, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return notes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
