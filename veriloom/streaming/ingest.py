"""Ingest from a landing folder as a stream: each micro-batch of new page files goes through the engine; appends are idempotent, so a
batch that is run again after a failure stores nothing twice."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from veriloom.plans.engine import Engine

PAGES = "source_document string, source_page int, text string, text_source string"


def watch(spark: SparkSession, landing: str, engine: Engine, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Start a query over JSON page files; it takes what is there and ends (call again, or set another trigger, to go on)."""
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).json(landing)
    return pages.writeStream.foreachBatch(lambda batch, _: engine.ingest(batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
