"""Incremental indexing from a stream of pages, and counts of arrivals in windows of time."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skerry.engine import PASSAGE, Engine
from skerry.operators import chunks


def index_stream(pages: DataFrame, engine: Engine, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of ``doc_id, page, text`` replaces the passages of its documents in a new version of the engine's
    store, and brings files, folders, postings and vectors up to date with them. Only parts that hold such documents
    are written anew. A batch that was committed before a failure is told by its number and not applied again."""
    conf = engine.conf.chunk

    def apply(batch: DataFrame, number: int) -> None:
        if engine.store.meta().get("batch", -1) >= number:
            return
        from skerry.tables import cut

        batch = cut(batch.select(F.col("doc_id").cast("string").alias("doc_id"), "page", "text").filter("doc_id IS NOT NULL"))
        new = cut(chunks.chunk(batch, conf.size, conf.overlap).select(*PASSAGE))
        docs = batch.groupBy(F.col("doc_id").alias("path")).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("bigint").alias("size"))
        n, now = new.groupBy("path").agg(F.count("*").cast("int").alias("n_passages")), time.time()
        rows = docs.join(n, "path", "left").select(
            "path", "size", F.lit(now).alias("mtime"), F.lit(None).cast("string").alias("content_hash"), F.coalesce("n_passages", F.lit(0)).alias("n_passages"), F.lit(engine.store.version + 1).alias("indexed_version"), F.lit(now).alias("indexed_at")
        )
        errors: list[str] = []
        engine._commit(cut(docs.select("path")), new, cut(rows), False, errors, source=engine.root, last_indexed_at=now, batch=number)

    return pages.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(events: DataFrame, time_col: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and key; events later than ``late`` are left out."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, window), key).agg(F.count("*").alias("n"))
