"""Page ingest as a stream of files: each batch commits its pages, then its books' progress; it may stop at any page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import STORES, Snapshots, read_records

STALE_MS = 5 * 60 * 1000


def page_stream(spark: SparkSession, path: str, schema: str, pages_per_batch: int = 1) -> DataFrame:
    """JSON page files as they arrive, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", pages_per_batch).json(path)


def ingest(pages: DataFrame, store: Snapshots, checkpoint: str, stop: Callable[[], bool] = lambda: False, slice_by: tuple[str, ...] = ("book_id", "kind")) -> StreamingQuery:
    """Each batch's pages go into the store's table of pages, then their progress; stop() is asked between batches.

    A batch rewrites only the slices (a book's kind) that it has pages of, and counts only these; one that runs again writes the same
    rows, so a restart from the checkpoint is safe.
    """
    query: list[StreamingQuery] = []

    def commit(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            touched = store.upsert_slices("pages", batch, list(slice_by))
            if touched is not None:
                done = touched.groupBy(*slice_by).agg(F.count("*").alias("processed_pages"))
                store.upsert_slices("progress", done, list(slice_by), key=list(slice_by))
        finally:
            batch.unpersist()
        if stop() and query:
            query[0].stop()

    q = pages.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.append(q)
    return q


def lines_stream(spark: SparkSession, path: str) -> DataFrame:
    """Backup lines as they arrive."""
    return spark.readStream.option("recursiveFileLookup", "true").text(path)


def restore_stream(lines: DataFrame, store: Snapshots, schemas: dict[str, str], checkpoint: str) -> StreamingQuery:
    """Backup lines into the store's tables as they arrive. Of each batch books go first, then pages, then items, so that a restore
    which breaks off leaves no row without its book; lines that can't be read are kept in the table bad_lines."""

    def commit(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            rows, bad = read_records(batch, schemas)
            for name in (n for n in STORES if n in rows):
                store.upsert_slices(name, rows[name], ["book_id"] if "book_id" in rows[name].columns else [])
            if bad.limit(1).count():
                store.append("bad_lines", bad)
        finally:
            batch.unpersist()

    return lines.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_state(status: Column, updated_at: Column, now_ms: Column, busy: Column | None = None) -> Column:
    """busy, processing, interrupted (its heartbeat is five minutes old), the stored status, or complete."""
    alive = (now_ms - F.coalesce(updated_at, F.lit(0))) < STALE_MS
    state = F.when((status == "processing") & alive, "processing").when(status == "processing", "interrupted").otherwise(F.coalesce(status, F.lit("complete")))
    return state if busy is None else F.when(busy, "busy").otherwise(state)


def needs_ocr(has_text: Column, forced: Column, accepted: Column) -> Column:
    """A page goes to recognition without a text layer, when forced, or when its text gave no number."""
    return ~has_text | forced | (accepted == 0)


def needs_strip_retry(accepted: Column, visual: Column) -> Column:
    return accepted < F.ceil(visual / 2)


def collapse_log(log: DataFrame, order: str, message: str, scope: list[str] | None = None) -> DataFrame:
    """Log lines without those that equal the line before but for their digits. scope is what one log is (a book, a run): logs are
    dealt by it; without one the table is a single log, which one task reads."""
    shape = F.regexp_replace(F.col(message), r"[\d/]+", "#")
    lines = Window.partitionBy(*(scope or [F.lit(0)])).orderBy(order)
    return log.withColumn("_same", shape.eqNullSafe(F.lag(shape).over(lines)) & (F.row_number().over(lines) > 1)).where("not _same").drop("_same")
