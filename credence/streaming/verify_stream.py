"""Streams: verify on arrival, duplicates on arrival, pending uploads, live counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.session import cut_lineage, run_dir
from credence.sources.sinks import BatchLog
from credence.sources.tableset import TableSet


def run_available(
    stream: DataFrame, on_batch: Callable[[DataFrame, int], None], name: str, mode: str = "append", progress: str | None = None
) -> None:
    """Processes everything that has arrived, then stops.

    ``progress`` is the folder that remembers what was processed; give the same one to go on where
    the last run stopped.
    """
    progress = progress or run_dir(stream.sparkSession, f"{name}-progress")
    query = (
        stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", progress)
        .foreachBatch(on_batch).start()
    )
    query.awaitTermination()


def duplicates_on_arrival(stream: DataFrame, seen: TableSet, found: BatchLog | None = None) -> None:
    """Exact duplicates against everything seen before.

    ``stream`` has id and file_hash.  Table ``files`` of ``seen`` keeps one row per file, in buckets by hash: first_id, the
    lowest id of the batch in which the file first came, and n_docs.  A batch is summed per file, reads and
    rewrites only the buckets of its files, and is committed with its number; one that is part of the table already
    is left out, so a replay changes nothing.  ``found`` logs (id, earlier_id) of every document whose file was seen
    before or earlier in its batch.
    """
    if not seen.versions():
        start = seen.begin()
        start.create("files", stream.sparkSession.createDataFrame([], "file_hash string, first_id long, n_docs long"), "file_hash")
        start.commit()

    def on_batch(batch: DataFrame, number: int) -> None:
        change = seen.begin()
        if number <= change.applied("files"):
            return
        hashed = batch.where("file_hash is not null").select(F.col("id").cast("long").alias("id"), "file_hash")
        fresh = cut_lineage(hashed.groupBy("file_hash").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_docs")))
        known = change.lookup("files", fresh.select("file_hash")).select("file_hash", F.col("first_id").alias("_id"), F.col("n_docs").alias("_n"))
        files = cut_lineage(fresh.join(known, "file_hash", "left").select(
            "file_hash", F.coalesce("_id", "first_id").alias("first_id"), (F.col("n_docs") + F.coalesce("_n", F.lit(0))).alias("n_docs")))
        if found is not None:
            hits = hashed.join(files.select("file_hash", F.col("first_id").alias("earlier_id")), "file_hash").where("id <> earlier_id")
            found.add(hits.select("id", "earlier_id"), number)
        change.upsert("files", files)
        change.commit("files", number)

    run_available(stream, on_batch, "duplicates", progress=f"{seen.root}/progress")


def unique_within(stream: DataFrame, ts: str, window: str, key: str = "file_hash") -> DataFrame:
    """First arrival of each key within a time window; state is bounded by the watermark."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, window)
    return timed.dropDuplicatesWithinWatermark([key])


def pending_on_arrival(uploads: DataFrame, verifications: DataFrame, log: BatchLog) -> None:
    """Uploads that have no verification yet (stream joined with the current table)."""
    done = verifications.select(F.col("document_id").alias("id")).distinct()
    run_available(uploads, lambda batch, number: log.add(batch.join(done, "id", "left_anti"), number), "pending", progress=log.progress)


def live_counts(stream: DataFrame, tables: TableSet, column: str = "status", progress: str | None = None) -> None:
    """Running count per status as table ``counts``; state and table hold one row per status."""
    def on_batch(batch: DataFrame, number: int) -> None:
        change = tables.begin()
        if number > change.applied("counts"):
            change.create("counts", batch, column, buckets=1)
            change.commit("counts", number)

    counts = stream.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    run_available(counts, on_batch, "counts", mode="complete", progress=progress or f"{tables.root}/progress")
