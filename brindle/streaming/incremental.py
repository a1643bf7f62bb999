"""Structured Streaming: an index that follows a folder of record files, and windowed activity counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.operators.index import VersionedIndex, arranged, doc_stats, postings, search_datasets
from brindle.sources.tables import cut


def merge_batch(index: VersionedIndex, batch: DataFrame, batch_id: int | None = None) -> int:
    """A new version of the index with the batch merged in, its postings and lengths with it; every other dataset stays.

    Per id the row of the latest ``source_mtime`` counts, of the batch as of the index: a late batch never
    overwrites a newer row, nor brings back one deleted later (the index keeps the deleted ids). A row without a time counts as the oldest.
    """
    rest = [c for c in batch.columns if c not in ("id", "source_mtime")]
    latest = batch.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("source_mtime", *rest)).alias("r")).select("id", "r.*").select(*batch.columns)
    facts = {} if batch_id is None else {"batch_id": batch_id}
    gone = F.col("deleted_at").isNotNull() if "deleted_at" in batch.columns else F.lit(False)
    if index.current() is None:
        latest = cut(latest)
        return index.publish({"records": latest.where(~gone), "removed": latest.where(gone).select("id", "source_mtime"), **search_datasets()}, facts)
    current = index.read("records")
    removed = index.read("removed") if index.has("removed") else current.select("id", "source_mtime").limit(0)
    known = current.select("id", F.col("source_mtime").alias("have")).unionByName(removed.select("id", F.col("source_mtime").alias("have")))
    late = F.col("have").isNotNull() & (F.col("source_mtime").isNull() | (F.col("have") > F.col("source_mtime")))
    fresh = cut(latest.join(known, "id", "left").where(~late).select(*batch.columns))
    ids, live = fresh.select("id"), fresh.where(~gone)
    others = lambda df: df.join(ids, "id", "left_anti")
    merged = {"records": others(current).unionByName(live, allowMissingColumns=True), "removed": others(removed).unionByName(fresh.where(gone).select("id", "source_mtime"))}
    if index.has("postings"):
        merged["postings"] = arranged(others(index.read("postings")).unionByName(postings(live)))
        merged["doc_stats"] = others(index.read("doc_stats")).unionByName(doc_stats(live))
    return index.publish(merged, index_facts(index) | facts)


def index_facts(index: VersionedIndex) -> dict[str, object]:
    """What the manifest says of the index apart from its datasets and counts."""
    return {k: v for k, v in index.manifest().items() if k not in ("datasets", "build_complete_at") and not k.endswith("_count")}


def follow_folder(spark: SparkSession, folder: str, schema: str, index_root: str, checkpoint: str) -> StreamingQuery:
    """Merge new Parquet files of a folder into the index until none is left; restarts go on from the checkpoint."""
    stream = spark.readStream.schema(schema).parquet(folder)

    def merge(batch: DataFrame, batch_id: int) -> None:
        index = VersionedIndex(batch.sparkSession, index_root)
        done = index.manifest().get("batch_id", -1) if index.current() is not None else -1
        if batch_id > int(done):  # a batch that is run again after a failure changes nothing
            merge_batch(index, batch, batch_id)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, size: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Events and their value per type and time window; also for a stream, where late rows count up to ``delay``."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(
        F.col("window.start").alias("window_start"), "event_type", "n", "value"
    )
