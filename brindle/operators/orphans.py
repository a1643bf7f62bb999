"""References whose target is missing, late or deleted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tidy_id(column: Column) -> Column:
    """Ids are compared without surrounding white space and in lower case."""
    return F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))


def parents(df: DataFrame, table: str, key: Column, present: Column, seen_at: Column, deleted_at: Column) -> DataFrame:
    """Parent rows in long form; ``present`` false marks a row that only tells of a deletion."""
    return df.select(
        F.lit(table).alias("ref_table"),
        key.alias("target"),
        present.alias("is_parent"),
        F.when(present, seen_at).alias("parent_at"),
        deleted_at.alias("deleted_at"),
        F.lit(None).cast("timestamp").alias("child_first"),
        F.lit(None).cast("timestamp").alias("child_last"),
    )


def references(df: DataFrame, table: str, ref_key: Column, target: Column, loaded_at: Column) -> DataFrame:
    """One row per reference with its earliest load; a null target refers to nothing."""
    return (
        df.select(F.lit(table).alias("ref_table"), ref_key.alias("ref_key"), target.alias("target"), loaded_at.alias("loaded_at"))
        .where(F.col("target").isNotNull() & F.col("ref_key").isNotNull())
        .groupBy("ref_table", "ref_key", "target")
        .agg(F.min("loaded_at").alias("loaded_at"))
    )


def orphan_references(refs: DataFrame, parent_rows: list[DataFrame]) -> DataFrame:
    """``(ref_table, ref_key, period, status)`` for each reference without a valid target.

    Parent and child keys are unioned in long form and grouped by parent table and key.
    All aggregates (flags, minima, maxima) combine map-side, so a key that holds a third of the
    references costs one row per map task. Only the keys that can make an orphan (no parent,
    or a child outside the parent's life) go on to the join with the references, where AQE
    splits a hot key. A reference with a null load time is an orphan only when its target is
    missing (its period is null). Repeated rows count once; empty inputs give an empty result.
    """
    children = refs.select(
        "ref_table",
        "target",
        F.lit(False).alias("is_parent"),
        F.lit(None).cast("timestamp").alias("parent_at"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
        F.col("loaded_at").alias("child_first"),
        F.col("loaded_at").alias("child_last"),
    ).withColumn("is_child", F.lit(True))
    long = reduce(DataFrame.unionByName, [children, *[p.withColumn("is_child", F.lit(False)) for p in parent_rows]])
    suspects = (
        long.groupBy("ref_table", "target")
        .agg(
            F.bool_or("is_child").alias("is_child"),
            F.bool_or(F.coalesce("is_parent", F.lit(False))).alias("has_parent"),
            F.min("parent_at").alias("parent_at"),
            F.min("deleted_at").alias("deleted_at"),
            F.min("child_first").alias("child_first"),
            F.max("child_last").alias("child_last"),
        )
        .where("is_child AND (NOT has_parent OR parent_at > child_first OR deleted_at <= child_last)")
        .select("ref_table", "target", "has_parent", "parent_at", "deleted_at")
    )
    status = (
        F.when(~F.col("has_parent"), "missing")
        .when(F.col("parent_at") > F.col("loaded_at"), "late")
        .when(F.col("deleted_at") <= F.col("loaded_at"), "deleted")
    )
    return (
        refs.join(suspects, ["ref_table", "target"])
        .withColumn("status", status)
        .where(F.col("status").isNotNull())
        .select("ref_table", "ref_key", F.date_format("loaded_at", "yyyy-MM").alias("period"), "status")
    )


def found_orphans(transcript: DataFrame, recording: DataFrame, record_topics: DataFrame, records: DataFrame) -> DataFrame:
    """The orphan references of the help-desk tables.

    An utterance refers to a participant of its recording by ``speaker.inMeetingId``; a
    recording's deletion counts for all its participants, so deletions are first brought
    to the recording and then join its distinct participants.
    """
    utterances = references(
        transcript,
        "transcript",
        F.col("utterance_id").cast("string"),
        F.when(F.col("speaker.inMeetingId").isNotNull(), F.concat_ws("/", F.coalesce("recordingId", F.lit("")), F.col("speaker.inMeetingId").cast("string"))),
        F.col("loaded_at"),
    )
    topics = references(record_topics, "record_topics", tidy_id(F.col("record_id")), tidy_id(F.col("record_id")), F.col("loaded_at"))
    seats = recording.select("id", "loaded_at", "deleted_at", F.explode_outer(F.array_distinct(F.coalesce(F.transform("attributes.participants", lambda p: p["inMeetingId"]), F.array()))).alias("seat"))
    per_seat = seats.where("id IS NOT NULL AND seat IS NOT NULL").groupBy("id", "seat").agg(F.min("loaded_at").alias("parent_at"))
    gone = recording.where("id IS NOT NULL AND deleted_at IS NOT NULL").groupBy("id").agg(F.min("deleted_at").alias("deleted_at"))
    participants = parents(per_seat.join(gone, "id", "left"), "transcript", F.concat_ws("/", "id", F.col("seat").cast("string")), F.lit(True), F.col("parent_at"), F.col("deleted_at"))
    indexed = parents(records, "record_topics", tidy_id(F.col("id")), F.lit(True), F.col("indexed_at"), F.col("deleted_at"))
    return orphan_references(utterances.unionByName(topics), [participants, indexed.where("target IS NOT NULL")])


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per table, month and status."""
    return found.groupBy("ref_table", "period", "status").agg(F.count("*").alias("orphans"))
