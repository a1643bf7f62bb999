"""Utterances of a call in order, their windows, and the windows' texts and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.scalars import SPACE, alphabetic_tokens, nonspace_length, participants, speaker_line, strip

SIZE, STRIDE = 20, 18
LEAST_CHARS, LEAST_TOKENS, LONG_WORDS = 200, 30, 5
CHUNK_MS = 600_000


def position_within(df: DataFrame, key: str, chunk: Column, order: list[Column]) -> DataFrame:
    """``df`` with ``position`` (from 0 within ``key``) and ``total``.

    The position is the rows of earlier chunks, summed over the few chunks of a key, plus the place
    inside the chunk, so that no task sorts all rows of one key.
    """
    chunked = df.withColumn("_chunk", chunk)
    counts = chunked.groupBy(key, "_chunk").agg(F.count("*").alias("_n"))
    over_key = Window.partitionBy(key)
    before = F.coalesce(F.sum("_n").over(over_key.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select(key, "_chunk", before.alias("_base"), F.sum("_n").over(over_key).alias("total"))
    place = F.row_number().over(Window.partitionBy(key, "_chunk").orderBy(*order))
    return chunked.withColumn("_place", place).join(bases, [key, "_chunk"]).withColumn("position", F.col("_base") + F.col("_place") - 1).drop("_chunk", "_place", "_base")


def utterances(transcript: DataFrame) -> DataFrame:
    """One row per utterance (its earliest load) with its position in the call; a null offset comes last."""
    rows = transcript.where("recordingId IS NOT NULL AND utterance_id IS NOT NULL").select(
        "recordingId", "utterance_id", "offsetMs", "durationMs", F.col("speaker.inMeetingId").alias("speaker_id"), F.col("speaker.displayName").alias("speaker_name"), "text", "loaded_at"
    )
    own = ("offsetMs", "durationMs", "speaker_id", "speaker_name", "text")
    unique = rows.groupBy("recordingId", "utterance_id").agg(F.min(F.struct("loaded_at", *own)).alias("u")).select("recordingId", "utterance_id", *[f"u.{c}" for c in own])
    chunk = F.coalesce(F.floor(F.col("offsetMs") / CHUNK_MS), F.lit(2**40))
    return position_within(unique, "recordingId", chunk, [F.col("offsetMs").asc_nulls_last(), F.col("utterance_id")])


def seats(recording: DataFrame) -> DataFrame:
    """``(recordingId, speaker_id, name, role)`` of each recording's latest version."""
    latest = recording.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("loaded_at", participants(F.col("attributes.participants")).alias("people"))).alias("last"))
    rows = latest.select(F.col("id").alias("recordingId"), F.explode("last.people").alias("p")).where("p.id IS NOT NULL")
    return rows.groupBy("recordingId", F.col("p.id").alias("speaker_id")).agg(F.max(F.struct("p.name", "p.role")).alias("m")).select("recordingId", "speaker_id", "m.name", "m.role")


def rendered_utterances(transcript: DataFrame, recording: DataFrame) -> DataFrame:
    """Utterances with their speaker's role (UNKNOWN when nobody lists them) and their rendered line (null for blank text)."""
    joined = utterances(transcript).join(seats(recording).select("recordingId", "speaker_id", "role"), ["recordingId", "speaker_id"], "left")
    role = F.coalesce("role", F.lit("UNKNOWN"))
    blank = F.coalesce(F.length(strip(F.col("text"))) == 0, F.lit(True))
    return joined.withColumn("role", role).withColumn("line", F.when(~blank, speaker_line(F.col("speaker_name"), role, F.col("offsetMs"), F.col("text"))))


def window_count(total: Column, size: int = SIZE, stride: int = STRIDE) -> Column:
    """Windows of a call of ``total`` utterances: the last one is the first to reach its end."""
    return F.when(total == 0, 0).otherwise(F.least(F.ceil(F.greatest(total - size, F.lit(0)) / stride), F.ceil(total / stride) - 1) + 1)


def windows(rows: DataFrame, size: int = SIZE, stride: int = STRIDE) -> DataFrame:
    """One row per utterance and window it lies in: ``chunk_index`` is added."""
    first = F.greatest(F.ceil((F.col("position") - size + 1) / stride), F.lit(0))
    last = F.least(F.floor(F.col("position") / stride), window_count(F.col("total"), size, stride) - 1)
    return rows.withColumn("chunk_index", F.explode(F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<bigint>"))))


def window_texts(rows: DataFrame, size: int = SIZE, stride: int = STRIDE) -> DataFrame:
    """Rendered windows with their quality figures; groups hold at most ``size`` utterances.

    ``first_ms`` is where the first utterance begins, ``last_ms`` where the last one ends.
    """
    words = F.size(F.filter(F.split(strip(F.col("text")), rf"{SPACE}+"), lambda w: w != ""))
    seen = F.col("line").isNotNull()
    return (
        windows(rows, size, stride)
        .groupBy("recordingId", "chunk_index")
        .agg(
            F.count("*").alias("utterances"),
            F.min("offsetMs").alias("start_ms"),
            F.max("offsetMs").alias("end_ms"),
            F.coalesce(F.min_by("offsetMs", "position"), F.lit(0)).alias("first_ms"),
            F.max_by(F.coalesce("offsetMs", F.lit(0)) + F.coalesce("durationMs", F.lit(0)), "position").alias("last_ms"),
            F.sum(F.when(seen, nonspace_length(F.col("text"))).otherwise(0)).alias("nonspace_chars"),
            F.size(F.array_distinct(F.flatten(F.collect_list(F.when(seen, alphabetic_tokens(F.col("text"))))))).alias("unique_tokens"),
            F.count_if(seen & (words >= LONG_WORDS)).alias("long_utterances"),
            F.array_sort(F.collect_set("role")).alias("roles"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(seen, F.struct("position", "line")))), lambda x: x["line"]), "\n").alias("text"),
        )
        .withColumn("kept", (F.col("nonspace_chars") >= LEAST_CHARS) & (F.col("unique_tokens") >= LEAST_TOKENS) & (F.col("long_utterances") >= 1))
    )
