"""Several values in one field: one row per value, position kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.tags import packed_values


def latest_by(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """One row per ``key``: the columns of the row with the largest ``order``.

    Aggregates map-side, so a hot key needs no sort. Null orders come first, ties are
    broken by the columns' own values; rows without a key are left out.
    """
    rank = F.struct(F.col(order), *[F.col(c) for c in columns])
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key))
        .agg(F.max(rank).alias("_last"))
        .select(key, *[F.col(f"_last.{c}").alias(c) for c in columns])
    )


def split_values(df: DataFrame, key: str, column: str, value: str = "value", position: str = "pos") -> DataFrame:
    """``(key, position, value)``, positions from 1 over the values of ``column`` without blank ones.

    Null, empty and blank fields give no row; repeats are kept; other columns of ``df``
    play no part, whatever their names.
    """
    values = df.select(F.col(key), packed_values(F.col(column)).alias("_values"))
    return values.select(key, F.posexplode("_values").alias(position, value)).withColumn(position, (F.col(position) + 1).cast("bigint"))


def ticket_tags(meta: DataFrame) -> DataFrame:
    """Tags of each ticket's latest export: ``(ticket_id, pos, tag)``."""
    latest = latest_by(meta.select("TICKET_ID", "TAG_LIST", "LOADED_AT"), "TICKET_ID", "LOADED_AT", "TAG_LIST")
    return split_values(latest, "TICKET_ID", "TAG_LIST", "tag").withColumnRenamed("TICKET_ID", "ticket_id")
