"""Queries of the general data problems: packed fields (3) and orphan references (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.orphans import found_orphans, orphan_counts
from brindle.operators.packed import ticket_tags
from brindle.sources.tables import table


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return ticket_tags(table(spark, root, "meta"))


def p3_tag_counts(spark: SparkSession, root: str) -> DataFrame:
    return p3_found(spark, root).groupBy(F.lower("tag").alias("tag")).agg(F.countDistinct("ticket_id").alias("tickets"), F.count("*").alias("uses"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return found_orphans(*[table(spark, root, t) for t in ("transcript", "recording", "record_topics", "records")])


def p4_orphan_counts(spark: SparkSession, root: str) -> DataFrame:
    return orphan_counts(p4_found(spark, root))


_P4 = """
WITH refs AS (
  SELECT 'transcript' AS ref_table, CAST(utterance_id AS VARCHAR) AS ref_key,
         recordingId || '/' || CAST(speaker.inMeetingId AS VARCHAR) AS target, recordingId AS rec, MIN(loaded_at) AS loaded_at
  FROM transcript WHERE speaker.inMeetingId IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT 'record_topics', lower(trim(record_id, E' \\t\\n\\r')), lower(trim(record_id, E' \\t\\n\\r')), NULL, MIN(loaded_at)
  FROM record_topics WHERE record_id IS NOT NULL GROUP BY ALL),
seats AS (
  SELECT id || '/' || CAST(p.inMeetingId AS VARCHAR) AS target, MIN(loaded_at) AS parent_at
  FROM (SELECT id, loaded_at, unnest(attributes.participants) AS p FROM recording) WHERE p.inMeetingId IS NOT NULL GROUP BY ALL),
gone AS (SELECT id, MIN(deleted_at) AS deleted_at FROM recording GROUP BY ALL),
idx AS (
  SELECT lower(trim(id, E' \\t\\n\\r')) AS target, MIN(indexed_at) AS parent_at, MIN(deleted_at) AS deleted_at, TRUE AS has
  FROM records GROUP BY ALL),
judged AS (
  SELECT r.ref_table, r.ref_key, r.loaded_at, s.target IS NOT NULL AS has, s.parent_at, g.deleted_at
  FROM refs r LEFT JOIN seats s USING (target) LEFT JOIN gone g ON g.id = r.rec WHERE r.ref_table = 'transcript'
  UNION ALL
  SELECT r.ref_table, r.ref_key, r.loaded_at, coalesce(i.has, FALSE), i.parent_at, i.deleted_at
  FROM refs r LEFT JOIN idx i USING (target) WHERE r.ref_table = 'record_topics'),
found AS (
  SELECT ref_table, ref_key, strftime(loaded_at, '%Y-%m') AS period,
         CASE WHEN NOT has THEN 'missing' WHEN parent_at > loaded_at THEN 'late' WHEN deleted_at <= loaded_at THEN 'deleted' END AS status
  FROM judged)
"""

QUERIES = {"p3_found": p3_found, "p3_tag_counts": p3_tag_counts, "p4_found": p4_found, "p4_orphan_counts": p4_orphan_counts}
SQL = {
    "p4_found": _P4 + "SELECT * FROM found WHERE status IS NOT NULL",
    "p4_orphan_counts": _P4 + "SELECT ref_table, period, status, COUNT(*) AS orphans FROM found WHERE status IS NOT NULL GROUP BY ALL",
}
