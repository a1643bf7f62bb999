"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.clusters import TEXT_COSINE, TEXT_DIM, cluster_members, describe_clusters, hashed_vectors, tight_clusters, unit_vectors
from brindle.llm.leaks import leaked_items
from brindle.llm.packing import container_fill, fill_containers
from brindle.llm.pieces import split_oversized
from brindle.llm.pii import find_personal, name_lexicon, redact_personal
from brindle.llm.turns import speaker_turns
from brindle.sources.tables import table


def p2_turns(spark: SparkSession, root: str) -> DataFrame:
    return speaker_turns(table(spark, root, "transcript"), table(spark, root, "recording"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    turns = speaker_turns(table(spark, root, "transcript"), table(spark, root, "recording"), words=False)
    return turns.select("recording_id", "first_utterance_id", "utterance_count", "speaker_id")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return tight_clusters(cluster_members(unit_vectors(table(spark, root, "records"), "id", "embedding")))


def p5_clusters(spark: SparkSession, root: str) -> DataFrame:
    return describe_clusters(cluster_members(unit_vectors(table(spark, root, "records"), "id", "embedding")))


def p5_text_clusters(spark: SparkSession, root: str) -> DataFrame:
    return describe_clusters(cluster_members(hashed_vectors(table(spark, root, "records"), "id", "text"), TEXT_COSINE, TEXT_DIM, centroids=True))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    leaks = leaked_items(table(spark, root, "documents"), table(spark, root, "eval_items"), passages_only=True)
    return leaks.where("contained").select("doc_id", "item_id")


def p7_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Items whose tiles cover at least half of them in a document, in whatever order."""
    leaks = leaked_items(table(spark, root, "documents"), table(spark, root, "eval_items"))
    return leaks.where("2 * covered >= item_words").select("doc_id", "item_id", "covered", "item_words")


def p6_containers(spark: SparkSession, root: str) -> DataFrame:
    return fill_containers(table(spark, root, "documents"))


def p6_fill(spark: SparkSession, root: str) -> DataFrame:
    return container_fill(p6_containers(spark, root))


def p8_pieces(spark: SparkSession, root: str) -> DataFrame:
    return split_oversized(table(spark, root, "documents"))


def _personal(spark: SparkSession, root: str, operator) -> DataFrame:
    transcript, records = table(spark, root, "transcript"), table(spark, root, "records")
    lexicon = name_lexicon(transcript, table(spark, root, "recording"))
    spoken = operator(transcript, "utterance_id", "text", lexicon).withColumn("src_table", F.lit("transcript"))
    return spoken.unionByName(operator(records, "id", "text", lexicon).withColumn("src_table", F.lit("records")))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return _personal(spark, root, find_personal).select("src_table", "row_key", "pii_type", "mention").distinct()


def p1_redacted(spark: SparkSession, root: str) -> DataFrame:
    return _personal(spark, root, redact_personal).select("src_table", "row_key", "text").distinct()


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p6_containers": p6_containers, "p6_fill": p6_fill, "p8_pieces": p8_pieces, "p7_found": p7_found, "p7_coverage": p7_coverage, "p5_found": p5_found, "p5_clusters": p5_clusters, "p5_text_clusters": p5_text_clusters, "p2_found": p2_found, "p2_turns": p2_turns}
SQL: dict[str, str] = {}
