"""Topic operators on small invented tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from brindle.operators import topics as T


def test_stop_words_as_list_table_or_join_are_the_same(spark, monkeypatch):
    rng = random.Random(5)
    words = "chart export ticket folder agent seat plan the and of".split()
    texts = spark.createDataFrame([(k % 4, " ".join(rng.choices(words, k=12))) for k in range(40)] + [(1, None), (2, ""), (3, "the and")], "topic_id int, text string")
    stop = ["the", "and", "of", "none"]
    table = spark.createDataFrame([(w,) for w in stop + ["the", None]], "word string")
    wanted = {tuple(r) for r in T.class_terms(texts, stop).collect()}
    assert wanted and not any(w in stop for _, t, _ in wanted for w in t.split())
    assert {tuple(r) for r in T.class_terms(texts, table).collect()} == wanted
    monkeypatch.setattr(T, "LISTED_STOPWORDS", 2)
    assert {tuple(r) for r in T.class_terms(texts, table).collect()} == wanted
    assert T.class_terms(texts, table.limit(0)).count() > len(wanted)
    assert T.class_keywords(texts.limit(0), stop).count() == 0


def test_words_of_speakers_keep_letters_of_any_script(spark):
    names = spark.createDataFrame([("José O'Brien",), ("李 Van-Court (Tax)",), (None,), ("",), ("A. 7",)], "name string")
    assert {r["word"] for r in T.speaker_words(names).collect()} == {"josé", "jos", "obrien", "brien", "vancourt", "van", "court", "tax"}


def test_clusters_fitted_on_a_sample_place_every_row(spark):
    rng = random.Random(2)
    rows = [(f"r{k}", [float(k % 3 == d) * 5 + rng.random() / 10 for d in range(6)]) for k in range(90)] + [("null", None)]
    vectors = spark.createDataFrame(rows, "id string, embedding array<float>")
    for sample in (None, 0.5):
        got = T.cluster(vectors, 3, least=5, sample=sample).collect()
        assert len(got) == 90 and len({r["topic_id"] for r in got}) == 3 and all(0 < r["probability"] <= 1 for r in got)
        assert all(len({r["topic_id"] for r in got if int(r["id"][1:]) % 3 == d}) == 1 for d in range(3))
    assert T.cluster(vectors.limit(0), 3).count() == 0


def test_catalog_head_links_every_topic(spark):
    topics = spark.createDataFrame([(0, "chart, export", 5), (7, None, None), (-1, "(outliers)", 9)], "topic_id int, label string, size bigint")
    lines = [r["line"] for r in T.catalog_head(topics).orderBy("n").collect()]
    assert lines[0].startswith("# Topics\n\n3 topics, 14 records\n")
    assert lines[1:] == ["| [-1](#topic--1-outliers) | (outliers) | 9 |", "| [0](#topic-0-chart-export) | chart, export | 5 |", "| [7](#topic-7-) |  | 0 |"]


def test_parents_have_their_shares(spark):
    assigned = spark.createDataFrame([(f"c{k}", t) for k, t in enumerate([1, 1, 1, 2, 2, 3, 4, 5, 5, 5])], "record_id string, topic_id int").withColumn("probability", F.lit(None).cast("double"))
    records = assigned.select(F.col("record_id").alias("id"), F.lit("p").alias("parent_id"))
    row = T.parent_topics(assigned, records).first()
    assert (row["primary_topic_id"], row["primary_share"], row["chunk_count"], row["secondary"], row["secondary_shares"]) == (1, 0.3, 10, ["5:3", "2:2", "3:1"], [0.3, 0.2, 0.1])
