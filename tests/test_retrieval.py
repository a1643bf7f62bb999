from __future__ import annotations

import math
import random
import sqlite3

from pyspark.sql import functions as F

from brindle.operators import retrieval as R
from brindle.operators.index import VersionedIndex, search_datasets

VOCABULARY = "sync export exports exported row rows check in check-in contact contacts drop the éclair eclair running run".split()


def corpus(n=60):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(VOCABULARY, k=rng.randrange(0, 4))), "the " + " ".join(rng.choices(VOCABULARY, k=rng.randrange(0, 30)))) for i in range(n)]
    return rows + [(n, None, "check"), (n + 1, "check", "in"), (n + 2, "x", None)]


def fts(rows, question):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(title, text, tokenize='porter unicode61 remove_diacritics 2')")
    for i, title, text in rows:
        db.execute("INSERT INTO t(rowid, title, text) VALUES (?, ?, ?)", (i + 1, title, text))
    match = " OR ".join(f'"{" ".join(p)}"' for p in R.parse_query(question))
    return {i - 1: s for i, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}


def test_bm25_with_stems_phrases_repeats_and_clamp_equals_fts5(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "id int, title string, text string")
    for question in ("sync", "sync sync drop", "check-in contacts", "the exporting", "run éclair", "nothing here"):
        got = {r["id"]: r["bm25"] for r in R.bm25_scores(docs, "id", question, stemming=True).collect()}
        want = fts(rows, question)
        assert got.keys() == want.keys(), question
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want), question


def test_postings_give_the_same_scores(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), "id int, title string, text string")
    index = VersionedIndex(spark, str(tmp_path / "idx"))
    index.publish({"records": docs.withColumn("parent_id", F.lit("p")).withColumn("source_path", F.lit("s")), **search_datasets()})
    some = docs.where("id % 7 = 0").select("id")
    for question, stemming, allowed in (("sync sync drop", False, None), ("check-in contacts", True, some), ("check-in rows", False, None), ("run éclair the", True, None), ("nothing here", True, None), (" x ! ", True, None)):
        got = {r["id"]: r["bm25"] for r in R.index_scores(index, question, allowed, stemming).collect()}
        want = {r["id"]: r["bm25"] for r in R.bm25_scores(docs, "id", question, allowed=allowed, stemming=stemming).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want), question
    plan = index.read("postings").where(F.col("stem").isin("sync", "row"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(stem, [" in plan
    empty = VersionedIndex(spark, str(tmp_path / "empty"))
    empty.publish({"records": docs.limit(0).withColumn("parent_id", F.lit("p")).withColumn("source_path", F.lit("s")), **search_datasets()})
    assert R.index_scores(empty, "sync").count() == 0


def test_filter_comes_before_the_top_k_and_empty_inputs(spark):
    docs = spark.createDataFrame(corpus(), "id int, title string, text string")
    some = docs.where("id % 7 = 0").select("id")
    all_scores = {r["id"]: r["bm25"] for r in R.bm25_scores(docs, "id", "sync row").collect()}
    kept = {r["id"]: r["bm25"] for r in R.bm25_scores(docs, "id", "sync row", allowed=some).collect()}
    assert kept == {k: v for k, v in all_scores.items() if k % 7 == 0}
    assert R.bm25_scores(docs, "id", " x ! ").count() == 0
    assert R.bm25_scores(docs.limit(0), "id", "sync").count() == 0


def test_top_k_plans_without_a_full_sort(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = R.top(R.bm25_scores(docs, "doc_id", "sync"), "bm25", 5, ascending=True)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    vectors = spark.read.parquet(f"{small}/embeddings.parquet").withColumn("text", F.lit("x"))
    scan = R.vector_scores(vectors, "vec_id", "embedding", [0.0] * 64)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in scan


def test_fusion_is_symmetric_and_strong_by_both_or_score(spark):
    v = spark.createDataFrame([(1, 0.9), (2, 0.2)], "id int, cosine double")
    w = spark.createDataFrame([(2, -3.0), (3, -1.0)], "id int, bm25 double")
    got = {r["id"]: r for r in R.fuse(v, w).collect()}
    assert math.isclose(got[1]["rrf"], 1 / 61) and math.isclose(got[2]["rrf"], 1 / 62 + 1 / 61) and math.isclose(got[3]["rrf"], 1 / 62)
    assert [got[k]["strong"] for k in (1, 2, 3)] == [True, True, False]
    empty = R.fuse(v.limit(0), w.limit(0))
    assert empty.count() == 0


def test_vector_search_equals_brute_force_with_nulls_and_ties(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)] if i % 9 else None) for i in range(80)]
    vectors = spark.createDataFrame(rows, "id bigint, v array<float>").repartition(5)
    for blocks in ({}, {"row_block": 17, "query_block": 2}):
        got = {(r["query_id"], r["rank"]): r["id"] for r in R.vector_search(vectors, vectors.where("id % 20 = 0"), "id", "v", 5, dim=4, **blocks).collect()}
        for q, qv in rows:
            if q % 20 == 0 and qv:
                best = sorted((-round(sum(a * b for a, b in zip(qv, v)), 9), i) for i, v in rows if v)[:5]
                assert [got[q, k + 1] for k in range(5)] == [i for _, i in best]
    assert R.vector_search(vectors.limit(0), vectors.limit(0), "id", "v", 5, dim=4).count() == 0


def test_parents_keep_three_excerpts_in_order(spark):
    rows = [(f"c{i}", "p", f"t{i}", "x" * 600, float(i), i == 0, True) for i in range(5)] + [("d", "q", None, None, 9.0, False, False)]
    got = {r["parent_id"]: r for r in R.group_by_parent(spark.createDataFrame(rows, "id string, parent_id string, title string, text string, score double, in_vector boolean, in_keyword boolean")).collect()}
    assert got["p"]["excerpt_ids"] == ["c4", "c3", "c2"] and got["p"]["title"] == "t4" and got["p"]["in_vector"] and len(got["p"]["excerpts"][0]) == 500
    assert got["q"]["score"] == 9.0
