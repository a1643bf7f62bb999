"""Invented corpora in the shapes of the raw folders."""

from __future__ import annotations

import json
from datetime import datetime

import pytest

from brindle.operators.embedding import embedded, hashing_embedder, provider
from brindle.operators.index import VersionedIndex, plan_build, postings, search_datasets, term_stats, upsert, without_sources
from brindle.operators.retrieval import bm25_scores, index_scores
from brindle.sources.corpora import call_transcripts, cr_tickets, limited, stopword_file, support_tickets
from brindle.streaming.incremental import follow_folder, merge_batch


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def test_support_tickets(spark, tmp_path):
    write(tmp_path / "202601/1/meta.json", {"TICKET_ID": "1", "TICKET_SUBJECT": "Chart is empty", "TAG_LIST": '["a", "b"]', "CREATED_AT": "2026-01-05T10:00:00Z", "SAT_SCORE": 5})
    write(tmp_path / "202601/1/body.md", "# Chart is empty\n\nPlease help.\n")
    write(tmp_path / "202602/2/meta.json", {"TICKET_ID": "2", "TICKET_SUBJECT": " ", "TAG_LIST": "broken"})
    write(tmp_path / "202602/3/meta.json", "{ no json")
    write(tmp_path / "202602/4/body.md", "a folder without meta")
    got = {r["id"]: r for r in support_tickets(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["support:1", "support:2"]
    assert got["support:1"]["text"] == "[tags: a, b]\n\n# Chart is empty\n\nPlease help."
    assert got["support:1"]["metadata"]["partition"] == "202601" and got["support:1"]["metadata"]["created_at"] == "2026-01-05" and got["support:1"]["metadata"]["sat_score"] == 5
    assert got["support:2"]["text"] == "2" and got["support:2"]["metadata"]["tags"] == []
    assert [r["id"] for r in limited(support_tickets(spark, str(tmp_path)), 1).collect()] == ["support:1"]


def test_call_transcripts(spark, tmp_path):
    write(tmp_path / "77/name.txt", "Marlin Robotics \n")
    call = {"id": "5", "attributes": {"title": "Demo", "createdAt": "2026-02-03T08:00:00Z", "mediaDurationSeconds": "61.9", "participants": [{"inMeetingId": 1, "displayName": "", "firstName": "Ana", "type": "USER"}, {"inMeetingId": None, "displayName": "Bo"}]}}
    write(tmp_path / "77/202602/5/recording.json", call)
    write(tmp_path / "77/202602/5/transcript.json", {"recordingId": "5", "utterances": [{"offsetMs": 0, "durationMs": 5, "speaker": None, "text": "hi"}]})
    write(tmp_path / "78/202602/6/transcript.json", {"recordingId": "6", "utterances": []})
    write(tmp_path / "78/202602/6/recording.json", "[broken")
    write(tmp_path / "78/202602/7/transcript.json", "nothing")
    got = {r["id"]: r for r in call_transcripts(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["call:5", "call:6"]
    assert got["call:5"]["text"] == "Demo\naccount: Marlin Robotics\ndate: 2026-02-03\nparticipants: Ana [USER], Bo [UNKNOWN]"
    assert got["call:5"]["metadata"]["duration_seconds"] == 61 and got["call:5"]["utterances"][0]["text"] == "hi"
    assert got["call:6"]["title"] == "recording 6" and got["call:6"]["metadata"]["account_name"] == "" and got["call:6"]["metadata"]["account_id"] == "78"


def test_change_requests_and_stopwords(spark, tmp_path):
    tree = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "why"}]}]}
    write(tmp_path / "CR-1.json", {"key": "CR-1", "summary": "Faster export", "description": tree, "workaround": None, "labels": ["x"], "created": "2026-01-01T00:00:00"})
    write(tmp_path / "other.json", {"key": "no"})
    row = cr_tickets(spark, str(tmp_path)).collect()
    assert len(row) == 1 and row[0]["text"] == "Faster export\n\nwhy" and row[0]["metadata"]["created"] == "2026-01-01"
    write(tmp_path / "stop.txt", "Alpha\n# note\n\n beta \nalpha\n")
    assert sorted(r["word"] for r in stopword_file(spark, str(tmp_path / "stop.txt")).collect()) == ["alpha", "beta"]


RECORDS = "id string, parent_id string, title string, text string, source_path string, source_mtime timestamp, deleted_at timestamp"


def records(spark, *rows):
    return spark.sql("SELECT 1").sparkSession.createDataFrame([(i, i[0], None, t, s, None, None) for i, t, s in rows], RECORDS)


def test_incremental_equals_fresh_and_upsert_is_idempotent(spark, tmp_path):
    old = records(spark, ("a1", "one", "a"), ("a2", "two", "a"), ("b1", "old", "b"), ("c1", "gone", "c"))
    new = records(spark, ("b1", "new", "b"), ("d1", "four", "d"))
    disk = spark.createDataFrame([("a", 1), ("b", 9), ("d", 1)], "source_path string, mtime int")
    indexed = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "source_path string, mtime int")
    plan = plan_build(disk, indexed)
    assert {tuple(r) for r in plan.collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "deleted"), ("d", "new")}
    kept = without_sources(old, plan.where("state IN ('deleted', 'changed')"))
    fresh = records(spark, ("a1", "one", "a"), ("a2", "two", "a"), ("b1", "new", "b"), ("d1", "four", "d"))
    once = upsert(kept, new)
    assert sorted(once.collect()) == sorted(upsert(once, new).collect()) == sorted(fresh.select(once.columns).collect())
    index = VersionedIndex(spark, str(tmp_path / "idx"))
    assert index.current() is None and not index.has("records")
    assert index.publish({"records": old}) == 1 and index.publish({"records": once, "postings": postings(once)}) == 2
    assert index.read("records").count() == 4 and index.manifest()["parent_count"] == 3 and index.has("postings")
    assert {r["stem"]: (r["df"], r["cf"]) for r in term_stats(index.read("postings")).collect()}["four"] == (1, 1)
    with pytest.raises(FileNotFoundError):
        VersionedIndex(spark, str(tmp_path / "none")).read("records")


def test_stream_follows_a_folder(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "idx")

    def add(*rows):
        spark.createDataFrame([(i, i[0], None, t, i[0], at, gone) for i, t, at, gone in rows], RECORDS).write.mode("append").parquet(folder)
        follow_folder(spark, folder, RECORDS, root, str(tmp_path / "cp")).awaitTermination()
        index = VersionedIndex(spark, root)
        found = {r["id"]: r["bm25"] for r in index_scores(index, "one").collect()}
        assert found == {r["id"]: r["bm25"] for r in bm25_scores(index.read("records"), "id", "one", stemming=True).collect()}
        return {r["id"]: r["text"] for r in index.read("records").collect()}

    day = lambda d: datetime(2026, 1, d)
    assert add(("a1", "one", day(2), None), ("b1", "one two", day(2), None), ("c1", "one", None, None)) == {"a1": "one", "b1": "one two", "c1": "one"}
    VersionedIndex(spark, root).publish({"topics": spark.createDataFrame([(1, "x")], "topic_id int, label string")}, {"batch_id": 0})
    assert add(("a1", "changed one", day(3), None), ("b1", "late", day(1), None), ("c1", "timed", day(1), None)) == {"a1": "changed one", "b1": "one two", "c1": "timed"}
    assert add(("b1", "one two", day(4), day(4))) == {"a1": "changed one", "c1": "timed"}
    assert add(("b1", "older than its deletion", day(3), None)) == {"a1": "changed one", "c1": "timed"}
    index = VersionedIndex(spark, root)
    assert index.manifest()["batch_id"] == 3 and index.has("topics") and index.read("topics").count() == 1
    assert merge_batch(index, spark.read.parquet(folder).limit(0)) == 6 and index.read("records").count() == 2


def test_a_part_written_version_is_not_seen(spark, tmp_path):
    index = VersionedIndex(spark, str(tmp_path / "idx"))
    assert index.publish({"records": records(spark, ("a1", "one", "a"))}) == 1
    records(spark, ("z1", "half", "z")).write.parquet(str(tmp_path / "idx" / "v=2" / "records"))  # a build that was lost
    assert index.current() == 1 and [r["id"] for r in index.read("records").collect()] == ["a1"]
    assert index.publish({"records": records(spark, ("b1", "two", "b"))}) == 3 and index.current() == 3
    assert index.publish({}, keep=False) == 4 and not index.has("records")


def test_texts_are_embedded_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    base = hashing_embedder(8)

    def counting(texts):
        seen.add(len(texts))
        return base(texts)

    rows = records(spark, *((f"a{k}", "one two", "a") for k in range(6)))
    vectors = embedded(rows, "id", "text", counting).select("id", "embedding")
    index = VersionedIndex(spark, str(tmp_path / "idx"))
    index.publish({"records": rows.join(vectors, "id", "left"), **search_datasets()})
    assert seen.value == 6 and index.manifest()["doc_count"] == 6 and index.manifest()["token_count"] == 12


def test_embedding_providers(spark):
    rows = spark.createDataFrame([("1", "a b"), ("2", None), ("3", "bad"), ("4", "c")], "id string, text string")
    base = hashing_embedder(8)

    def fails(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return base(texts)

    got = {r["id"]: r for r in embedded(rows.coalesce(1), "id", "text", fails, prefix="").collect()}
    assert abs(sum(x * x for x in got["1"]["embedding"]) - 1) < 1e-9 and got["4"]["error"] is None
    assert got["2"]["error"] == "no text" and got["3"]["error"] == "no"
    with pytest.raises(ValueError):
        provider("other")
    assert [r["error"] is not None and "sentence-transformers" in r["error"] for r in embedded(rows.where("id = '1'"), "id", "text", provider("model", model="none")).collect()] in ([True], [False])
