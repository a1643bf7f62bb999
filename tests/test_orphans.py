from __future__ import annotations

from datetime import datetime

from brindle.operators.orphans import found_orphans

T = [datetime(2026, m, 1) for m in range(1, 7)]
TRANSCRIPT = "recordingId string, utterance_id bigint, speaker struct<inMeetingId:bigint,displayName:string>, loaded_at timestamp, status string"
RECORDING = "id string, attributes struct<participants:array<struct<inMeetingId:bigint>>>, loaded_at timestamp, deleted_at timestamp"


def frames(spark, utterances, calls, topics, records):
    return (
        spark.createDataFrame(utterances, TRANSCRIPT),
        spark.createDataFrame(calls, RECORDING),
        spark.createDataFrame(topics, "record_id string, loaded_at timestamp"),
        spark.createDataFrame(records, "id string, indexed_at timestamp, deleted_at timestamp"),
    )


def test_each_status_and_its_order(spark):
    utterances = [
        ("r", 1, (1, "a"), T[1], "x"),  # there in time
        ("r", 2, (9, "a"), T[1], "x"),  # nobody
        ("r", 3, (2, "a"), T[1], "x"),  # listed later
        ("r", 3, (2, "a"), T[4], "x"),  # repeated row, judged on the first
        ("d", 4, (1, "a"), T[3], "x"),  # deleted before
        ("d", 5, (1, "a"), T[1], "x"),  # deleted after
        ("r", 6, None, T[1], "x"),
        ("r", 7, (None, "a"), T[1], "x"),
        ("none", 8, (1, "a"), None, "x"),
    ]
    calls = [("r", ([(1,), None],), T[0], None), ("r", ([(1,), (2,)],), T[2], None), ("d", ([(1,)],), T[0], None), ("d", (None,), T[1], T[2]), ("e", None, T[0], None), (None, ([(1,)],), T[0], None)]
    topics = [(" Call:1\t", T[1]), ("call:1", T[2]), ("gone", T[3]), ("late", T[0]), ("missing", T[0]), (None, T[0])]
    records = [("call:1", T[0], None), ("GONE", T[0], T[2]), ("late", T[4], None), (None, T[0], None)]
    found = {tuple(r) for r in found_orphans(*frames(spark, utterances, calls, topics, records)).collect()}
    assert found == {
        ("transcript", "2", "2026-02", "missing"),
        ("transcript", "3", "2026-02", "late"),
        ("transcript", "4", "2026-04", "deleted"),
        ("transcript", "8", None, "missing"),
        ("record_topics", "gone", "2026-04", "deleted"),
        ("record_topics", "late", "2026-01", "late"),
        ("record_topics", "missing", "2026-01", "missing"),
    }


def test_empty_tables(spark):
    assert found_orphans(*frames(spark, [], [], [], [])).count() == 0
