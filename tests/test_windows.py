from __future__ import annotations

import math

from pyspark.sql import functions as F

from brindle.operators import windows as W

SCHEMA = "recordingId string, utterance_id bigint, offsetMs bigint, speaker struct<inMeetingId:bigint,displayName:string>, text string, position int"


def talk(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "10L AS durationMs", "TIMESTAMP '2026-01-01' AS loaded_at")


def loop(n, size, stride):
    out, start = [], 0
    while start < n:
        end = min(start + size, n)
        out.append((start, end))
        if end >= n:
            break
        start += stride
    return out


def test_windows_equal_a_loop(spark):
    for size, stride in ((20, 18), (4, 3), (3, 5), (2, 2)):
        rows = [(f"r{n}", i, i * 700_000, None, "x", 0) for n in range(0, 45, 4) for i in range(n)]
        got = {}
        for r in W.windows(W.utterances(talk(spark, rows)), size, stride).collect():
            got.setdefault((r["recordingId"], r["chunk_index"]), []).append(r["position"])
        want = {(f"r{n}", k): list(range(a, b)) for n in range(0, 45, 4) for k, (a, b) in enumerate(loop(n, size, stride))}
        assert {k: sorted(v) for k, v in got.items()} == want


def test_order_nulls_repeats_and_roles(spark):
    rows = [("r", 1, None, (1, "A"), "last", 0), ("r", 2, 50, (2, ""), " b ", 0), ("r", 2, 50, (2, ""), " b ", 0), ("r", 3, 50, None, "c", 0), ("r", 4, -70, (9, "N"), "  ", 0), (None, 5, 1, None, "x", 0), ("r", 6, 3_700_000, (1, "A"), None, 0)]
    calls = [("r", ([(1, "A", None, "USER"), None, (2, None, "F", "")],), "2026-01-01")]
    recording = spark.createDataFrame(calls, "id string, attributes struct<participants:array<struct<inMeetingId:bigint,displayName:string,firstName:string,type:string>>>, loaded_at string")
    got = {r["utterance_id"]: r for r in W.rendered_utterances(talk(spark, rows), recording).collect()}
    assert [got[k]["position"] for k in (4, 2, 3, 6, 1)] == [0, 1, 2, 3, 4]
    assert got[2]["line"] == "[Unknown, UNKNOWN @ 00:00] b" and got[1]["line"] == "[A, USER @ 00:00] last" and got[4]["line"] is None and got[6]["line"] is None
    twice = talk(spark, [("r", 1, 5, None, "first", 0)]).unionByName(talk(spark, [("r", 1, 3, None, "later", 0)]).withColumn("loaded_at", F.expr("TIMESTAMP '2026-01-02'")))
    assert [(r["text"], r["total"]) for r in W.utterances(twice).collect()] == [("first", 1)]
    assert W.utterances(talk(spark, [])).count() == 0


def test_quality_gate(spark):
    text = " ".join(f"{chr(97 + i % 26)}{chr(98 + i // 26)}word" for i in range(40))
    rows = [("good", 1, 0, None, text, 0), ("short", 2, 0, None, "one two three four five", 0), ("blank", 3, 0, None, " ", 0)]
    recording = spark.createDataFrame([], "id string, attributes struct<participants:array<struct<inMeetingId:bigint,displayName:string,firstName:string,type:string>>>, loaded_at string")
    got = {r["recordingId"]: r for r in W.window_texts(W.rendered_utterances(talk(spark, rows), recording)).collect()}
    assert got["good"]["kept"] and got["good"]["unique_tokens"] == 40 and got["good"]["nonspace_chars"] == len(text.replace(" ", ""))
    assert not got["short"]["kept"] and got["short"]["long_utterances"] == 1 and got["blank"]["text"] == "" and math.isclose(got["blank"]["nonspace_chars"], 0)
