from __future__ import annotations

import json
import sqlite3

import pytest

from pyspark.sql import functions as F

from brindle.functions import scalars as S
from brindle.functions.adf import adf_text
from brindle.functions.stemming import plain, stem
from brindle.operators.incidence import incidence


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'bigint' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for n, v in values.items())
    return spark.createDataFrame([tuple(values[n] for n in names)], schema).select(column.alias("x")).first()["x"]


def test_clock_dates_tokens(spark):
    assert one(spark, S.mmss(F.col("v")), v=4505000) == "75:05"
    assert one(spark, S.mmss(F.col("v")), v=-5) == "00:00"
    assert one(spark, S.date_only(F.col("v")), v="2026-01-02T03:04") == "2026-01-02"
    assert one(spark, S.date_only(F.col("v")), v="") is None
    assert one(spark, S.query_tokens(F.col("v")), v="don't stop-it é x") == ["don't", "stop-it"]
    assert one(spark, S.in_date_range(F.col("v"), "2026-01-01", "2026-01-31"), v="2026-01-31T23:00") is True
    for bad in ("2026-02-30", "", None, "soon"):
        assert one(spark, S.in_date_range(F.col("v"), "2026-01-01", None), v=bad) is False
        assert one(spark, S.in_date_range(F.col("v"), None, None), v=bad) is True


def test_tags(spark):
    assert one(spark, S.json_tags(F.col("v")), v='["a", "", null, "b"]') == ["a", "b"]
    for bad in ("a,b", '["a"', "['a']", None, "{}", ""):
        assert one(spark, S.json_tags(F.col("v")), v=bad) == []
    tags = ["agent_business_impact_p3", "agent_business_impact_p1", "support_topic_x", "support_topic_x", "support_topic_", "crm_topic_a", "crm_topic_b"]
    got = one(spark, incidence(F.col("v")), v=tags)
    assert (got["business_impact"], got["support_topics"], got["crm_topic"], got["support_resolution"], got["is_internal_triage"]) == ("P1", ["x"], "a", None, False)


def test_roles_and_ticket_text(spark):
    text = "[A, USER @ 00:01] x\n[B | Org, PROSPECT @ 1:02:03] y\n[C, INTERNAL @ 00:02] z"
    assert one(spark, S.roles_in_text(F.col("v")), v=text) == ["PROSPECT", "USER"]
    assert one(spark, S.roles_in_text(F.col("v")), v=None) == []
    make = S.ticket_text(F.lit("7"), F.col("s"), F.col("t"), F.col("b"))
    assert one(spark, make, s="Hi", t=["a", "b"], b="body") == "[tags: a, b]\n\n# Hi\n\nbody"
    assert one(spark, make, s="Hi", t=[], b="# Hi there") == "# Hi there"
    assert one(spark, make, s=" ", t=[], b=None) == "7"


def test_stems_equal_sqlite():
    words = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner adjustable defensible irritant replacement adjustment dependent adoption communism activate effective bowdlerize probate rate cease controll roll running runs exports exporting exported syncing synced webhooks mapping mapped duplicates duplicated yes by oscillation generalizations".split()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61 remove_diacritics 2')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'row')")
    for w in words:
        db.execute("DELETE FROM t")
        db.execute("INSERT INTO t VALUES (?)", (w,))
        assert [stem(w)] == [r[0] for r in db.execute("SELECT term FROM v")], w
    assert plain("Éclair") == "eclair"


def test_rich_text():
    p = lambda *c: {"type": "paragraph", "content": list(c)}
    t = lambda s, **k: {"type": "text", "text": s, **k}
    item = lambda *c: {"type": "listItem", "content": list(c)}
    doc = {"type": "doc", "content": [
        {"type": "heading", "attrs": {"level": 9}, "content": [t("Top")]},
        p(t("see", marks=[{"type": "link", "attrs": {"href": "http://x"}}]), {"type": "hardBreak"}, {"type": "mention", "attrs": {"text": "@ana"}}),
        {"type": "orderedList", "attrs": {"order": 3}, "content": [item(p(t("a"))), item(), item(p(t("b")), p(t("more")))]},
        {"type": "codeBlock", "content": [t("x = 1")]}, {"type": "blockquote", "content": [p(t("q"))]}, {"type": "mediaSingle"},
        {"type": "table", "content": [{"type": "tableRow", "content": [{"type": "tableCell", "content": [p(t("c"))]}, {"type": "tableCell", "content": [p(t("d"))]}]}]},
        {"type": "odd", "content": [t("kept")]}]}
    assert adf_text(json.dumps(doc)) == "###### Top\n\nsee (http://x)\n@ana\n\n3. a\n5. b\n   \n   more\n\n```\nx = 1\n```\n\n> q\n\nc | d\n\nkept"
    assert adf_text(None) is None and adf_text("{") is None and adf_text('"plain"') == "plain"


def test_rich_text_nodes():
    para = lambda *c: {"type": "paragraph", "content": list(c)}
    t = lambda s: {"type": "text", "text": s}
    a = lambda kind, **k: {"type": kind, "attrs": k}
    inner = {"type": "bulletList", "content": [{"type": "listItem", "content": [para(t("x"))]}]}
    cases = [
        (para(a("mention", text="Ann")), "@Ann"),
        (para(a("mention", displayName="@Bo")), "@Bo"),
        (para(a("mention", id="7"), t("!")), "!"),
        (para(a("emoji", shortName=":up:", text="^")), ":up:"),
        (para(a("emoji", text="^")), "^"),
        (para(t("see"), a("inlineCard", url="http://a"), t("now")), "see (http://a) now"),
        ([para(t("a")), {"type": "rule"}, para(t("b"))], "a\n\n\nb"),
        ({"type": "orderedList", "attrs": {"order": 10}, "content": [{"type": "listItem", "content": [para(t("one")), inner]}]}, "10. one\n    \n      - x"),
        ({"type": "codeBlock", "content": [t("x "), a("emoji", text="no"), t("y\n")]}, "```\nx y\n```"),
        ({"type": "table", "content": [{"type": "tableRow", "content": []}, {"type": "tableRow", "content": [{"type": "tableHeader", "content": [para(t("h"))]}]}]}, "h"),
        (a("heading", level="x"), "#"),
        ({"type": "blockquote", "content": [para(t("q")), para(t("r"))]}, "> q\n> \n> r"),
        ({"type": "text", "text": None}, ""),
        ([], ""),
        (7, ""),
    ]
    for tree, wanted in cases:
        assert adf_text(json.dumps(tree)) == wanted, tree


def test_unit_length(spark):
    unit = spark.sql("SELECT array(3D, 4D) AS v, array(0D, 0D) AS z")
    assert unit.select(S.l2_normalized(F.col("v")).alias("u")).first()["u"] == [0.6, 0.8]
    with pytest.raises(Exception, match="without direction"):
        unit.select(S.l2_normalized(F.col("z"))).collect()


def test_long_suffixes_are_whole(spark):
    tags = ["support_topic_" + "x" * 20_000]
    assert one(spark, S.suffixes(F.col("v"), "support_topic_"), v=tags) == ["x" * 20_000]


def test_call_header_of_blanks(spark):
    made = S.call_header(F.lit("5"), F.col("t"), F.lit("acme"), F.col("d"), S.participants(F.lit(None).cast("array<struct<inMeetingId:bigint,displayName:string,firstName:string,type:string>>")))
    assert one(spark, made, t=" ", d=None) == "recording 5\naccount: acme\ndate: unknown\nparticipants: unknown"
