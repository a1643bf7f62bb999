from __future__ import annotations

import json
from datetime import datetime

from hypothesis import given
from hypothesis import strategies as st

from brindle.functions.tags import split_packed
from brindle.operators.packed import split_values, ticket_tags

WORDS = st.text(st.characters(codec="utf-8", exclude_characters=" \t\r\n,;|\"'[]\\　\v\f\x00", exclude_categories=("Z", "C")), min_size=1, max_size=8).filter(lambda w: w != "null" and w.strip() == w)


@given(st.lists(WORDS, max_size=6), st.sampled_from([",", ", ", ";", " | ", "\t", "\n", " ", ",,"]))
def test_delimited_round_trip(words, mark):
    assert split_packed(mark.join(words)) == words


@given(st.lists(st.text(st.characters(exclude_categories=("Cs",)), max_size=10), max_size=6), st.booleans(), st.booleans())
def test_json_round_trip(values, ascii_only, twice):
    text = json.dumps(values, ensure_ascii=ascii_only)
    assert split_packed(json.dumps(text) if twice else text) == [v.strip() for v in values if v.strip()]


def test_quotes_escapes_and_odd_ends():
    assert split_packed('a, "b, c" ;"say ""hi"" x"') == ["a", "b, c", 'say "hi" x']
    assert split_packed("['a', 'b c']") == ["a", "b c"]
    assert split_packed('["a", "b c') == ["a", "b c"]
    assert split_packed('["gr\\u00f6\\u00dfe", null, "null"]') == ["größe", "null"]
    assert split_packed('[["a"], ["b"]]') == ["a", "b"]
    for empty in (None, "", "  ", "null", '""', "[]", ",;|"):
        assert split_packed(empty) == []
    assert len(split_packed("x," * 50_000)) == 50_000


def test_latest_export_wins_and_clashing_names(spark):
    rows = [("1", "a,b", datetime(2026, 1, 1), 7), ("1", "c", datetime(2026, 1, 2), 8), ("1", "c", datetime(2026, 1, 2), 9), ("2", None, None, 1), (None, "x", datetime(2026, 1, 1), 1)]
    meta = spark.createDataFrame(rows, "TICKET_ID string, TAG_LIST string, LOADED_AT timestamp, pos int")
    assert [tuple(r) for r in ticket_tags(meta).collect()] == [("1", 1, "c")]
    assert ticket_tags(meta.limit(0)).count() == 0
    assert [tuple(r) for r in split_values(spark.createDataFrame([(1, "x x")], "k int, v string"), "k", "v").collect()] == [(1, 1, "x"), (1, 2, "x")]
