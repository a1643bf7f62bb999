from __future__ import annotations

import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from brindle.llm.packing import container_fill, fill_containers, pack
from brindle.llm import pieces as P
from brindle.llm.tokens import count


@given(st.lists(st.integers(0, 60), max_size=120))
def test_packing_keeps_the_capacity_and_is_near_the_best(sizes):
    at = pack(np.array(sizes, np.int64), 60)
    used = np.bincount(at, weights=sizes) if sizes else np.zeros(0)
    assert (used <= 60).all() and (at >= 0).all() and len(at) == len(sizes)
    least = max(-(-sum(sizes) // 60), sum(s > 30 for s in sizes), (sum(3 * s > 60 for s in sizes) + 1) // 2)
    assert len(used) <= 1.5 * least + 1


def test_containers(spark):
    rng = random.Random(1)
    docs = [(i, " word" * rng.randrange(1, 200), "x") for i in range(300)] + [(1000, " long" * 1234, "x"), (1001, None, "x"), (1002, "", "x"), (None, "x", "x"), (5, " word", "x")]
    filled = fill_containers(spark.createDataFrame(docs, "doc_id bigint, text string, container_id string"), capacity=256, shard_items=100).toPandas()
    assert filled.groupby("container_id").item_tokens.sum().max() <= 256
    assert filled[filled.doc_id == 1000].sort_values("piece_no").item_tokens.tolist() == [256, 256, 256, 256, 210]
    assert sorted(set(filled.doc_id)) == [*range(300), 1000, 1002] and not filled.duplicated(["doc_id", "piece_no"]).any()
    assert container_fill(spark.createDataFrame(filled), 256).first()["fill"] > 0.93
    assert fill_containers(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def texts():
    rng = random.Random(2)
    words = "chart export ticket größe café 日本語 agent folder".split()
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(3, 15))).capitalize() + rng.choice([".", "?", "!"])
    prose = "\n\n".join(" ".join(sentence() for _ in range(rng.randrange(1, 8))) for _ in range(60))
    return {
        1: prose,
        2: "a1/b2;" * 3000,
        3: "これは長い文章です。" * 400,
        4: "x" * 9000,
        5: "short",
        6: "line of a log 12:01\n" * 900,
        7: prose * 12,
        8: " \n" * 4000 + "end",
        9: "é🙂" * 3000,
    }


SMALL_RANGES = {"limit": 120, "overlap": 20, "range_chars": 2000, "halo_chars": 200, "segment_tokens": 1}


def split(spark, rows, **options):
    return P.split_oversized(spark.createDataFrame(rows, "doc_id bigint, text string, piece_no int"), **SMALL_RANGES | options).toPandas().sort_values(["doc_id", "piece_no"])


def test_pieces_cover_and_overlap(spark):
    source = texts()
    rows = [(k, t, 1) for k, t in source.items()] + [(10, None, 1), (11, "", 1), (None, source[1], 1), (1, source[1], 2)]
    got = split(spark, rows, giant_ranges=4)
    assert set(got.doc_id) == {k for k, t in source.items() if count(t) > 120}
    for doc, part in got.groupby("doc_id"):
        text, end = source[doc], 0
        assert part.piece_no.tolist() == list(range(1, len(part) + 1))
        for a, b, piece, tokens in zip(part.start_char, part.end_char, part.text, part.tokens):
            assert text[a:b] == piece and a <= end < b and tokens == count(piece) <= 120, (doc, a, b, end, tokens)
            if end:
                assert count(text[a:end]) >= 17, (doc, a, end)
            end = b
        assert end == len(text)
    prose = got[got.doc_id == 1]
    assert (prose.cut_level >= P.SENTENCE).mean() > 0.95
    assert P.split_oversized(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_giant_texts_have_the_same_pieces(spark):
    """However many ranges and segments a text is dealt into; levels and lengths as if it were read in one go."""
    source = {k: t * (1 + 90_000 // len(t)) for k, t in texts().items() if k != 5}
    rows = [(k, t, 1) for k, t in source.items()]
    whole, dealt = split(spark, rows), split(spark, rows, giant_ranges=1)
    assert whole.values.tolist() == dealt.values.tolist()
    assert whole[whole.doc_id == 1].tokens.sum() > 3 * (4 * 2200 + 121)  # over two segments
    inner = whole[whole.piece_no < whole.groupby("doc_id").piece_no.transform("max")]
    for doc, end, level in zip(inner.doc_id, inner.end_char, inner.cut_level):
        behind, after = source[doc][:end], source[doc][end:]
        if level == P.PARAGRAPH:
            blank = behind[len(behind.rstrip()) :] + after[: len(after) - len(after.lstrip())]
            assert blank.count("\n") >= 2, (doc, end)
        elif level >= P.WORD:
            assert behind[-1].isspace() or after[0].isspace() or behind.rstrip()[-1] in "。！？．", (doc, end, level)


def test_repeated_ids_count_their_largest_text(spark):
    got = split(spark, [(1, "word " * 200, 1), (1, "zebra " * 200, 2), (2, "one " * 200, 1)])
    assert set(got[got.doc_id == 1].text.str[:5]) == {"zebra"} or got[got.doc_id == 1].text.str.contains("word").sum() == 0
    assert (got[got.doc_id == 2].tokens <= 120).all()
