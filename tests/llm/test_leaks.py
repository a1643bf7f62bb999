from __future__ import annotations

import random

import numpy as np

from brindle.llm import leaks as L

WORDS = [f"{a}{b}" for a in ("red", "blue", "green", "old", "new", "fast") for b in ("chart", "export", "ticket", "agent", "folder", "window", "plan", "seat")]


def edits_needed(item, text):
    """Fewest edits that turn the words of ``item`` into some stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def brute(item, text):
    """Stretches that begin and end with a kept word, as an edit at the end is no part of the passage."""
    for a in range(len(item)):
        for b in range(a + 12, len(item) + 1):
            if item[a] in text and item[b - 1] in text and edits_needed(item[a:b], text) <= (b - a) // 8:
                return True
    return False


def arrays(text, item):
    numbers = L.Numbers()
    return np.array(numbers.of(text), np.int64), np.array(numbers.of(item), np.int64)


def test_passage_test_equals_brute_force():
    rng = random.Random(4)
    agree = 0
    for case in range(120):
        item = rng.sample(WORDS, 30)
        start, n = rng.randrange(0, 12), rng.randrange(9, 18)
        piece = item[start : start + n]
        for _ in range(rng.randrange(0, 4)):
            k = rng.randrange(len(piece))
            piece[k : k + 1] = rng.choice([[], ["other"], [piece[k], "extra"]])
        text = ["filler"] * 5 + piece + ["filler"] * 5
        a, b = arrays(text, item)
        tiles, shadowed = L.tile(a, b)
        agree += L.contains_passage(a.tolist(), b.tolist(), tiles + shadowed) == brute(item, text)
    assert agree == 120


def test_running_hashes_are_equal_for_equal_windows():
    rng = np.random.default_rng(3)
    numbers = np.tile(rng.integers(-(2**62), 2**62, 40), 3)
    for width in (1, 5, 17, 40):
        h = L.Running(numbers).windows(width)
        assert len(h) == 121 - width and (h[:40] == h[40:80]).all() and len(set(h[:40].tolist())) == 40


def greedy(a, b, least):
    """Tiles by trying every pair of places, the longest unmarked match first."""
    marked_a, marked_b, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for t in range(len(a)):
            for p in range(len(b)):
                n = 0
                while t + n < len(a) and p + n < len(b) and a[t + n] == b[p + n] and t + n not in marked_a and p + n not in marked_b:
                    n += 1
                if n > best[0]:
                    best = (n, t, p)
        if best[0] < least:
            return tiles
        n, t, p = best
        tiles.append(best)
        marked_a.update(range(t, t + n))
        marked_b.update(range(p, p + n))


def test_tiles_cover_what_the_plain_greedy_way_covers():
    rng = random.Random(9)
    for case in range(60):
        letters = [f"w{k}" for k in range(rng.choice((3, 8, 40)))]
        a, b = arrays([rng.choice(letters) for _ in range(50)], [rng.choice(letters) for _ in range(30)])
        tiles, _ = L.tile(a, b, 3)
        for n, t, p in tiles:
            assert (a[t : t + n] == b[p : p + n]).all()
        assert len({t + k for n, t, _ in tiles for k in range(n)}) == sum(n for n, _, _ in tiles) == len({p + k for n, _, p in tiles for k in range(n)})
        wanted = greedy(a.tolist(), b.tolist(), 3)
        assert max((n for n, _, _ in tiles), default=0) == max((n for n, _, _ in wanted), default=0)
        assert sum(n for n, _, _ in tiles) >= 0.8 * sum(n for n, _, _ in wanted)


def test_words_without_markup_prefixes_and_line_hyphens():
    assert L.plain_words("> The *new* plan con-\n> tains <b>two-step</b> seats​.\n12. Next") == ["the", "new", "plan", "contains", "twostep", "seats", "next"]
    assert L.plain_words("これは試験。 plan") == ["こ", "れ", "は", "試", "験", "plan"]
    assert L.plain_words(None) == [] and L.plain_words("") == []


def test_reordered_sentences_are_tiled():
    item = WORDS[:40]
    text = item[20:40] + ["x"] * 3 + item[:20]
    tiles, _ = L.tile(*arrays(text, item))
    assert sum(t[0] for t in tiles) == 40 and len(tiles) == 2


def test_leaks_and_edge_cases(spark, monkeypatch):
    item = " ".join(WORDS[:30])
    docs = [(1, "intro " + item.upper().replace(" ", ",\n> ") + " end", "t"), (2, " ".join(WORDS[:11]), "t"), (3, None, "t"), (4, "", "t"), (5, "pad " * 60_000 + item, "t"), (None, item, "t"), (1, "intro " + item, "t")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(7, item, 0), (8, " ".join(WORDS[20:48]), 0), (9, "too short", 0), (10, None, 0), (7, item, 1)], "item_id bigint, text string, doc_id int")
    for most in (0, L.BROADCAST_WORDS):  # items that go to every task, or that are joined by a shuffle
        monkeypatch.setattr(L, "BROADCAST_WORDS", most)
        for passages_only in (False, True):
            found = {(r["doc_id"], r["item_id"]) for r in L.leaked_items(d, items, passages_only).where("contained").collect()}
            assert found == {(1, 7), (5, 7)}
    covered = {(r["doc_id"], r["item_id"]): (r["covered"], r["item_words"]) for r in L.leaked_items(d, items).collect()}
    assert covered[2, 7] == (11, 30) and covered[1, 7] == (30, 30) and covered[1, 8] == (10, 28)
    assert L.leaked_items(d, items.limit(0)).count() == 0 and L.leaked_items(d.limit(0), items).count() == 0
