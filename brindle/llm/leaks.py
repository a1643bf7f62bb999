"""Evaluation passages inside training texts: greedy string tiling by running Karp-Rabin, from joined seeds."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.sources.tables import cut, spread

SEED_WORDS = 5
LEAST_WORDS = 12
WORDS_PER_EDIT = 8
NEAR_SEEDS = 14
FILTER_BITS_EACH, FILTER_BITS_LEAST, FILTER_BITS_MOST = 32, 1 << 16, 1 << 28
BROADCAST_WORDS = 2_000_000

_BASE = 1_000_003
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_PREFIX = r"[ \t]*(?:(?:[>|*#+•–-]|\d{1,4}[.):|]|//)[ \t]*)*"
_BROKEN = re.compile(rf"(?<=[^\W_])[-‐‑][ \t]*\r?\n{_PREFIX}(?=[^\W_])")
_LINE = re.compile(rf"^{_PREFIX}(?:[\[(<]?\d{{1,2}}:\d\d(?::\d\d)?[\])>]?[ \t]*)?", re.M)
_TAG = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]{0,80})?/?>|&(?:nbsp|amp|lt|gt|quot|#\d+);")
_JOINT = re.compile(r"(?<=[^\W_])[-‐‑'’](?=[^\W_])")
_WORDS = re.compile(r"[^\W_]+")
_ASCII_WORDS = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum()})
# Fixed value: scripts written without blanks (kana, ideographs, Thai, Lao, Myanmar, Khmer); each sign counts as a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")


def plain_words(text: str | None) -> list[str]:
    """Words of a text in comparable form: no case, punctuation, markup, invisible marks, line prefixes or hyphens.

    In scripts written without blanks every sign is a word.
    """
    if not text:
        return []
    if not text.isascii():
        text = _UNSPACED.sub(r" \g<0> ", _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)))
    text = text.lower()
    if "-\n" in text or "\n" in text and re.search(r"[-‐‑][ \t\r]*\n", text):
        text = _BROKEN.sub("", text)
    text = _LINE.sub("", text)
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    text = _JOINT.sub("", text)
    return text.translate(_ASCII_WORDS).split() if text.isascii() else _WORDS.findall(text)


class Numbers:
    """Words as 64-bit numbers, the same on every machine."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def of(self, words: list[str]) -> list[int]:
        found = list(map(self.memo.get, words))
        if None in found:
            if len(self.memo) > 500_000:
                self.memo.clear()
            for w in set(words):
                if w not in self.memo:
                    self.memo[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little", signed=True)
            found = list(map(self.memo.get, words))
        return found


def seed_hashes(words: np.ndarray) -> np.ndarray:
    """Karp-Rabin hash of every window of ``SEED_WORDS`` words, its bits mixed."""
    n = len(words) - SEED_WORDS + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(SEED_WORDS if n > 0 else 0):
        h = h * np.uint64(_BASE) + words[k : n + k].astype(np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h.astype(np.int64)


class Running:
    """Karp-Rabin hashes of the windows of any width of a list of numbers, from one running sum."""

    def __init__(self, numbers: np.ndarray) -> None:
        n = len(numbers)
        self.power, inverse = np.full(n + 1, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        self.power[:1] = inverse[:1] = 1
        self.power = self.power.cumprod()
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(numbers.astype(np.uint64) * inverse.cumprod(), out=self.sums[1:])

    def windows(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.power[:n]


def tile(text: np.ndarray, item: np.ndarray, least: int = SEED_WORDS) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Greedy string tiling by running Karp-Rabin: ``(tiles, shadowed)``, each ``(length, place in text, place in item)``.

    The width of the windows shrinks from the shorter side to ``least``. At each width all equal windows of
    unmarked words are extended, and the longest match is marked first; one that overlaps marked words is found again by its
    free part, there or at a smaller width. ``shadowed`` are the equal stretches of ``least`` words that marks left no part of: they
    cover nothing, but a passage may go on from them.
    """
    a, b = text.tolist(), item.tolist()
    running = Running(text), Running(item)
    free_text, free_item = bytearray(b"\1" * len(a)), bytearray(b"\1" * len(b))
    tiles: list[tuple[int, int, int]] = []
    width = min(len(a), len(b))
    while width >= least:
        places: dict[int, list[int]] = {}
        for p, h in enumerate(running[1].windows(width).tolist()):
            places.setdefault(h, []).append(p)
        starts = [(t, p) for t, h in enumerate(running[0].windows(width).tolist()) if h in places for p in places[h]]
        full = b"\1" * width
        while True:
            best: dict[tuple[int, int], int] = {}
            reached: dict[int, int] = {}  # per diagonal, up to where a match has been taken
            for t, p in starts:
                if t < reached.get(t - p, 0) or free_text[t : t + width] != full or free_item[p : p + width] != full or a[t : t + width] != b[p : p + width]:
                    continue
                n = width
                while t + n < len(a) and p + n < len(b) and free_text[t + n] and free_item[p + n] and a[t + n] == b[p + n]:
                    n += 1
                best[t, p] = n
                reached[t - p] = t + n
            if not best:
                break
            marked = False
            for (t, p), n in sorted(best.items(), key=lambda m: (-m[1], m[0])):
                if free_text[t : t + n] == b"\1" * n and free_item[p : p + n] == b"\1" * n:
                    free_text[t : t + n] = free_item[p : p + n] = bytes(n)
                    tiles.append((n, t, p))
                    marked = True
            if not marked:
                break
        if width == least:
            break
        width = max(least, width // 2)
    inside: dict[int, list[tuple[int, int]]] = {}
    for n, t, p in tiles:
        inside.setdefault(t - p, []).append((t, t + n))
    shadowed: list[tuple[int, int, int]] = []
    if min(len(a), len(b)) >= least:
        for t, p in starts:  # of the last width, which is the least
            if not any(x <= t and t + least <= y for x, y in inside.get(t - p, ())) and a[t : t + least] == b[p : p + least]:
                shadowed.append((least, t, p))
    return tiles, shadowed


def _reach(text: list[int], item: list[int], t: int, p: int, step: int, edits: int) -> list[int]:
    """For 0, 1, ... edits, how many words of the item can be taken from (t, p) in one direction; the last one taken is matched."""
    low_t, low_p = (len(text) - t, len(item) - p) if step > 0 else (t + 1, p + 1)

    def slide(i: int, j: int) -> int:
        while i < low_p and j < low_t and item[p + step * i] == text[t + step * j]:
            i += 1
            j += 1
        return i

    front = {0: slide(0, 0)}
    reach = [front[0]]
    for _ in range(edits):
        grown: dict[int, int] = {}
        for d, i in front.items():  # d: places in the text minus places in the item
            for nd, ni in ((d, i + 1), (d - 1, i + 1), (d + 1, i)):
                if ni <= low_p and 0 <= ni + nd <= low_t:
                    grown[nd] = max(grown.get(nd, -1), ni)
        best = reach[-1]
        for d, i in grown.items():
            end = slide(i, i + d)
            if end > i:
                best = max(best, end)
            grown[d] = end
        front = grown
        reach.append(best)
    return reach


def contains_passage(text: list[int], item: list[int], anchors: list[tuple[int, int, int]]) -> bool:
    """Whether some stretch of at least ``LEAST_WORDS`` words of the item is in the text with one edit per ``WORDS_PER_EDIT`` words at most.

    The gaps around each anchor decide: edits are spent to its left and right as far as they reach (furthest-reaching diagonals).
    Exact if the anchors are all tiles and shadowed seeds, since such a stretch holds an unchanged run of ``SEED_WORDS`` words.
    """
    most = len(item) // WORDS_PER_EDIT
    for n, t, p in anchors:
        if n >= LEAST_WORDS:
            return True
        right = _reach(text, item, t + n, p + n, 1, most)
        left = _reach(text, item, t - 1, p - 1, -1, most)
        for a, x in enumerate(left):
            for b, y in enumerate(right):
                if n + x + y >= max(LEAST_WORDS, WORDS_PER_EDIT * (a + b)):
                    return True
    return False


def _bits(hashes: Column, bits: int) -> list[Column]:
    """The places of a hash in a Bloom filter of ``bits`` (a power of two)."""
    return [hashes.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(hashes, 32).bitwiseAND(F.lit(bits - 1))]


def seed_filter(seeds: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the seeds' hashes as 64-bit words, sized by their number ``n`` up to ``FILTER_BITS_MOST`` (32 MB); a fuller one only lets more through."""
    bits = min(FILTER_BITS_MOST, max(FILTER_BITS_LEAST, 1 << math.ceil(math.log2(max(1, n) * FILTER_BITS_EACH))))
    places = seeds.select(F.explode(F.array(*_bits(F.col("hash"), bits))).alias("place"))
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def _lists(values: list[np.ndarray]) -> pa.Array:
    lengths = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), pa.int64()))


_ITEM, _SEED = "item_id bigint, variant bigint, words array<bigint>", "hash bigint, item_id bigint, variant bigint, item_place int, item_words int"
_SUSPECT = "doc_id bigint, version bigint, first int, words array<bigint>, places array<bigint>, hashes array<bigint>"
_LEAK = "doc_id bigint, item_id bigint, tiles int, longest int, covered int, item_words int, contained boolean"


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = Numbers()
    for batch in batches:
        words = [np.array(numbers.of(plain_words(t)), np.int64) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(words)], names=["item_id", "variant", "words"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [np.array(w, np.int64) for w in batch.column(2).to_pylist()]
        hashes = [seed_hashes(w) for w in words]
        row = np.repeat(np.arange(len(words)), [len(h) for h in hashes])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(h)) for h in hashes)])
        size = np.array([len(w) for w in words], np.int64)[row]
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *hashes])), batch.column(0).take(take), batch.column(1).take(take), pa.array(place.astype(np.int32)), pa.array(size.astype(np.int32))], names=["hash", "item_id", "variant", "item_place", "item_words"])


def _suspects(known: np.ndarray, margin: int, near: int | None):
    """Scans documents for windows that may be a seed; one row per document with some, with its words around them."""
    mask = np.int64(len(known) * 64 - 1)

    def test(place: np.ndarray) -> np.ndarray:
        return known[place >> 6] >> (place & 63) & 1 == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for batch in batches:
            lists = [numbers.of(plain_words(t)) for t in batch.column(2).to_pylist()]
            ends = np.cumsum([len(x) for x in lists], dtype=np.int64)
            words = np.array([w for x in lists for w in x], np.int64)
            h = seed_hashes(words)
            at = np.flatnonzero(test(h & mask) & test((h.view(np.uint64) >> np.uint64(32)).astype(np.int64) & mask))
            owner = np.searchsorted(ends, at, side="right")
            inside = at + SEED_WORDS <= ends[owner] if len(at) else np.zeros(0, bool)
            at, owner = at[inside], owner[inside]
            if near is not None and len(at):  # a hit that has no other near it belongs to no passage
                close = (np.diff(at) <= near) & (np.diff(owner) == 0)
                kept = np.append(close, False) | np.insert(close, 0, False)
                at, owner = at[kept], owner[kept]
            docs, start = np.unique(owner, return_index=True)
            stop = np.append(start[1:], len(at))
            first, parts, places, hashes = [], [], [], []
            for d, i, j in zip(docs.tolist(), start.tolist(), stop.tolist()):
                low = int(ends[d]) - len(lists[d])
                lo, hi = max(low, int(at[i]) - margin), min(int(ends[d]), int(at[j - 1]) + SEED_WORDS + margin)
                first.append(lo - low)
                parts.append(words[lo:hi])
                places.append(at[i:j] - low)
                hashes.append(h[at[i:j]])
            take = pa.array(docs)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(first, pa.int32()), _lists(parts), _lists(places), _lists(hashes)], names=["doc_id", "version", "first", "words", "places", "hashes"])

    return run


def _tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _LEAK.split(", ")]
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("tiles", pa.int32()), ("longest", pa.int32()), ("covered", pa.int32()), ("item_words", pa.int32()), ("contained", pa.bool_())])
    for batch in batches:
        rows = []
        texts, items = batch.column(2), batch.column(3)
        for k, (doc, item_id) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            text, item = (np.asarray(c[k].values.to_numpy(zero_copy_only=False), np.int64) for c in (texts, items))
            tiles, shadowed = tile(text, item)
            if tiles:
                contained = contains_passage(text.tolist(), item.tolist(), tiles + shadowed)
                rows.append((doc, item_id, len(tiles), max(n for n, _, _ in tiles), sum(n for n, _, _ in tiles), len(item), contained))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)


def leaked_items(documents: DataFrame, items: DataFrame, passages_only: bool = False) -> DataFrame:
    """``(doc_id, item_id, tiles, longest, covered, item_words, contained)`` of each document and item that share a seed.

    The seeds of the items (windows of five words) are a table. Every document is read whole once, without a
    shuffle: a Bloom filter of the seeds picks the windows worth joining, and those join the seeds. For each document and
    item that meet, greedy string tiling runs over the words of the document that can lie in the item's reach;
    its tiles give ``covered``, and the gaps around them tell whether a passage of the item is ``contained``.

    ``passages_only`` leaves out what cannot hold a passage before the join: a passage of twelve words or more with an eighth
    of them edited shares at least two seeds with the item, and two of them begin within 14 words.
    Null or empty texts and items shorter than a seed share nothing; repeated rows of a document or an item give one row, and of different texts
    under one id the best match counts.
    """
    known = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", F.xxhash64("text").alias("variant"), "text").distinct()
    item_rows = cut(known.mapInArrow(_item_rows, _ITEM))
    longest, total = item_rows.agg(F.coalesce(F.max(F.size("words")), F.lit(0)), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    few = total <= BROADCAST_WORDS  # then seeds and words of the items are small enough for every task
    hint = F.broadcast if few else (lambda df: df)
    seeds = item_rows.mapInArrow(_item_seeds, _SEED)
    scan = _suspects(seed_filter(seeds, total), longest + longest // WORDS_PER_EDIT + 1, NEAR_SEEDS if passages_only else None)
    texts = spread(documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("version"), "text"), "doc_id")
    suspects = cut(texts.mapInArrow(scan, _SUSPECT))  # read twice: for the join of seeds and for the words
    hits = suspects.select("doc_id", "version", F.explode(F.arrays_zip("places", "hashes")).alias("h")).select("doc_id", "version", F.col("h.places").cast("int").alias("place"), F.col("h.hashes").alias("hash"))
    diagonal = F.col("place") - F.col("item_place")
    met = hits.join(hint(seeds), "hash").groupBy("doc_id", "version", "item_id", "variant").agg(F.count("*").alias("n"), F.min(diagonal).alias("low"), F.max(diagonal).alias("high"), F.first("item_words").alias("size"))
    slack = F.floor(F.col("size") / WORDS_PER_EDIT).cast("int") + 1
    words = suspects.dropDuplicates(["doc_id", "version"]).select("doc_id", "version", "first", "words")
    begin = F.greatest(F.col("low") - slack - F.col("first"), F.lit(0))
    end = F.greatest(F.col("high") + F.col("size") + slack - F.col("first"), begin)
    pairs = met.where(F.col("n") >= (2 if passages_only else 1)).join(words, ["doc_id", "version"]).select("doc_id", "item_id", "variant", F.slice("words", begin + 1, end - begin).alias("near"))
    found = pairs.join(hint(item_rows), ["item_id", "variant"]).select("doc_id", "item_id", "near", "words").mapInArrow(_tile_pairs, _LEAK)
    keys = ("tiles", "longest", "covered", "item_words", "contained")
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("contained", "covered", "longest", "tiles", "item_words")).alias("m")).select("doc_id", "item_id", *[F.col(f"m.{k}").alias(k) for k in keys])
