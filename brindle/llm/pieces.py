"""Oversized texts into pieces under a token limit, cut at natural boundaries, with overlap."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.tokens import SPLIT, VOCABULARY, count, encoding, share
from brindle.sources.tables import cut, spread

LIMIT = 512
OVERLAP = 64
RANGE_CHARS = 16_384
HALO_CHARS = 1_024
SEGMENT_TOKENS = 262_144
GIANT_RANGES = 64
LONG_WORD_TOKENS = 16
SPARE = 32
FEW_KEYS = 1_000_000

PARAGRAPH, LINE, SENTENCE, WORD, INSIDE = 4, 3, 2, 1, 0
_SPLIT = regex.compile(SPLIT)
_SYNC = regex.compile(r"(?<=\S)\s")
_SENTENCE_END = tuple(".!?…。！？．")
_WIDE_END = tuple("。！？．")
_CLOSERS = "\"'”’)]»*_`」』"


def sync_point(text: str, at: int, halo: int = HALO_CHARS) -> int:
    """The first place from ``at`` on where a word surely ends, whatever stands before; ``at`` itself if the halo has none."""
    if at <= 0:
        return 0
    m = _SYNC.search(text, at, min(len(text), at + halo))
    return m.start() if m else min(at, len(text))


_SPACE, _SPACED, _END, _WIDE, _CLOSER = 1, 2, 4, 8, 16


def _code(word: str, vocabulary: str) -> int:
    """Tokens, length, line breaks and signs of one word of the tokenizer, packed in one number."""
    signs = _SPACE if word.isspace() else 0
    signs |= _SPACED if word[0].isspace() else 0
    signs |= _END if word.endswith(_SENTENCE_END) else 0
    signs |= _WIDE if word.endswith(_WIDE_END) else 0
    signs |= _CLOSER if word.strip(_CLOSERS) == "" else 0
    return count(word, vocabulary) | len(word) << 20 | min(2, word.count("\n")) << 40 | signs << 42


def _finer(words: list[str], offset: int, level: int, vocabulary: str) -> list[tuple[int, int, int]]:
    """A unit of many tokens parted at words of the tokenizer, and a long word at its tokens."""
    out: list[list[int]] = []
    for word in words:
        parts = [(len(word), count(word, vocabulary))]
        if parts[0][1] > LONG_WORD_TOKENS:
            parts, held, size = [], b"", 0
            for token in encoding(vocabulary).decode_tokens_bytes(encoding(vocabulary).encode_ordinary(word)):
                held, size = held + token, size + 1
                try:
                    chars = len(held.decode())
                except UnicodeDecodeError:
                    continue
                parts.append((chars, size))
                held, size = b"", 0
        for chars, n in parts:
            if out and out[-1][2] + n <= LONG_WORD_TOKENS // 2:
                out[-1][2] += n
            else:
                out.append([offset, INSIDE if out else level, n])
            offset += chars
    return [tuple(x) for x in out]


def boundaries(text: str, start: int, end: int, codes: dict[str, int], vocabulary: str = VOCABULARY, hard: bool = False, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where ``text[start:end]`` may be cut: ``(offset, level, tokens up to the next place)``.

    Levels: paragraph, line, sentence, word, inside a long word. Tokens add up over the places,
    because a place never splits what the tokenizer reads as one word, but for words of more
    than ``LONG_WORD_TOKENS`` tokens. Words that hang together without a blank are parted every so many tokens.
    ``hard`` says that ``start`` itself is inside a word; a stretch of at most ``least`` tokens has no places.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int32)
    words = _SPLIT.findall(text, start, end)
    found = list(map(codes.get, words))
    if None in found:
        fresh = {w: _code(w, vocabulary) for w, c in zip(words, found) if c is None}
        found = [fresh[w] if c is None else c for w, c in zip(words, found)]
        codes.update((w, c) for w, c in fresh.items() if len(w) < 40)
    code = np.array(found, np.int64)
    tokens, length, breaks, signs = code & 0xFFFFF, code >> 20 & 0xFFFFF, code >> 40 & 3, code >> 42
    if not words or tokens.sum() <= least:
        return none
    offsets = start + np.concatenate([[0], np.cumsum(length)[:-1]])
    seen = np.flatnonzero(signs & _SPACE == 0)
    if not len(seen):
        places, levels, sums = zip(*_finer(words, start, INSIDE if hard else WORD, vocabulary))
        return np.array(places, np.int64), np.array(levels, np.int8), np.array(sums, np.int32)
    lines = np.cumsum(breaks)
    between = lines[seen] - np.concatenate([[0], lines[seen[:-1]]])
    spaced = (np.diff(seen, prepend=-1) > 1) | (signs[seen] & _SPACED > 0)
    ends, wide, closer = (signs[seen] & k > 0 for k in (_END, _WIDE, _CLOSER))
    for _ in range(3):  # closing quotes, brackets and marks hand on the end of a sentence
        hand = closer[1:] & ~spaced[1:]
        ends[1:] |= hand & ends[:-1]
        wide[1:] |= hand & wide[:-1]
    level = np.where(spaced, WORD, -1)
    after_end = np.concatenate([[False], ends[:-1] & spaced[1:] | wide[:-1] & ~closer[1:]])
    level[after_end] = SENTENCE
    level[between == 1] = LINE
    level[between >= 2] = PARAGRAPH
    level[0] = INSIDE if hard else max(level[0], WORD)
    kept = level >= 0
    first = seen[kept]
    first[0] = 0
    sums, levels, places = np.add.reduceat(tokens, first), level[kept], offsets[first]
    long = np.flatnonzero(sums > LONG_WORD_TOKENS)
    if len(long):
        borders = np.append(first, len(words))
        rows: list[tuple[int, int, int]] = []
        at = 0
        for k in long:
            rows += zip(places[at:k].tolist(), levels[at:k].tolist(), sums[at:k].tolist())
            rows += _finer(words[borders[k] : borders[k + 1]], int(places[k]), int(levels[k]), vocabulary)
            at = k + 1
        rows += zip(places[at:].tolist(), levels[at:].tolist(), sums[at:].tolist())
        places, levels, sums = (np.array(x) for x in zip(*rows))
    return places.astype(np.int64), levels.astype(np.int8), sums.astype(np.int32)


def next_cut(tokens: np.ndarray, levels: np.ndarray, start: int, limit: int, overlap: int) -> int:
    """Where the piece that begins at place ``start`` ends: the strongest boundary in its second half, the latest of equal strength.

    ``tokens`` counts those before each place, and in all as its last entry; the end of the text is a
    paragraph. A word cut inside may take other tokens than it had, so a piece that begins or
    ends inside a word keeps a ``SPARE``-th part of the limit back.
    """
    n = len(tokens) - 1
    for spare in (0, limit // SPARE):
        if not spare and levels[start] == INSIDE:
            continue
        last = min(max(int(np.searchsorted(tokens, tokens[start] + limit - spare, side="right")) - 1, start + 1), n)
        if last == n:
            return n
        least = int(np.searchsorted(tokens, tokens[start] + max(limit // 2, overlap + 1)))
        window = levels[min(max(least, start + 1), last) : last + 1]
        cut_at = last - int(window[::-1].argmax())
        if spare or levels[cut_at] != INSIDE:
            break
    return cut_at


def next_start(tokens: np.ndarray, start: int, cut_at: int, overlap: int) -> int:
    """The last place that repeats at least ``overlap`` tokens before a cut and still advances."""
    back = int(np.searchsorted(tokens, tokens[cut_at] - overlap, side="right")) - 1
    return min(max(back, start + 1), cut_at)


def plan_pieces(places: np.ndarray, levels: np.ndarray, tokens: np.ndarray, start: int, stop: int, limit: int, overlap: int) -> tuple[list[tuple[int, int, int]], int | None]:
    """Pieces ``(start, end, level of the cut)`` that begin from place ``start`` on and before place ``stop``, and the start that follows them.

    All three tables end with the end of the text (or of what is known of it). The start of a piece says all about the rest of the
    plan, so a stretch can go on from where the one before stopped.
    """
    n = len(places) - 1
    out: list[tuple[int, int, int]] = []
    while start < stop:
        cut_at = next_cut(tokens, levels, start, limit, overlap)
        out.append((int(places[start]), int(places[cut_at]), int(levels[cut_at])))
        if cut_at >= n:
            return out, None
        start = next_start(tokens, start, cut_at, overlap)
    return out, start


def _exits(levels: np.ndarray, tokens: np.ndarray, entries: range, stop: int, limit: int, overlap: int) -> list[int | None]:
    """For each possible first start of a stretch, the first start behind ``stop`` (none: the text ends before); chains that meet are walked once."""
    known: dict[int, int | None] = {}
    out: list[int | None] = []
    for entry in entries:
        chain, at = [], entry
        while at is not None and at < stop and at not in known:
            chain.append(at)
            cut_at = next_cut(tokens, levels, at, limit, overlap)
            at = None if cut_at >= len(tokens) - 1 else next_start(tokens, at, cut_at, overlap)
        end = known[at] if at in known else at
        known.update((c, end) for c in chain)
        out.append(end)
    return out


_RANGE = "doc_id bigint, range_no int, last boolean, chunk string"
_TABLE = "doc_id bigint, range_no int, last boolean, start_char bigint, end_char bigint, tokens bigint, places binary"
_PIECE = "doc_id bigint, piece_no int, start_char bigint, end_char bigint, tokens int, cut_level int, text string"
_PLACE = np.dtype([("step", np.uint32), ("tokens", np.uint16), ("level", np.int8)])


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def text_ranges(documents: DataFrame, range_chars: int, halo_chars: int) -> DataFrame:
    """``(doc_id, range_no, last, chunk)``: each text in ranges of ``range_chars`` characters, in order, with one character before and a halo behind.

    One pass of Spark over the text; the ranges of a row follow each other in its partition.
    """
    parts = documents.select("doc_id", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{range_chars}}}"), F.lit(0)).alias("parts"))
    before = lambda i: F.coalesce(F.substring(F.try_element_at("parts", F.when(i > 0, i)), -1, 1), F.lit(""))
    behind = lambda i: F.coalesce(F.substring(F.try_element_at("parts", i + 2), 1, halo_chars), F.lit(""))
    chunks = F.transform("parts", lambda p, i: F.concat(before(i), p, behind(i)))
    rows = parts.select("doc_id", F.size("parts").alias("n"), F.posexplode(chunks).alias("range_no", "chunk"))
    return rows.select("doc_id", "range_no", (F.col("range_no") == F.col("n") - 1).alias("last"), "chunk")


def one_row_each(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, text)`` with one row per key, the largest text of a key that repeats; null keys are left out.

    Only keys are shuffled to find those that repeat; where they are few (at most ``FEW_KEYS``, counted) they are
    broadcast, so that the texts of the other rows stay where they are.
    """
    rows = documents.where(F.col(key).isNotNull()).select(key, text)
    repeated = cut(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key))
    n = repeated.count()
    if not n:
        return rows
    repeated = F.broadcast(repeated) if n <= FEW_KEYS else repeated
    return rows.join(repeated, key, "left_anti").unionByName(rows.join(repeated, key, "left_semi").groupBy(key).agg(F.max(text).alias(text)))


def split_oversized(
    documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = VOCABULARY, range_chars: int = RANGE_CHARS, halo_chars: int = HALO_CHARS, segment_tokens: int = SEGMENT_TOKENS, giant_ranges: int = GIANT_RANGES
) -> DataFrame:
    """``(doc_id, piece_no, start_char, end_char, tokens, cut_level, text)`` of the documents of more than ``limit`` tokens.

    Spark cuts the texts into ranges of characters with a halo. Each range finds its own boundaries and token counts, the
    boundary tables of a text are stitched through prefix sums, the pieces are planned on the tables alone and emitted by offset.

    A text of up to ``giant_ranges`` ranges has all of its ranges in one partition, so this happens in one
    task without a shuffle. The ranges of a larger one are dealt over the tasks, and so is its plan: each segment of
    about ``segment_tokens`` tokens tells for every place where a piece may enter it at which place the plan leaves it, those few
    numbers are followed from the start of the text, and each segment then plans from its true entry. The pieces
    are the same either way, and no task needs a whole giant text.

    Every character is in a piece, no piece has more than ``limit`` tokens, and consecutive pieces share
    ``overlap`` tokens, or as many more as the next word start before asks for. ``cut_level`` says what the piece ends at: 4 paragraph (or the text),
    3 line, 2 sentence, 1 word, 0 inside a word. Null and empty texts and those within the limit give no row; of
    rows that repeat a ``doc_id`` the one with the largest text counts.
    """
    if not (0 <= 2 * overlap < limit and limit >= SPARE):
        raise ValueError("the overlap must be less than half the limit, and the limit no less than SPARE")
    share(documents.sparkSession, vocabulary)
    # a text has at most as many tokens as bytes
    large = one_row_each(spread(documents.select("doc_id", "text"), "doc_id"), "doc_id", "text").where(F.octet_length("text") > limit)
    small = large.where(F.char_length("text") <= giant_ranges * range_chars)
    giant = large.where(F.char_length("text") > giant_ranges * range_chars)

    def table_row(codes: dict[str, int], k: int, last: bool, chunk: str, least: int = 0) -> tuple[int, int, np.ndarray]:
        """First and last character of a range's own words, and its table."""
        lead = 1 if k else 0
        a = sync_point(chunk, lead, halo_chars) if k else 0
        b = len(chunk) if last else sync_point(chunk, lead + range_chars, halo_chars)
        hard = k > 0 and a == lead and not chunk[a : a + 1].isspace()
        at, level, size = boundaries(chunk, a, b, codes, vocabulary, hard, least)
        if len(codes) > 200_000:
            codes.clear()
        rows = np.empty(len(at), _PLACE)
        rows["step"], rows["tokens"], rows["level"] = np.diff(at, prepend=a), size, level
        base = k * range_chars - lead
        return a + base, b + base, rows

    def stitched(tables: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, levels and tokens before each place of consecutive ranges, with their end."""
        places = [start + np.cumsum(rows["step"], dtype=np.int64) for start, _, rows in tables]
        tokens = np.concatenate([rows["tokens"] for _, _, rows in tables])
        return np.append(np.concatenate(places), tables[-1][1]), np.append(np.concatenate([r["level"] for _, _, r in tables]), PARAGRAPH).astype(np.int8), np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])

    def exact(start: int, text: str, level: int) -> Iterator[tuple[int, int, int, int, str]]:
        """A piece with its tokens counted on its text; should words cut inside make it too long, it is halved."""
        n = count(text, vocabulary)
        if n <= limit or len(text) < 2:
            yield start, start + len(text), n, level, text
        else:
            half = len(text) // 2
            yield from exact(start, text[:half], INSIDE)
            yield from exact(start + half, text[half:], level)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pieces of texts whose ranges follow each other in the partition."""
        codes: dict[str, int] = {}
        tables: list[tuple[int, int, np.ndarray]] = []
        chunks: list[str] = []
        for batch in batches:
            out: list[tuple] = []
            for doc, k, last, chunk in zip(*[batch[c] for c in _names(_RANGE)]):
                if k == 0 and last and len(chunk) < 6 * limit and count(chunk, vocabulary) <= limit:
                    continue
                tables.append(table_row(codes, k, last, chunk, limit if k == 0 and last else 0))
                chunks.append(chunk[: range_chars + 1] if k else chunk[:range_chars])
                if not last:
                    continue
                if sum(int(t[2]["tokens"].sum()) for t in tables) > limit:
                    text = chunks[0] + "".join([c[1:] for c in chunks[1:]])
                    places, levels, tokens = stitched(tables)
                    plan, _ = plan_pieces(places, levels, tokens, 0, len(places) - 1, limit, overlap)
                    out += [(doc, no, *piece) for no, piece in enumerate((p for a, b, level in plan for p in exact(a, text[a:b], level)), 1)]
                tables, chunks = [], []
            yield pd.DataFrame(out, columns=_names(_PIECE))

    pieces = text_ranges(small, range_chars, halo_chars).mapInPandas(whole, _PIECE)
    if not giant.limit(1).count():
        return pieces
    return pieces.unionByName(_giant_pieces(giant, table_row, stitched, exact, limit, overlap, range_chars, halo_chars, segment_tokens))


def _giant_pieces(giant: DataFrame, table_row: Callable, stitched: Callable, exact: Callable, limit: int, overlap: int, range_chars: int, halo_chars: int, segment_tokens: int) -> DataFrame:
    """Pieces of texts of many ranges; see ``split_oversized``."""
    dealt = text_ranges(giant, range_chars, halo_chars).repartition("doc_id", "range_no")

    def range_tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes: dict[str, int] = {}
        for batch in batches:
            out = []
            for doc, k, last, chunk in zip(*[batch[c] for c in _names(_RANGE)]):
                a, b, rows = table_row(codes, k, last, chunk)
                out.append((doc, k, last, a, b, int(rows["tokens"].sum()), rows.tobytes()))
            yield pd.DataFrame(out, columns=_names(_TABLE))

    tables = cut(dealt.mapInPandas(range_tables, _TABLE))  # a few bytes a word, no text
    upto = Window.partitionBy("doc_id").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    # a segment has more tokens than a range and a piece together, so that a plan never looks beyond the next one
    segment = max(segment_tokens, 4 * (range_chars + halo_chars) + limit + 1)
    before = tables.select("doc_id", "range_no", F.coalesce(F.sum("tokens").over(upto), F.lit(0)).alias("before"))
    sums = before.withColumn("own", F.floor(F.col("before") / segment).cast("int"))
    # the ranges that a plan may look into behind its segment: those that begin within the limit of its last start
    near = F.col("before") <= F.min("before").over(Window.partitionBy("doc_id", "own")) + limit
    segments = F.when(F.col("near") & (F.col("own") > 0), F.array("own", F.col("own") - 1)).otherwise(F.array("own"))
    placed = tables.join(sums.withColumn("near", near).select("doc_id", "range_no", "own", F.explode(segments).alias("segment")), ["doc_id", "range_no"])

    def by_segment(work: Callable, schema: str, columns: tuple[str, ...]) -> Callable:
        """Runs ``work`` over the ranges of each segment; the partition is sorted by document, segment and range."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, held = None, []
            for batch in batches:
                out: list[tuple] = []
                for doc, segment, *row in zip(*[batch[c] for c in ("doc_id", "segment", "own", "last", "start_char", "end_char", "places", *columns)]):
                    if key != (doc, segment):
                        out += work(*key, held) if held else []
                        key, held = (doc, segment), []
                    held.append(row)
                yield pd.DataFrame(out, columns=_names(schema))
            yield pd.DataFrame(work(*key, held) if held else [], columns=_names(schema))

        return run

    def segment_table(segment: int, held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        places, levels, tokens = stitched([(a, b, np.frombuffer(rows, _PLACE)) for _, _, a, b, rows, *_ in held])
        return places, levels, tokens, sum(len(r[4]) // _PLACE.itemsize for r in held if r[0] == segment)

    def flow(doc: int, segment: int, held: list) -> list[tuple]:
        places, levels, tokens, stop = segment_table(segment, held)
        entries = range(min(stop, int(np.searchsorted(tokens, limit, side="right")) if segment else 1))
        exits = _exits(levels, tokens, entries, stop, limit, overlap)
        return [(doc, segment, [int(places[e]) for e in entries], [None if x is None else int(places[x]) for x in exits])]

    def follow(flows: pd.DataFrame) -> pd.DataFrame:
        """The entry of each segment, from the start of the text on."""
        out, at = [], 0
        for doc, segment, entries, exits in zip(*[flows.sort_values("segment")[c] for c in ("doc_id", "segment", "entries", "exits")]):
            known = dict(zip(entries, exits))
            out.append((doc, segment, int(at)))
            at = known[at]
            if at is None or at != at:  # the text ends with a piece that began here
                break
        return pd.DataFrame(out, columns=["doc_id", "segment", "entry"])

    def plan(doc: int, segment: int, held: list) -> list[tuple]:
        places, levels, tokens, stop = segment_table(segment, held)
        found, _ = plan_pieces(places, levels, tokens, int(np.searchsorted(places, held[0][5])), stop, limit, overlap)
        return [(doc, *p) for p in found]

    flows_schema, plan_schema = "doc_id bigint, segment int, entries array<bigint>, exits array<bigint>", "doc_id bigint, start_char bigint, end_char bigint, cut_level int"
    arranged = lambda df: df.repartition("doc_id", "segment").sortWithinPartitions("doc_id", "segment", "range_no")
    flows = arranged(placed).mapInPandas(by_segment(flow, flows_schema, ()), flows_schema)
    entries = flows.groupBy("doc_id").applyInPandas(follow, "doc_id bigint, segment int, entry bigint")  # a few hundred numbers a segment
    plans = cut(arranged(placed.join(entries, ["doc_id", "segment"])).mapInPandas(by_segment(plan, plan_schema, ("entry",)), plan_schema))
    numbered = plans.withColumn("piece_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("start_char")))
    touched = F.sequence(F.floor(F.col("start_char") / range_chars).cast("int"), F.floor((F.col("end_char") - 1) / range_chars).cast("int"))
    wanted = numbered.withColumn("range_no", F.explode(touched))
    lead = F.when(F.col("range_no") > 0, 1).otherwise(0)
    part_from = F.greatest(F.col("start_char"), F.col("range_no").cast("bigint") * range_chars)
    part_to = F.least(F.col("end_char"), (F.col("range_no").cast("bigint") + 1) * range_chars)
    keys = ("doc_id", "piece_no", "start_char", "cut_level")
    parts = wanted.join(dealt, ["doc_id", "range_no"]).select(
        *keys, "range_no", F.substring("chunk", (part_from - F.col("range_no").cast("bigint") * range_chars + lead + 1).cast("int"), (part_to - part_from).cast("int")).alias("part")
    )
    joined = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("range_no", "part"))).alias("p"))  # the few ranges of one piece
    texts = joined.select(*keys, F.array_join(F.transform("p", lambda x: x["part"]), "").alias("text"))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(*[batch[c] for c in ("doc_id", "piece_no", "start_char", "text", "cut_level")])
            yield pd.DataFrame([(doc, no, *p) for doc, no, start, text, level in rows for p in exact(start, text, level)], columns=_names(_PIECE))

    found = texts.mapInPandas(emit, _PIECE)
    return found.withColumn("piece_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("start_char")))
