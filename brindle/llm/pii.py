"""Personal information in free text: finding it and writing placeholders of its type."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.pii_model import ADDRESS_FORMS, DIGITS, EMAILS, FIGURES, FIRST, LAST, LEAST_DIGITS, NAMES, PLACES, SPELLED, STREETS, TITLES, Scorer, decode, spelled_length, train
from brindle.llm.pii_samples import labelled_sample
from brindle.llm.speech import name_words
from brindle.sources.tables import cut, spread

SAMPLE_ROWS = 6000
FILTER_BITS_EACH, FILTER_BITS_LEAST = 64, 1 << 22
MEMO_ROWS = 200_000
PLACEHOLDERS = {"name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]"}


@lru_cache(maxsize=2)
def model(rows: int = SAMPLE_ROWS) -> dict[str, float]:
    """Weights fitted to the labelled sample of ``rows`` lines; once per process."""
    sample, sampler = labelled_sample(rows)
    return train(sample, sampler.kind_of)


def _places(word: str, bits: int) -> tuple[int, int, int]:
    """Three places of a word in a filter of ``bits`` (a power of two)."""
    h = hashlib.blake2b(word.encode(), digest_size=15).digest()
    return tuple(int.from_bytes(h[k : k + 5], "little") & (bits - 1) for k in (0, 5, 10))


class Lexicon:
    """Which words are known from people's names, as first or last name, in two Bloom filters of ``bits`` each."""

    def __init__(self, first: np.ndarray, last: np.ndarray, bits: int) -> None:
        self.filters, self.bits = [], bits
        for at in (first, last):
            known = np.zeros(bits, bool)
            known[at] = True
            self.filters.append(np.packbits(known))
        self.memo: dict[str, int] = {}

    def kind_of(self, word: str) -> int:
        kind = self.memo.get(word)
        if kind is None:
            places = _places(word, self.bits)
            kind = sum(flag for flag, bits in zip((FIRST, LAST), self.filters) if all(bits[p >> 3] >> (7 - (p & 7)) & 1 for p in places))
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[word] = kind
        return kind

    def __getstate__(self) -> dict:
        return {"filters": self.filters, "bits": self.bits, "memo": {}}


def name_lexicon(transcript: DataFrame, recording: DataFrame) -> Lexicon:
    """The words of all people's names in the structured columns.

    The distinct words are counted first, and the filters get at least ``FILTER_BITS_EACH`` bits a word, so that however many names
    there are, about one other word in 10,000 is taken for a name. The driver gets the filters' distinct places.
    """
    listed = recording.select(F.explode("attributes.participants").alias("p")).select(
        F.explode(F.array(F.struct(F.lit(False).alias("is_first"), F.col("p.displayName").alias("name")), F.struct(F.lit(True).alias("is_first"), F.col("p.firstName").alias("name")))).alias("n")
    ).select("n.*")
    heard = transcript.select(F.lit(False).alias("is_first"), F.col("speaker.displayName").alias("name"))
    names = listed.unionByName(heard).where("name IS NOT NULL").distinct()

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[tuple[int, str]] = set()
            for is_first, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = name_words(name)
                if is_first:
                    words = words[:1] + [""]
                elif len(words) < 2:
                    continue  # one word alone may be either
                elif len(words[0]) > 1 and name.split()[0].isupper() and not name.isupper():
                    words = words[::-1]
                out.update((FIRST if k == 0 else LAST, w) for k, w in enumerate(words) if len(w) > 1)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([w for _, w in out], pa.string())], names=["kind", "word"])

    words = cut(names.mapInArrow(words_of, "kind int, word string").distinct())
    bits = max(FILTER_BITS_LEAST, 1 << (words.count() * FILTER_BITS_EACH - 1).bit_length())

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [_places(w, bits) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(at)), 3))), pa.array([p for t in at for p in t], pa.int64())], names=["kind", "place"])

    found = words.mapInArrow(places, "kind int, place long").distinct().toArrow()
    kind, place = found.column("kind").to_numpy(), found.column("place").to_numpy()
    return Lexicon(place[kind == FIRST], place[kind == LAST], bits)


_LETTERS = re.compile(r"[^\W\d_]{2,}")
_HEADER = re.compile(r"\[([^\n@]{1,90}?), ([A-Z]+) @ [\d:]+\] ?")
_END = re.compile(r"[.?!] +(?=[A-Z])")
_NO_END = re.compile(r"(?:\b[A-Z]|\bDr|\bMr|\bMs|\bMrs|\bProf|\bTel|\W)$")
_RUN = re.compile(r"\d[\d ./()-]{4,}")
_INITIAL = re.compile(r"[A-Z]\. [A-Z][^\W\d_]")
_DIGIT_WORDS, _TITLE_WORDS = frozenset(DIGITS.split()), TITLES
_STREET_WORDS = frozenset([*STREETS.split(), "rue", "chemin", "via", "viale", "calle", "rua", "piazza", "plaza", "platz", "weg", "allee"])
_STREET_ENDS = ("gasse", "straße", "strasse", "weg", "platz", "allee")
# Fixed value: first names that are ordinary words when written small.
ORDINARY = frozenset("will mark hope rose grace may june april august bill frank jack art dawn faith joy rich pat sue chase grant drew miles".split())
NAME_WORD, DIGIT_WORD, STREET_WORD = 1, 2, 4


class Finder:
    """Finds the segments of a text; equal sentences and speaker headers are decoded once per worker."""

    def __init__(self, lexicon: Lexicon, weights: dict[str, float]) -> None:
        self.lexicon, self.scorer = lexicon, Scorer(weights)
        self.memo: dict[str, tuple] = {}
        self.cues: dict[str, int] = {}

    def _cue(self, word: str) -> int:
        """What a word, as it is written, can be a sign of."""
        low = word.lower()
        kind = self.lexicon.kind_of(low)
        cue = NAME_WORD if kind and (low != word or low not in ORDINARY) or low in _TITLE_WORDS else 0
        cue |= DIGIT_WORD if low in _DIGIT_WORDS else 0
        cue |= STREET_WORD if low in _STREET_WORDS or low.endswith(_STREET_ENDS) else 0
        if len(self.cues) > 500_000:
            self.cues.clear()
        self.cues[word] = cue
        return cue

    def _reasons(self, text: str) -> int:
        """Which types of segment a text can hold at all."""
        words = _LETTERS.findall(text)
        known = self.cues.get
        seen = set(map(known, words))
        if None in seen:
            seen = {self._cue(w) if (k := known(w)) is None else k for w in set(words)}
        cue = 0
        for k in seen:
            cue |= k
        out = NAMES if cue & NAME_WORD or _INITIAL.search(text) else 0
        if "@" in text or " dot " in text or "[at]" in text or "(at)" in text:
            out |= EMAILS
        if _RUN.search(text) or cue & DIGIT_WORD and sum([known(w, 0) & DIGIT_WORD for w in words]) > DIGIT_WORD and any(spelled_length(m[0]) >= LEAST_DIGITS for m in SPELLED.finditer(text)):
            out |= FIGURES
        if cue & STREET_WORD and any(p.search(text) for p in ADDRESS_FORMS):
            out |= PLACES
        return out

    def _decode(self, text: str, reasons: int | None = None) -> tuple:
        found = self.memo.get(text)
        if found is None:
            reasons = self._reasons(text) if reasons is None else reasons
            found = tuple(decode(text, self.lexicon.kind_of, self.scorer, reasons)) if reasons else ()
            if len(self.memo) >= MEMO_ROWS:
                self.memo.clear()
            self.memo[text] = found
        return found

    def segments(self, text: str) -> list[tuple[int, int, str]]:
        """``(start, end, type)`` of a whole text, line by line and sentence by sentence."""
        out: list[tuple[int, int, str]] = []
        base = 0
        for line in text.split("\n"):
            start = 0
            if line.startswith("[") and (m := _HEADER.match(line)):
                start = m.end()
                out += [(base + a, base + b, k) for a, b, k in self._decode("[" + m[1] + ", USER @ 00:00]", NAMES)]
            body = line[start:] if start else line
            if len(body) > 1 and (reasons := self._reasons(body)):
                a = 0
                cuts = [m for m in _END.finditer(body) if not _NO_END.search(body, max(0, m.start() - 5), m.start())]
                for m in [*cuts, None]:
                    part = body[a : m.start() + 1] if m else body[a:]
                    for x, y, k in self._decode(part, None if cuts else reasons):
                        out.append((base + start + a + x, base + start + a + y, k))
                    a = m.end() if m else a
            base += len(line) + 1
        return out


def _scan(lexicon: Lexicon, weights: dict[str, float], redact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(lexicon, weights)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            rows: list[int] = []
            kinds: list[str] = []
            mentions: list[str] = []
            for i, text in enumerate(texts):
                if not text:
                    if redact:
                        rows.append(i)
                        mentions.append(text)
                    continue
                found = finder.segments(text)
                if redact:
                    parts, last = [], 0
                    for a, b, k in found:
                        parts += [text[last:a], PLACEHOLDERS[k]]
                        last = b
                    rows.append(i)
                    mentions.append("".join([*parts, text[last:]]))
                else:
                    for kind, mention in {(k, text[a:b]) for a, b, k in found}:
                        rows.append(i)
                        kinds.append(kind)
                        mentions.append(mention)
            taken = keys.take(pa.array(rows, pa.int64()))
            if redact:
                yield pa.RecordBatch.from_arrays([taken, pa.array(mentions, pa.string())], names=["row_key", "text"])
            else:
                yield pa.RecordBatch.from_arrays([taken, pa.array(kinds, pa.string()), pa.array(mentions, pa.string())], names=["row_key", "pii_type", "mention"])

    return run


def find_personal(df: DataFrame, key: str, text: str, lexicon: Lexicon, weights: dict[str, float] | None = None) -> DataFrame:
    """``(row_key, pii_type, mention)``: one row per distinct item of a row's whole text.

    Null and empty texts and rows without a key give nothing; nothing is shuffled but the distinct items.
    """
    rows = df.select(F.col(key).cast("string").alias("row_key"), F.col(text).alias("text")).where("row_key IS NOT NULL AND text IS NOT NULL")
    return spread(rows, "row_key").mapInArrow(_scan(lexicon, weights or model(), False), "row_key string, pii_type string, mention string")


def redact_personal(df: DataFrame, key: str, text: str, lexicon: Lexicon, weights: dict[str, float] | None = None) -> DataFrame:
    """``(row_key, text)``: every row with each item replaced by the placeholder of its type; null stays null, empty stays empty."""
    rows = df.select(F.col(key).cast("string").alias("row_key"), F.col(text).alias("text"))
    return spread(rows, "row_key").mapInArrow(_scan(lexicon, weights or model(), True), "row_key string, text string")
