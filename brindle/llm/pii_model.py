"""Semi-Markov conditional random field over candidate segments of personal information."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np

NAME, EMAIL, PHONE, ID, ADDRESS = "name", "email", "phone", "id_number", "address"
TYPES = (NAME, EMAIL, PHONE, ID, ADDRESS)
FIRST, LAST = 1, 2
LEAST_DIGITS = 6
NAME_WORDS = 8

# Words for digits and numbers, kinds of streets and units, as people write them.
DIGITS = "zero oh nought one two three four five six seven eight nine double triple"
NUMBERS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred"
STREETS = "street st road rd lane ln avenue ave boulevard blvd close way drive dr court ct place pl square sq terrace crescent row walk quay"
UNITS = "flat apt apartment unit suite room floor"
FILLERS = frozenset("um uh er erm hmm ah uhh ummm like you know sort of i mean".split())
TITLES = frozenset("mr mrs ms miss dr prof professor herr frau madame mme sr sra sir".split())

_W = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_ATOM = r"[\w+%-]+"
_DOT = r"(?:\.|\s?[\[(]dot[\])]\s?)"
_EMAIL = re.compile(rf"{_ATOM}(?:{_DOT}{_ATOM})*\s?(?:@|[\[(]at[\])])\s?[\w-]+(?:{_DOT}[\w-]+)+")
_SPOKEN_EMAIL = re.compile(r"\w+(?: (?:dot|underscore|dash|hyphen|plus) \w+)* at \w+(?: (?:dash|hyphen) \w+)*(?: dot \w+)+")
_NUMERIC = re.compile(r"(?<![\w@.,:/-])(?:[A-Z]{1,3}-?(?=\d)|\+(?=\d))?\(?\d+\)?(?:(?:[./-]| (?=[\d(]))\(?\d+\)?)*(?:-?[A-Z]\b| [A-Z]\b)?(?![\w-])")
SPELLED = re.compile(rf"\b(?:{'|'.join(DIGITS.split())})(?:,?[ -](?:{'|'.join(DIGITS.split())}))+\b", re.I)
_COUNT = rf"(?:(?:{'|'.join(NUMBERS.split())})(?:[ -](?:{'|'.join(NUMBERS.split())})){{0,3}})"
_UNIT = rf"(?:(?:{'|'.join(UNITS.split())})\.?\s\d*[a-z]?\d*)"
_KIND = rf"(?:(?:{'|'.join(sorted(STREETS.split(), key=len, reverse=True))})\b\.?)"
_TOWN = rf"(?:{_W})"
_TAIL = rf"(?:(?:,\s|\s(?=\d)|\sin\s)(?:\d{{4,6}}\s{_TOWN}|{_TOWN}\s\d{{4,6}}\b|{_TOWN}|\d{{4,6}}\b))?"
ADDRESS_FORMS = [
    re.compile(rf"(?<![\w/.-])(?:{_UNIT}(?:,\s|/|\s))?(?:\d+[a-z]?|{_COUNT})\s(?:[nsew]\.?\s)?(?:{_W}\s){{1,3}}?{_KIND}(?:,\s{_UNIT})?{_TAIL}", re.I),
    re.compile(rf"\b{_W}(?:gasse|straße|strasse|weg|platz|allee)\s\d+[a-z]?{_TAIL}", re.I),
    re.compile(rf"(?<![\w/.-])\d+[a-z]?,?\s(?:rue|avenue|boulevard|place|chemin)\s(?:(?:de|des|du|la|le)\s)*{_W}{_TAIL}", re.I),
    re.compile(rf"\b(?:via|viale|calle|rua|piazza|plaza)\s(?:(?:de|del|la|di|della)\s)*{_W},?\s\d+[a-z]?{_TAIL}", re.I),
]
_TAIL_END = re.compile(rf"{_TAIL}$", re.I)
_TOKEN = re.compile(rf"{_W}|\d+|[^\w\s]|_")
_NOISE = re.compile(r"\[[^\]]{0,30}\]|\(\(?[a-z ]{2,30}\)\)?|<[a-z /]{2,30}>|\{[^}]{0,30}\}|\*[a-z ]+\*|--\s[a-z ]+\s--|♪|\.{2,}|…")

_ASIDE = re.compile(r"\[\s?(?:[a-z]+(?: [\d:]+)?|[A-Z]{4,})\s?\]|\(\(?[a-z ]{3,30}\)\)?|<[a-z]+(?: [a-z]+)?/?>|\{[a-z ]+\}|\*[a-z]+\*|--\s[a-z ]+\s--|♪|\b(?:[Uu]+[hm]+|[Ee]r+m?|[Hh]mm+|[Aa]h+|like|[Yy]ou know|[Ss]ort of|I mean)\b(?:\.{3}|,)?")

Candidate = tuple[int, int, str, list[str]]


@lru_cache(maxsize=200_000)
def _shape(text: str) -> tuple[str, str, str]:
    """Sizes of the groups of digits, the signs between them, and the capital letters at either end of a number."""
    groups = re.findall(r"\d+", text)
    signs = "".join(sorted(set(re.findall(r"[^\w]", text))))
    letters = re.match(r"[A-Z]*", text)[0], re.search(r"[A-Z]*$", text)[0]
    return ".".join(str(len(g)) for g in groups), signs or "none", f"{len(letters[0])} {len(letters[1])}"


def _case(word: str) -> str:
    return "l" if word.islower() else "U" if word.isupper() and len(word) > 1 else "T" if word[:1].isupper() else "m"


def _context(text: str, start: int) -> list[str]:
    """Up to five words before a place, without fillers and sound notes."""
    left = _NOISE.sub(" ", text[max(0, start - 70) : start].lower())
    return [w for w in re.findall(r"[^\W\d_]+|[^\w\s]|\d+", left) if w not in FILLERS][-5:]


def spelled_length(text: str) -> int:
    n, times = 0, 1
    for w in re.findall(r"[a-z]+", text.lower()):
        if w in ("double", "triple"):
            times = 2 if w == "double" else 3
        else:
            n, times = n + times, 1
    return n


def number_candidates(text: str) -> Iterable[Candidate]:
    """Phone and identity numbers of at least ``LEAST_DIGITS`` digits, in figures or spelled."""
    spans = []
    for m in _NUMERIC.finditer(text):
        a, b = m.span()
        if text[b - 1] == ")" and "(" not in m[0]:
            b -= 1
        if text[a] == "(" and ")" not in text[a:b]:
            a += 1
        if sum(c.isdigit() for c in text[a:b]) >= LEAST_DIGITS:
            spans.append((a, b, False))
    spans += [(m.start(), m.end(), True) for m in SPELLED.finditer(text) if spelled_length(m[0]) >= LEAST_DIGITS]
    for start, end, spelled in spans:
        words = _context(text, start)
        for a, b in {(start, end), *((start, end - k) for k in (2,) if text[end - 2 : end - 1] == " " and text[end - 1].isupper())}:
            body = text[a:b]
            digits = spelled_length(body) if spelled else sum(c.isdigit() for c in body)
            sizes, signs, ends = ("", "spelled", "") if spelled else _shape(body)
            for kind in (PHONE, ID):
                yield a, b, kind, [
                    kind, f"{kind} digits {min(digits, 16)}", f"{kind} sizes {sizes}", f"{kind} signs {signs}", f"{kind} ends {ends}", f"{kind} ends {ends} {signs}", f"{kind} start {body[0] if body[0] in '+(0' else 'A' if body[0].isalpha() else 'd'}",
                    *{f"{kind} near {w}" for w in words}, f"{kind} before {words[-1] if words else '^'}", f"{kind} next {text[b : b + 1] or '$'}",
                ]


def email_candidates(text: str) -> Iterable[Candidate]:
    """E-mail addresses, written, masked or spoken."""
    for pattern, how in ((_EMAIL, "written"), (_SPOKEN_EMAIL, "spoken")):
        for m in pattern.finditer(text):
            yield m.start(), m.end(), EMAIL, [EMAIL, f"email {how}", f"email marks {'@' in m[0]} {'at' in m[0]}", f"email near {(_context(text, m.start()) or ['^'])[-1]}"]


def address_candidates(text: str) -> Iterable[Candidate]:
    """Street addresses, whole and without their tail, so that the model chooses where they end."""
    for k, pattern in enumerate(ADDRESS_FORMS):
        for m in pattern.finditer(text):
            tail = _TAIL_END.search(m[0])
            ends = {len(m[0]), tail.start() if tail and tail[0] else len(m[0])}
            for e in ends:
                body = m[0][:e]
                kept = tail[0] if tail and e == len(m[0]) else ""
                after = text[m.start() + e : m.start() + e + 2]
                town = re.search(_W, kept)
                zip_code = bool(re.search(r"\d{4}", kept))
                yield m.start(), m.start() + e, ADDRESS, [
                    ADDRESS, f"address form {k}", f"address tail {bool(kept)} {zip_code} {_case(town[0]) if town else '-'} {'in' if kept.startswith(' in') else ''}", f"address words {min(len(body.split()), 9)}",
                    f"address case {_case(body.split()[1] if len(body.split()) > 1 else body)}", f"address after {after[:1] or '$'}", f"address cut {bool(tail and tail[0]) and not kept}",
                ]


def _brief(signs: list[str]) -> str:
    """The signs of a name's words; those of three words and more without repeats, so that a long name looks like a short one."""
    return "".join(signs) if len(signs) < 3 else "".join([a for a, b in zip(signs, ["", *signs]) if a != b])


def name_spans(text: str, kind_of: Callable[[str], int]) -> Iterable[tuple[int, int, tuple]]:
    """Segments of one to ``NAME_WORDS`` words around a word known from names, or behind a title; each with what its features are made of.

    A longer run of known words is several segments, so nothing of it is lost.
    """
    spoken = _ASIDE.sub(lambda m: " " * len(m[0]), text)  # hesitations and sound notes are no context
    words: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    for m in _TOKEN.finditer(spoken):
        words.append(m[0])
        starts.append(m.start())
        ends.append(m.end())
    n = len(words)
    full = [len(w) > 1 and w[0].isalpha() for w in words]
    flags = [kind_of(w.lower()) & 3 if f else 0 for w, f in zip(words, full)]
    initial = [not f and w.isalpha() and w.isupper() for w, f in zip(words, full)]
    full += [False, False]
    initial += [False, False]
    spans: list[tuple[int, int, str]] = []
    for i in range(n):
        if initial[i]:
            if i + 2 < n and words[i + 1] == "." and full[i + 2] and (flags[i + 2] or words[i + 2][0].isupper()):
                spans.append((i, i + 3, "I.W"))
            continue
        if not full[i]:
            continue
        if flags[i] or words[i][0].isupper() and i and (words[i - 1].lower() in TITLES or words[i - 1] == "." and i > 1 and words[i - 2].lower() in TITLES):
            spans.append((i, i + 1, "W"))
        if full[i + 1] and starts[i + 1] - ends[i] == 1 and (flags[i] or flags[i + 1]):
            spans.append((i, i + 2, "WW"))
            for j in range(i + 2, min(i + NAME_WORDS, n)):
                if not (full[j] and flags[j] and starts[j] - ends[j - 1] == 1):
                    break
                spans.append((i, j + 1, "WWW"))
        elif initial[i + 1] and flags[i] and starts[i + 1] - ends[i] == 1:
            spans.append((i, i + 2, "WI"))
            if i + 2 < n and words[i + 2] == "." and ends[i + 1] == starts[i + 2]:
                spans.append((i, i + 3, "WI."))
        elif i + 2 < n and full[i + 2] and (flags[i] or flags[i + 2]):
            sign = words[i + 1]
            if sign == "_" and ends[i] == starts[i + 1] and ends[i + 1] == starts[i + 2] or sign == "," and starts[i + 2] - ends[i + 1] == 1:
                spans.append((i, i + 3, "W" + sign + "W"))
    for i, j, form in spans:
        inner = [k for k in range(i, j) if full[k]]
        after = words[j] if j < n else "$"
        right_kind = "$" if j >= n else "p" if not after[0].isalnum() else "d" if after[0].isdigit() else _case(after)
        glued = i > 0 and starts[i] == ends[i - 1] and words[i - 1][-1] in "_@.-"
        glued = glued or text[ends[j - 1] : ends[j - 1] + 1] in ("_", "@", "-") and ends[j - 1] < len(text) or text[ends[j - 1] : ends[j - 1] + 1] == "." and text[ends[j - 1] + 1 : ends[j - 1] + 2].isalnum()
        yield starts[i], ends[j - 1], (
            form, _brief([str(flags[k]) for k in inner]), _brief([_case(words[k]) for k in inner]), words[i - 1].lower() if i else "^", words[i - 2].lower() if i > 1 else "^",
            after.lower(), right_kind, i == 0 and (j == n or words[j:] == ["."]), glued,
        )


def name_features(key: tuple) -> list[str]:
    form, kinds, cases, left, left_two, right, right_kind, whole, glued = key
    sign = f"{form} {kinds}"
    return [
        NAME, f"name {sign}", f"name {form} {cases}", f"name {sign} {cases}", f"name {form} whole {whole}", f"name glued {glued}", f"name left {left}", f"name right {right}", f"name {form} right {right_kind}",
        f"name {form} {cases} left {left if not left[0].isalpha() else 'w'} right {right_kind}", f"name left2 {left_two} {left}", f"name {sign} {cases} right {right}",
    ]


NAMES, EMAILS, FIGURES, PLACES = 1, 2, 4, 8
EVERYTHING = 15


def other_candidates(text: str, reasons: int = EVERYTHING) -> list[Candidate]:
    """Candidates of the types that ``reasons`` allows, names apart."""
    found: list[Candidate] = []
    if reasons & EMAILS:
        found += email_candidates(text)
    if reasons & FIGURES:
        found += number_candidates(text)
    if reasons & PLACES:
        found += address_candidates(text)
    return found


def candidates(text: str, kind_of: Callable[[str], int]) -> list[Candidate]:
    """All candidate segments of a text with their whole-span features, by their end."""
    found = [(a, b, NAME, name_features(key)) for a, b, key in name_spans(text, kind_of)]
    return sorted([*found, *other_candidates(text)], key=lambda c: (c[1], c[0], c[2]))


class Scorer:
    """Scores of candidate segments under fixed weights; those of names are kept by what they depend on."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.names: dict[tuple, float] = {}

    def scored(self, text: str, kind_of: Callable[[str], int], reasons: int) -> list[tuple[int, int, str, float]]:
        get = self.weights.get
        out = []
        if reasons & NAMES:
            for a, b, key in name_spans(text, kind_of):
                score = self.names.get(key)
                if score is None:
                    if len(self.names) > 200_000:
                        self.names.clear()
                    score = self.names[key] = sum([get(f, 0.0) for f in name_features(key)])
                if score > 0:
                    out.append((a, b, NAME, score))
        for a, b, kind, features in other_candidates(text, reasons):
            score = sum([get(f, 0.0) for f in features])
            if score > 0:
                out.append((a, b, kind, score))
        return sorted(out, key=lambda c: (c[1], c[0], c[2]))


def decode(text: str, kind_of: Callable[[str], int], scorer: Scorer, reasons: int = EVERYTHING) -> list[tuple[int, int, str]]:
    """The best set of segments that do not overlap: boundaries and types chosen together.

    Text outside any segment scores 0, so the dynamic program steps from candidate end to candidate
    end, and a segment that scores less than nothing is in no best set. Segments are bounded by their kind's candidates
    (a name by its words, the others by their pattern), not by a number of characters.
    """
    found = scorer.scored(text, kind_of, reasons)
    if len(found) < 2:
        return [f[:3] for f in found]
    best: list[tuple[int, float, tuple | None]] = [(0, 0.0, None)]  # end, score, link
    for start, end, kind, score in found:
        k = len(best) - 1
        while best[k][0] > start:
            k -= 1
        total = best[k][1] + score
        if total > best[-1][1]:
            best.append((end, total, (start, end, kind, k)))
    out, link = [], best[-1][2]
    while link:
        out.append(link[:3])
        link = best[link[3]][2]
    return out[::-1]


def train(sample: list[tuple[str, list[tuple[int, int, str]]]], kind_of: Callable[[str], int], rounds: int = 20, rate: float = 0.4, decay: float = 1e-3) -> dict[str, float]:
    """Weights that maximise the conditional likelihood of the labelled sample.

    The partition function runs forward and backward over the lattice of candidate segments; the gradient is
    observed minus expected features. Steps are scaled per weight (AdaGrad). Labels that are no candidate are skipped.
    """
    lattices = []
    index: dict[str, int] = {}
    for text, gold in sample:
        found = candidates(text, kind_of)
        if not found:
            continue
        places = sorted({0, *(c[0] for c in found), *(c[1] for c in found)})
        at = {p: k for k, p in enumerate(places)}
        want = set(gold)
        feats = [np.array([index.setdefault(f, len(index)) for f in c[3]]) for c in found]
        lattices.append(([(at[c[0]], at[c[1]]) for c in found], feats, np.array([(c[0], c[1], c[2]) in want for c in found], float), len(places)))
    weights, squares = np.zeros(len(index)), np.full(len(index), 1e-6)
    order = np.arange(len(lattices))
    rng = np.random.default_rng(11)
    for _ in range(rounds):
        rng.shuffle(order)
        for k in order:
            arcs, feats, gold, n = lattices[k]
            scores = [float(weights[f].sum()) for f in feats]
            forward = [-math.inf] * n
            forward[0] = 0.0
            by_end: dict[int, list[int]] = defaultdict(list)
            by_start: dict[int, list[int]] = defaultdict(list)
            for c, (a, b) in enumerate(arcs):
                by_end[b].append(c)
                by_start[a].append(c)
            for p in range(1, n):
                terms = [forward[p - 1]] + [forward[arcs[c][0]] + scores[c] for c in by_end[p]]
                top = max(terms)
                forward[p] = top + math.log(sum(math.exp(t - top) for t in terms))
            backward = [0.0] * n
            for p in range(n - 2, -1, -1):
                terms = [backward[p + 1]] + [backward[arcs[c][1]] + scores[c] for c in by_start[p]]
                top = max(terms)
                backward[p] = top + math.log(sum(math.exp(t - top) for t in terms))
            for c, (a, b) in enumerate(arcs):
                gap = gold[c] - math.exp(min(0.0, forward[a] + scores[c] + backward[b] - forward[n - 1]))
                if abs(gap) > 1e-4:
                    g = gap - decay * weights[feats[c]]
                    squares[feats[c]] += g * g
                    weights[feats[c]] += rate * g / np.sqrt(squares[feats[c]])
    return {f: round(float(weights[i]), 4) for f, i in index.items() if abs(weights[i]) > 1e-3}
