"""Reading one transcribed utterance: written time, speaker label, notes, hesitations; and the written forms of a name."""

from __future__ import annotations

import re

# Sounds that are no words, words that make a name generic, roles in name decorations.
HESITATION = re.compile(r"(?<![\w-])(?:u+m+|u+h+|e+r+m*|h+m+|a+h+|m{2,}|uh-huh|mhm)(?![\w-])(?:\.{2,}|[,.…])*", re.I)
GENERIC = frozenset("speaker unknown guest participant conference room caller user host phone iphone ipad anonymous attendee moderator".split())
ROLE = r"(?:USER|PROSPECT|INTERNAL|EXTERNAL|GUEST|UNKNOWN|PARTICIPANT|HOST)"

_CLOCK = r"\d{1,3}(?::\d{1,2}){1,2}(?:[.,]\d{1,3})?"
_TIME = re.compile(rf"\s*(?:[\[(<]\s*({_CLOCK})\s*[\])>]\s*(?:-->|[-–—])?|({_CLOCK})\s*(?:-->|[-–—]|$)|@(?:(\d+)h)?(\d+)m(\d+)s\b)\s*")
_NOTE = re.compile(
    rf"\[\s*(?!at\s*\]|dot\s*\])(?:[a-z]+(?: [a-z]+){{0,2}}|[A-Z]{{2,}})(?:\s+{_CLOCK})?\s*\]"
    r"|\(\(\s*[a-z ]{2,40}\)\)|\((?!at\)|dot\))[a-z]+(?: [a-z]+){0,2}\)|\{\s*[a-z ]{2,40}\}|<\s*[a-z]+(?: [a-z]+){0,2}\s*/?>"
    r"|(?<!\*)\*[a-z]+(?: [a-z]+){0,2}\*(?!\*)|--\s+[a-z]+(?: [a-z]+){0,2}\s+--|[♪♫]+"
)
_WORD = r"[^\W\d_][\w.'’\-]*"
_NAME = rf"{_WORD}(?:,?[ _]{_WORD}){{0,3}}"
_LABEL = re.compile(
    rf"\s*(?:\*\*\s*({_NAME})\s*(?::\s*\*\*|\*\*\s*:)|>+\s*({_NAME})\s*:|\[\s*({_NAME})\s*\]:?|<\s*({_NAME})\s*>:?|({_NAME})\s*:(?=\s|$)|({_NAME})\s+[-–—](?=\s|$))\s*"
)
_DECORATION = re.compile(rf"\s*(?:\([^)]*\)|\[[^\]]*\]|\|.*$|\s[-–—]\s*{ROLE}\s*$)")


_NOTE_FIRST = re.compile(rf"\s*(?:{_NOTE.pattern})\s*")
_HESITATION_FIRST = re.compile(rf"\s*(?:{HESITATION.pattern})\s*", re.I)
_INNER_TIME = re.compile(rf"[\[(<]\s*{_CLOCK}\s*[\])>]|@\d+m\d+s\b")
_SIGNS = re.compile(r"[\[(<{*♪♫@]|--")
_LOOSE, _SAID = re.compile(r" ([,.;:?!])"), re.compile(r"[^\W_]")


def milliseconds(match: re.Match) -> int:
    """The time that ``_TIME`` matched, in milliseconds."""
    clock = match[1] or match[2]
    if clock is None:
        return ((int(match[3] or 0) * 60 + int(match[4])) * 60 + int(match[5])) * 1000
    whole, _, part = clock.replace(",", ".").partition(".")
    total = 0
    for x in whole.split(":"):
        total = total * 60 + int(x)
    return total * 1000 + int((part + "000")[:3])


def _named(label: str) -> bool:
    """Whether a label is written like a name rather than the start of a sentence or a sound note."""
    words = re.split(r"[ _,]+", label.strip())
    capital = all(w[0].isupper() for w in words if w)
    return (capital and len(words) <= 3 or len(words) == 2 and label == label.lower()) and not all(w.lower() in GENERIC for w in words)


def read_utterance(text: str | None, words: bool = True) -> tuple[int | None, str | None, str | None]:
    """``(written time in ms, speaker label, spoken words)`` of one utterance.

    Times and one label are read at the start of the text, in any order, also behind
    notes and hesitations. The spoken words are what remains without times, label, sound
    notes and hesitation sounds; null if no letter or digit remains. Null text gives
    three nulls. Without ``words`` the third is only a mark that some remain.
    """
    if text is None:
        return None, None, None
    at, label, rest = None, None, text
    signs = _SIGNS.search(text) is not None
    while True:
        if m := _TIME.match(rest):
            at = milliseconds(m) if at is None else at
            rest = rest[m.end() :]
        elif signs and (m := _NOTE_FIRST.match(rest)):
            rest = rest[m.end() :]
        elif m := _HESITATION_FIRST.match(rest):
            rest = rest[m.end() :]
        elif label is None and (m := _LABEL.match(rest)) and _named(m[m.lastindex]):
            label, rest = m[m.lastindex], rest[m.end() :]
        else:
            break
    if not words and rest[:1].isalnum():  # what stands first is no hesitation, note or time
        return at, label, "?" if rest.rstrip().endswith("?") else "."
    spoken = HESITATION.sub(" ", _NOTE.sub(" ", rest) if signs else rest)
    if signs:
        spoken = _INNER_TIME.sub(" ", spoken)
    spoken = _LOOSE.sub(r"\1", " ".join(spoken.split())).strip(" ,-–—")
    return at, label, spoken if _SAID.search(spoken) else None


def name_words(name: str | None) -> list[str]:
    """The words of a name in lower case, first name first where the writing tells; [] for a generic or empty one."""
    if not name:
        return []
    bare = _DECORATION.sub("", name).replace("_", " ").strip(" \t\n-–—:*>")
    last, comma, first = bare.partition(",")
    words = [w.strip(".'’").lower() for w in ((first + " " + last) if comma else bare).split()]
    words = [w for w in words if w]
    if any(w in GENERIC or any(c.isdigit() for c in w) for w in words):
        return []
    return words


def label_key(name: str | None) -> str | None:
    """The one key under which a written label looks for a person."""
    words = name_words(name)
    full, initials = [w for w in words if len(w) > 1], [w for w in words if len(w) == 1]
    if not full:
        return None
    if initials and len(full) == 1:
        return f"I:{initials[0]} {full[0]}"
    return f"S:{full[0]}" if len(full) == 1 else "F:" + " ".join(sorted(full))


def person_keys(name: str | None) -> list[str]:
    """The keys under which a person of this name is found: full name, each word alone, and a word with the other's initial."""
    words = [w for w in name_words(name) if len(w) > 1]
    keys = [f"S:{w}" for w in words]
    if len(words) > 1:
        keys.append("F:" + " ".join(sorted(words)))
        keys += [f"I:{a[0]} {b}" for a in words for b in words if a is not b]
    if own := label_key(name):
        keys.append(own)
    return sorted(set(keys))
