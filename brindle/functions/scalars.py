"""Scalar functions over tickets, calls and records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}]"
WORD = r"([\p{L}\p{N}]+)"
QUERY_WORD = r"([A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*)"

# Tags and roles with a meaning.
TRIAGE_TAGS = ["icr_internal_note", "silent_solve", "forethought_support_triage_skip"]
IMPACTS = ["p1", "p2", "p3", "p4"]
IMPACT_PREFIX = "agent_business_impact_"
ROLE_PATTERN = r"\[[^\]]*?,\s*(USER|PROSPECT|EXTERNAL|GUEST|UNKNOWN|PARTICIPANT)\s+@\s*\d+:\d+(?::\d+)?\]"
CUSTOMER_ROLES = ["PROSPECT", "EXTERNAL"]


def strip(c: Column) -> Column:
    """Without surrounding white space of any kind."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def date_only(c: Column) -> Column:
    """First ten characters; a shorter text is kept, an empty one is null."""
    return F.when(F.length(c) > 0, F.substring(c, 1, 10))


def in_date_range(c: Column, start: str | None, end: str | None) -> Column:
    """Inclusive on both ends by the first ten characters; false for a missing or bad date once a bound is set."""
    if start is None and end is None:
        return F.lit(True)
    day = F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")
    test = F.lit(True)
    if start is not None:
        test = test & (day >= F.lit(start).cast("date"))
    if end is not None:
        test = test & (day <= F.lit(end).cast("date"))
    return F.coalesce(test, F.lit(False))


def json_tags(c: Column) -> Column:
    """Values of a JSON array in a string, empty ones dropped; anything else gives an empty array."""
    strict = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false"}
    whole = F.when(c.rlike(r"(?s)^\s*\[.*\]\s*$") & (F.json_array_length(c) >= 0), c)  # null for what is no JSON array
    return F.coalesce(F.filter(F.from_json(whole, "array<string>", strict), lambda t: t.isNotNull() & (t != "")), F.array().cast("array<string>"))


def lower_tags(tags: Column) -> Column:
    return F.transform(F.filter(tags, lambda t: t != ""), F.lower)


def internal_triage(tags: Column) -> Column:
    return F.arrays_overlap(tags, F.array(*map(F.lit, TRIAGE_TAGS)))


def business_impact(tags: Column) -> Column:
    """The most severe impact tag, as P1 to P4; null without one."""
    return F.coalesce(*[F.when(F.array_contains(tags, IMPACT_PREFIX + p), p.upper()) for p in IMPACTS])


def suffixes(tags: Column, prefix: str) -> Column:
    """Distinct non-empty rests of the tags that start with ``prefix``, in order."""
    with_prefix = F.filter(tags, lambda t: t.startswith(prefix) & (F.length(t) > len(prefix)))
    return F.array_distinct(F.transform(with_prefix, lambda t: t.substr(F.lit(len(prefix) + 1), F.length(t))))


def first_suffix(tags: Column, prefix: str) -> Column:
    return F.try_element_at(suffixes(tags, prefix), F.lit(1))


def mmss(ms: Column) -> Column:
    """Minutes and seconds of an offset; minutes are not bounded, a negative offset is 00:00."""
    s = F.greatest(F.floor(F.coalesce(ms, F.lit(0)) / 1000), F.lit(0))
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def speaker_line(name: Column, role: Column, offset_ms: Column, text: Column) -> Column:
    """``[who, ROLE @ mm:ss] text``."""
    who = F.coalesce(F.when(F.length(name) > 0, name), F.lit("Unknown"))
    return F.concat(F.lit("["), who, F.lit(", "), F.coalesce(role, F.lit("UNKNOWN")), F.lit(" @ "), mmss(offset_ms), F.lit("] "), strip(text))


def nonspace_length(c: Column) -> Column:
    return F.length(F.regexp_replace(c, SPACE, ""))


def alphabetic_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z][a-z'-]+)"), 1)


def query_tokens(c: Column) -> Column:
    """Tokens of a question of two characters and more, lower case, repeats kept."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(QUERY_WORD), 1), F.lower), lambda t: F.length(t) > 1)


def index_tokens(c: Column) -> Column:
    """Words of an indexed field in order; null gives none."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(WORD), 1), F.array().cast("array<string>"))


def participants(list_column: Column) -> Column:
    """``array<struct<id, name, role>>``: display name, else first name, else Unknown; role or UNKNOWN. Null entries are skipped."""
    filled = lambda c: F.when(F.length(c) > 0, c)
    return F.transform(
        F.filter(F.coalesce(list_column, F.array().cast("array<struct<inMeetingId:bigint,displayName:string,firstName:string,type:string>>")), lambda p: p.isNotNull()),
        lambda p: F.struct(
            p["inMeetingId"].alias("id"),
            F.coalesce(filled(p["displayName"]), filled(p["firstName"]), F.lit("Unknown")).alias("name"),
            F.coalesce(filled(p["type"]), F.lit("UNKNOWN")).alias("role"),
        ),
    )


def duration_seconds(c: Column) -> Column:
    """Whole seconds of anything numeric; null for zero and for what is no number."""
    seconds = c.cast("string").try_cast("double").try_cast("bigint")
    return F.when(seconds != 0, seconds)


def roles_in_text(c: Column) -> Column:
    """Roles named in the speaker headers of a text, sorted."""
    return F.array_sort(F.array_distinct(F.coalesce(F.regexp_extract_all(c, F.lit(ROLE_PATTERN), 1), F.array().cast("array<string>"))))


def customer_voice(roles: Column) -> Column:
    return F.arrays_overlap(roles, F.array(*map(F.lit, CUSTOMER_ROLES)))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalized(v: Column) -> Column:
    """A vector of length one; a zero or not finite one raises."""
    norm = F.sqrt(dot(v, v))
    bad = F.isnan(norm) | (norm == 0) | (norm == F.lit(float("inf")))
    return F.when(bad, F.raise_error(F.lit("vector without direction"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def topic_label(topic_id: Column, keywords: Column) -> Column:
    """First four keywords; -1 is ``(outliers)``; without keywords ``topic N``."""
    return (
        F.when(topic_id == -1, "(outliers)")
        .when(F.coalesce(F.size(keywords), F.lit(0)) > 0, F.array_join(F.slice(keywords, 1, 4), ", "))
        .otherwise(F.concat(F.lit("topic "), topic_id.cast("string")))
    )


def snippet(c: Column, length: int = 600) -> Column:
    """Stripped text without carriage returns, cut to ``length`` characters with an ellipsis."""
    clean = strip(F.regexp_replace(c, "\r", ""))
    return F.when(F.length(clean) > length, F.concat(F.regexp_replace(F.substring(clean, 1, length), rf"{SPACE}+$", ""), F.lit("…"))).otherwise(clean)


def ticket_text(ticket_id: Column, subject: Column, tags: Column, body: Column) -> Column:
    """``[tags: ...]``, ``# subject`` and body, parted by blank lines; the heading is left out where the body starts with it."""
    filled = lambda c: F.when(F.length(strip(c)) > 0, strip(c))
    head = F.concat(F.lit("# "), filled(subject))
    text = filled(body)
    parts = F.concat_ws(
        "\n\n",
        F.when(F.size(tags) > 0, F.concat(F.lit("[tags: "), F.array_join(tags, ", "), F.lit("]"))),
        F.when(~F.coalesce(text.startswith(head), F.lit(False)), head),
        text,
    )
    return F.coalesce(filled(parts), filled(subject), ticket_id)


def change_text(key: Column, summary: Column, description: Column, workaround: Column) -> Column:
    """Summary, description and workaround of a change request; else its key."""
    filled = lambda c: F.when(F.length(strip(c)) > 0, strip(c))
    parts = F.concat_ws("\n\n", filled(summary), filled(description), F.concat(F.lit("Workaround:\n"), filled(workaround)))
    return F.coalesce(filled(parts), key)


def call_header(recording: Column, title: Column, account: Column, day: Column, people: Column) -> Column:
    """Four lines: title (``recording <id>`` for a blank one), account, date, participants with roles; ``unknown`` for what is missing."""
    filled = lambda c, other: F.coalesce(F.when(F.length(strip(c)) > 0, c), other)
    names = F.array_join(F.transform(people, lambda p: F.concat(p["name"], F.lit(" ["), p["role"], F.lit("]"))), ", ")
    lines = [F.concat(F.lit("account: "), account), F.concat(F.lit("date: "), filled(day, F.lit("unknown"))), F.concat(F.lit("participants: "), filled(names, F.lit("unknown")))]
    return F.concat_ws("\n", filled(title, F.concat(F.lit("recording "), recording)), *lines)
