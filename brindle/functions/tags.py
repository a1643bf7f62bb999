"""Quote-aware splitting of a packed field into its values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

DELIMITERS = frozenset(" \t\r\n,;| 　\v\f")
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def split_packed(text: str | None) -> list[str]:
    """Values of one packed field, in order.

    A finite-state tokenizer: states are *between values*, *in a bare value* and *in a
    quoted value*; brackets outside quotes change the nesting depth and end a value.
    Inside quotes a backslash escape is decoded, a doubled quote stands for one quote,
    and delimiters are ordinary characters. An unclosed quote or bracket ends with the
    text. A field that is one quoted value holding a list is read again one level
    deeper. Values are trimmed; blank ones and a bare ``null`` are left out. Null or
    empty text gives no value.
    """
    if text is None:
        return []
    values: list[str] = []
    buffer: list[str] = []
    quote, quoted, depth, i, n = "", False, 0, 0, len(text)

    def emit() -> None:
        nonlocal quoted
        value = "".join(buffer).strip()
        if value and (quoted or value != "null"):
            values.append(value)
        buffer.clear()
        quoted = False

    while i < n:
        c = text[i]
        if quote:
            if c == "\\" and i + 1 < n:
                e = text[i + 1]
                if e == "u" and len(h := text[i + 2 : i + 6]) == 4 and all(x in "0123456789abcdefABCDEF" for x in h):
                    buffer.append(chr(int(h, 16)))
                    i += 6
                    continue
                buffer.append(ESCAPES.get(e, e))
                i += 2
                continue
            if c == quote:
                if text[i + 1 : i + 2] == quote:
                    buffer.append(c)
                    i += 2
                    continue
                quote = ""
            else:
                buffer.append(c)
        elif c in DELIMITERS:
            emit()
        elif c in "\"'" and not buffer and not quoted:
            quote, quoted = c, True
        elif c == "[" and not buffer and not quoted:
            depth += 1
        elif c == "]" and depth:
            emit()
            depth -= 1
        else:
            buffer.append(c)
        i += 1
    if depth == 0 and not values and quoted and (whole := "".join(buffer).strip()).startswith("["):
        return split_packed(whole)
    emit()
    return [v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for v in values]


@F.pandas_udf(ArrayType(StringType()))
def _split(texts: pd.Series) -> pd.Series:
    return texts.map(split_packed)


def packed_values(column: Column) -> Column:
    """``split_packed`` as a column expression: ``array<string>``, never null."""
    return F.coalesce(_split(column), F.array().cast("array<string>"))
