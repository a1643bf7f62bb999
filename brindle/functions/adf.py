"""Plain text of a rich-text document tree (Atlassian document format) held as JSON."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BLOCK_END = "\n\n"


def _attribute(node: dict, *names: str) -> str:
    """The first of these attributes that is filled."""
    attributes = node.get("attrs") or {}
    return next((str(attributes[n]) for n in names if attributes.get(n)), "")


def _number(node: dict, name: str) -> int:
    """An attribute as a whole number, 1 if it is none."""
    try:
        return int((node.get("attrs") or {}).get(name, 1))
    except (TypeError, ValueError):
        return 1


def _inner(node: object, depth: int) -> str:
    """The children of a node, one after the other; ``depth`` counts the lists around them."""
    children = node.get("content") if isinstance(node, dict) else node
    return "".join(_one(c, depth) for c in children) if isinstance(children, list) else ""


def _leaf(node: dict, depth: int = 0) -> str:
    """Text, with the target of each link behind it unless that is the text."""
    text = node.get("text") or ""
    links = [_attribute(m, "href") for m in node.get("marks") or [] if isinstance(m, dict) and m.get("type") == "link"]
    for target in links:
        text += f" ({target})" if target and target != text else ""
    return text


def _heading(node: dict, depth: int) -> str:
    return "#" * min(6, max(1, _number(node, "level"))) + " " + _inner(node, depth).rstrip() + BLOCK_END


def _list(node: dict, depth: int) -> str:
    """One line per item behind its mark; further lines are indented by the mark's width. An empty item has no line but its number."""
    ordered = node["type"] == "orderedList"
    first = _number(node, "order")
    out = []
    for k, item in enumerate(node.get("content") or []):
        lines = _inner(item, depth + 1).rstrip().splitlines()
        mark = f"{first + k}. " if ordered else "- "
        out += ["  " * depth + (" " * len(mark) if i else mark) + line + "\n" for i, line in enumerate(lines)]
    return "".join(out) + ("" if depth else "\n")


def _code(node: dict, depth: int) -> str:
    lines = "".join(_leaf(c) for c in node.get("content") or [] if isinstance(c, dict) and c.get("type") == "text")
    return f"```\n{lines.rstrip()}\n```{BLOCK_END}"


def _quote(node: dict, depth: int) -> str:
    return "\n".join("> " + line for line in _inner(node, depth).rstrip().splitlines()) + BLOCK_END


def _mention(node: dict, depth: int) -> str:
    who = _attribute(node, "text", "displayName")
    return "@" + who.lstrip("@") if who else ""


def _card(node: dict, depth: int) -> str:
    target = _attribute(node, "url")
    return f" ({target}) " if target else ""


def _table(node: dict, depth: int) -> str:
    """A line per row, its cells parted by bars."""
    rows = [[c for c in row.get("content") or [] if isinstance(c, dict)] for row in node.get("content") or [] if isinstance(row, dict)]
    lines = [" | ".join(_inner(c, depth).strip().replace("\n", " ") for c in cells) for cells in rows if cells]
    return "\n".join(lines) + BLOCK_END if lines else ""


# The kinds of nodes of the format. A kind that is not listed gives the text of its children.
KINDS: dict[str, Callable[[dict, int], str]] = {
    "text": _leaf,
    "paragraph": lambda node, depth: _inner(node, depth) + BLOCK_END,
    "heading": _heading,
    "bulletList": _list,
    "orderedList": _list,
    "codeBlock": _code,
    "code_block": _code,
    "blockquote": _quote,
    **dict.fromkeys(("rule", "hardBreak", "hard_break"), lambda node, depth: "\n"),
    "mention": _mention,
    "emoji": lambda node, depth: _attribute(node, "shortName", "text"),
    **dict.fromkeys(("inlineCard", "blockCard"), _card),
    "table": _table,
    **dict.fromkeys(("mediaSingle", "mediaGroup", "media"), lambda node, depth: ""),
}


def _one(node: object, depth: int) -> str:
    if isinstance(node, list):
        return _inner(node, depth)
    return KINDS.get(node.get("type"), _inner)(node, depth) if isinstance(node, dict) else ""


def adf_text(tree: str | None) -> str | None:
    """Text of one tree given as JSON, without white space at its end; null and bad JSON give null, a bare string itself."""
    if tree is None:
        return None
    try:
        node = json.loads(tree)
    except ValueError:
        return None
    return (node if isinstance(node, str) else _one(node, 0)).rstrip()


@F.pandas_udf(StringType())
def _adf(trees: pd.Series) -> pd.Series:
    return trees.map(adf_text)


def adf_to_text(c: Column) -> Column:
    return _adf(c)
