"""The driver contract, and that the core stands without the llm subpackage."""

from __future__ import annotations

import ast
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_subpackage():
    for source in (ROOT / "brindle").rglob("*.py"):
        if "llm" in source.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(source.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(".llm" in n for n in names), source


def test_entry_without_the_subpackage():
    code = "import sys; sys.modules['brindle.llm'] = None; import __spark_entry__ as e; assert 'bm25_topk' in e.queries() and 'p3_found' in e.queries() and 'p2_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
