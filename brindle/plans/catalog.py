"""Registered queries of the core library, with the SQL each is compared to."""

from __future__ import annotations

from brindle.plans import corpus, problems

QUERIES = {**corpus.QUERIES, **problems.QUERIES}
SQL = {**corpus.SQL, **problems.SQL}
