from __future__ import annotations

import pytest

from brindle.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_runs(spark, small, name):
    df = catalog.QUERIES[name](spark, small)
    assert df.columns and df.count() > 0 or name in ("p5_text_clusters", "p7_coverage", "p7_found")


def test_found_columns(spark, small):
    wanted = {
        "p1_found": ["src_table", "row_key", "pii_type", "mention"],
        "p2_found": ["recording_id", "first_utterance_id", "utterance_count", "speaker_id"],
        "p5_found": ["cluster_key", "record_id"],
        "p7_found": ["doc_id", "item_id"],
    }
    for name, columns in wanted.items():
        assert catalog.QUERIES[name](spark, small).columns == columns
