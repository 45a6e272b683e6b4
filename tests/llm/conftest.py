from __future__ import annotations

import pytest

ROW = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Builds a documents table with clashing extra columns from (doc_id, text[, source])."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or ""), 7, "x", 1.5) for r in rows]
        return spark.createDataFrame(full, ROW + ", size int, shard string, key double")

    return make
