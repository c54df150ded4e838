from __future__ import annotations

import pytest


@pytest.fixture
def docs_frame(spark):
    """documents-like frames from (doc_id, text) pairs."""

    def build(rows):
        return spark.createDataFrame(rows, "doc_id long, text string")

    return build
