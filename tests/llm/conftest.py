import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from plumbline.llm.ship import ship  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, slot string"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def documents(spark):
    """A frame of (doc_id, text) or (doc_id, text, source) with extra, clashing columns."""

    def make(rows):
        full = [
            (r[0], r[1], None, r[2] if len(r) > 2 else None, None, "x", None) for r in rows
        ]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make
