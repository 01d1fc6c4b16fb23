import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of documents from (doc_id, text[, lang[, source]]) rows."""

    def make(*rows, schema=SCHEMA):
        full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] else 0) for r in rows]
        return spark.createDataFrame(full, schema)

    return make
