import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _text string, hub string, k int"


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest documents table."""
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def made(spark):
    """Makes a documents table of (id, text) rows, with further columns whose names clash with internal ones."""

    def make(rows):
        full = [(i, t, None, "s", None if t is None else len(t), 7, "x", "h", 1) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
