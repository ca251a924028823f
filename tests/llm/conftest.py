import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make(spark):
    """Documents with a clashing and an extra column, from (doc_id, text) rows."""

    def docs(rows, **more):
        full = [(i, t, "en", "src0", len(t or ""), i, "x") for i, t in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, n long, label string"
        return spark.createDataFrame(full, schema)

    return docs


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
