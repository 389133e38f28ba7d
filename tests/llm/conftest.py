"""Small tables for the training-data operators; the session comes from the folder above."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Make documents of texts; ids count from 0, or are given as (id, text)."""

    def make(texts, schema=SCHEMA):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        return spark.createDataFrame(
            [(i, x, "en", f"s{k % 3}", len(x or "")) for k, (i, x) in enumerate(rows)], schema
        )

    return make


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    return DATA
