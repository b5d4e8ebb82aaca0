import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__ as entry  # noqa: E402


@pytest.fixture(scope="session")
def spark(spark):
    """The session of all tests, with the package known to its Python workers."""
    entry._ship(spark.sparkContext.applicationId, spark)
    return spark


DOC_FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Make a table of documents from (doc_id, text), with a column whose name clashes with many others."""

    def make(rows):
        full = [(i, t, None, "s", None if t is None else len(t), "x") for i, t in rows]
        return spark.createDataFrame(full, DOC_FIELDS + ", score string")

    return make
