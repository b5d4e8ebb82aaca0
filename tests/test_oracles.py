"""Every named query gives the rows of its SQL statement."""

import datetime
import glob
import os
from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd
import pytest

from recordloom.plans import registry

QUERIES, ORACLES = registry.load()


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def _typed(value):
    """A value with its type; null, the text ``null`` and a number's text are all different."""
    if value is None or value is pd.NaT:
        return ("none",)
    if isinstance(value, bool | np.bool_):
        return ("bool", bool(value))
    if isinstance(value, float | np.floating):
        # a column of whole numbers with nulls comes as floats
        return ("none",) if value != value else ("number", repr(float(value)))
    if isinstance(value, int | np.integer):
        return ("number", repr(float(value)) if abs(int(value)) < 2**53 else str(value))
    if isinstance(value, Decimal):
        return ("number", repr(float(value)))
    if isinstance(value, dict):
        return ("map", tuple(sorted((k, _typed(v)) for k, v in value.items())))
    if isinstance(value, list | tuple | np.ndarray):
        return ("list", tuple(map(_typed, value)))
    if isinstance(value, datetime.date | np.datetime64):
        return ("time", str(pd.Timestamp(value)))
    return (type(value).__name__, str(value))


def _rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(_typed, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(name, spark, sf, db):
    got = QUERIES[name](spark, sf).toPandas()
    assert name in ORACLES
    want = db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)
