"""The driver's three functions."""

import __spark_entry__ as driver
from recordloom.plans import registry


def test_entry_runs(spark):
    df = driver.entry(spark)
    assert df.columns[0] == "c_custkey" and df.count() > 0


def test_every_query_has_sql():
    """Those of the library; ``llm`` has queries that SQL can't express, with tests of their own."""
    queries, statements = registry.load()
    assert set(queries) == set(statements)
    assert set(queries) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())
