"""Run registered queries and their SQL statements on the same tables and compare.

usage: python tools/check.py [sf_dir] [query ...]
"""

import glob
import importlib
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from recordloom.plans import registry  # noqa: E402
from recordloom.session import build_session  # noqa: E402
from tests.test_oracles import _rows  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    only = sys.argv[2:]
    if only and only[0].startswith("module:"):
        importlib.import_module("recordloom.plans." + only[0].split(":")[1])
        queries, oracles, only = registry.QUERIES, registry.ORACLES, []
    else:
        queries, oracles = registry.load()
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("OFF")
    db = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    bad = 0
    for name in only or queries:
        start = time.time()
        try:
            got_frame = queries[name](spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: {str(e)[:400]}")
            bad += 1
            continue
        took = time.time() - start
        if name not in oracles:
            print(f"rows  {name}: {len(got_frame)} rows, no SQL ({took:.1f}s)")
            continue
        try:
            want_frame = db.execute(oracles[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"SQL   {name}: {str(e)[:400]}")
            bad += 1
            continue
        if sorted(got_frame.columns) != sorted(want_frame.columns):
            print(f"COLS  {name}: {sorted(got_frame.columns)} / {sorted(want_frame.columns)}")
            bad += 1
            continue
        got, want = _rows(got_frame), _rows(want_frame)
        kinds = {
            c: (str(got_frame[c].dtype), str(want_frame[c].dtype))
            for c in got_frame.columns
            if len(got) and str(got_frame[c].dtype) != str(want_frame[c].dtype)
        }
        if got != want:
            bad += 1
            extra = [r for r in got if r not in set(want)][:2]
            lacking = [r for r in want if r not in set(got)][:2]
            print(f"DIFF  {name}: {len(got)} / {len(want)} rows\n   spark {extra}\n   sql   {lacking}")
        else:
            print(f"ok    {name}: {len(got)} rows ({took:.1f}s) {kinds or ''}")
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
