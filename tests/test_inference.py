"""Cells, arrays and columns, against hand-worked types and a row-by-row fold."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.constants import RELATION_SCHEME
from recordloom.functions import infer
from recordloom.functions import recognise as R
from recordloom.model import AttributeType as A
from recordloom.operators.inference import column_type_aggregate, infer_columns, infer_schema, select_best_type
from recordloom.plans import inferring
from tests.conftest import collect

TSV_CELLS = [
    (None, "NULL"), ("", "NULL"), ("hello", "STRING"), ("Hello World", "STRING"),
    ("true", "BOOLEAN"), ("TRUE", "BOOLEAN"), ("tRue", "BOOLEAN"), ('"true"', "BOOLEAN"),
    ("5", "NUMBER"), ("-1.23", "NUMBER"), ("1e5", "NUMBER"), (".5", "NUMBER"), ("5.", "NUMBER"), ("+7", "NUMBER"),
    ('"5"', "STRING"), ("1,000", "STRING"), ("0x10", "STRING"), ("NaN", "STRING"), ("1e", "STRING"), (" 5", "STRING"),
    ("1979-06-25", "DATE"), ("2021-1-5", "STRING"), ("2021-02-30", "STRING"), ("20210105", "NUMBER"),
    ("2024-08-13T19:00:00", "DATE_TIME"), ("2024-08-13T19:00", "DATE_TIME"), ("2024-08-13T19:00:00.123456789", "DATE_TIME"),
    ("2024-08-13 19:00:00", "STRING"), ("2024-08-13T24:00:00", "STRING"), ("2024-08-13T19:00:00Z", "STRING"),
    ('{"foo":12}', "JSON"), ("{bad", "STRING"), ('{"a":{"b":[1]}}', "JSON"), ('"{}"', "JSON"),
    ("drs://example.org/dg.4503/abc", "FILE"), ("DRS://example.org/a", "FILE"), ("drs://", "STRING"), ("drs://exa mple/a", "STRING"),
    ("https://x.blob.core.windows.net/c/f.txt", "FILE"), ("https://example.org/f.txt", "STRING"),
    ("http://x.blob.core.windows.net/c", "STRING"), ("https://blob.core.windows.net.evil.org/x", "STRING"),
    (f"{RELATION_SCHEME}/test/1", "RELATION"), (f'"{RELATION_SCHEME}/test/1"', "RELATION"),
    ("[]", "EMPTY_ARRAY"), ("[1,2,3]", "ARRAY_OF_NUMBER"), ('["Hello","World"]', "ARRAY_OF_STRING"),
    ("[true, FALSE]", "ARRAY_OF_BOOLEAN"), ("[true, 1]", "ARRAY_OF_STRING"), ("[“a”, “b”]", "ARRAY_OF_STRING"),
    ('["1971-11-12"]', "ARRAY_OF_DATE"), ('["1971-11-12", "1971-11-12T01:02:03"]', "ARRAY_OF_DATE_TIME"),
    ('["1971-11-12T01:02:03", "1971-11-12"]', "ARRAY_OF_STRING"), ("[null]", "ARRAY_OF_STRING"), ("[null, 1]", "ARRAY_OF_NUMBER"),
    ('[{"foo":1},{"bar":2}]', "ARRAY_OF_JSON"), ("[[1],[2]]", "ARRAY_OF_JSON"), ('[{"foo":1}, 5]', "ARRAY_OF_JSON"),
    (f'["{RELATION_SCHEME}/t/1"]', "ARRAY_OF_RELATION"), ('["drs://example.org/1"]', "ARRAY_OF_FILE"),
    ('["true"]', "ARRAY_OF_BOOLEAN"), ('["5"]', "ARRAY_OF_STRING"), ("[Hello]", "STRING"), ("[1,", "STRING"),
]

JSON_VALUES = [
    ("null", "NULL"), ("12", "NUMBER"), ("1.5e3", "NUMBER"), ("true", "BOOLEAN"), ('"true"', "BOOLEAN"), ('"12"', "STRING"),
    ('"2020-01-01"', "DATE"), ('"2020-01-01T10:00:00"', "DATE_TIME"), ('"x"', "STRING"), ('{"a":1}', "JSON"),
    ('"{\\"a\\":1}"', "JSON"), ("[]", "EMPTY_ARRAY"), ("[1, null]", "ARRAY_OF_NUMBER"), ('[1, "a"]', "ARRAY_OF_STRING"),
    (f'"{RELATION_SCHEME}/t/1"', "RELATION"), ('[{"a":1}]', "ARRAY_OF_JSON"), ('"[1,2]"', "STRING"),
]


@pytest.mark.parametrize("by_name", [True, False])
def test_tsv_cells(spark, by_name):
    df = spark.createDataFrame(list(enumerate(TSV_CELLS)), "i int, c struct<cell: string, want: string>").select("i", "c.*")
    kind = infer.tsv_type("cell" if by_name else F.col("cell"))
    wrong = df.withColumn("got", kind).filter("not (got <=> want)")
    assert collect(wrong) == []


def test_json_values(spark):
    df = spark.createDataFrame(JSON_VALUES, "cell string, want string")
    wrong = df.withColumn("got", infer.json_type(F.parse_json("cell"))).filter("not (got <=> want)")
    assert collect(wrong) == []


def test_select_best_type_table():
    cases = [
        (A.NULL, A.NUMBER, A.NUMBER), (A.NUMBER, A.NULL, A.NUMBER), (A.DATE, A.DATE_TIME, A.DATE_TIME),
        (A.DATE_TIME, A.DATE, A.STRING), (A.NUMBER, A.BOOLEAN, A.STRING), (A.EMPTY_ARRAY, A.ARRAY_OF_DATE, A.ARRAY_OF_DATE),
        (A.ARRAY_OF_DATE, A.EMPTY_ARRAY, A.ARRAY_OF_DATE), (A.ARRAY_OF_DATE, A.ARRAY_OF_DATE_TIME, A.ARRAY_OF_DATE_TIME),
        (A.ARRAY_OF_DATE_TIME, A.ARRAY_OF_DATE, A.ARRAY_OF_STRING), (A.ARRAY_OF_NUMBER, A.ARRAY_OF_BOOLEAN, A.ARRAY_OF_STRING),
        (A.ARRAY_OF_NUMBER, A.NUMBER, A.STRING), (A.EMPTY_ARRAY, A.NUMBER, A.STRING), (A.JSON, A.JSON, A.JSON),
    ]
    for existing, new, want in cases:
        assert select_best_type(existing, new) is want


def test_column_type_equals_the_fold(spark):
    """Random columns of few types, aggregated at once, against folding row by row."""
    rng = random.Random(7)
    pools = [
        [A.NULL, A.DATE, A.DATE_TIME], [A.NULL, A.ARRAY_OF_DATE, A.ARRAY_OF_DATE_TIME, A.EMPTY_ARRAY],
        [A.NUMBER, A.NULL], [A.EMPTY_ARRAY, A.NULL], list(A),
    ]
    rows, want = [], {}
    for column in range(400):
        pool = rng.choice(pools)
        cells = [rng.choice(pool) for _ in range(rng.randint(1, 5))]
        folded = A.NULL
        for position, cell in enumerate(cells):
            folded = select_best_type(folded, cell) if position else cell
            rows.append((column, position, cell.value))
        want[column] = folded.value
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "column int, position long, kind string").repartition(8)
    got = df.groupBy("column").agg(column_type_aggregate(F.col("kind"), F.col("position")).alias("kind"))
    assert {r["column"]: r["kind"] for r in got.collect()} == want


def test_infer_columns_of_no_rows(spark):
    empty = spark.createDataFrame([], "a string, n long")
    assert collect(infer_columns(empty, {"a": infer.tsv_type("a")}, F.col("n"))) == [("a", "NULL")]


def test_uuid_and_curly_quotes(spark):
    df = spark.createDataFrame([("123e4567-e89b-12d3-a456-426614174000", True), ("1-2-3-4-5", True), ("123", False)], "c string, w boolean")
    assert df.filter(R.is_uuid(F.col("c")) != F.col("w")).count() == 0


def test_pieces_merge_in_any_order(spark, tmp_path):
    """Cells cut into uploads, whose summaries are merged in every order, have the types of all cells at once."""
    import itertools
    import random

    from recordloom.operators.inference import column_types, merge_summaries, summarise_columns
    from recordloom.sinks.summary import keep_summary, kept_summary

    rng = random.Random(4)
    kinds = ["NULL", "DATE", "DATE_TIME", "ARRAY_OF_DATE", "ARRAY_OF_DATE_TIME", "EMPTY_ARRAY", "NUMBER"]
    names = [f"c{i}" for i in range(12)]
    # few kinds per column, so that most columns are not just text
    pools = [rng.sample(kinds[:3] if i % 2 else kinds[3:6], rng.randint(1, 3)) for i in range(12)]
    rows = [(n, *[sorted(pool, key=lambda k: (n < 15) == (k.endswith("TIME")))[0] if i < 6 else rng.choice(pool) for i, pool in enumerate(pools)]) for n in range(30)]
    df = spark.createDataFrame(rows, "n long, " + ", ".join(f"{c} string" for c in names))
    cells = {c: F.col(c) for c in names}
    want = infer_schema(df, cells, F.col("n"))
    assert len(set(want.values())) > 3
    parts = [summarise_columns(df.where(f"n >= {a} and n < {a + 10}"), cells, F.col("n") % 10, a // 10) for a in (0, 10, 20)]
    for order in itertools.permutations(parts):
        assert {r["attribute"]: r["attribute_type"] for r in column_types(merge_summaries(merge_summaries(*order[:2]), order[2], order[0])).collect()} == {k: v.value for k, v in want.items()}
    path = str(tmp_path / "t")
    assert kept_summary(spark, path) is None
    for version, part in enumerate(parts):
        got = keep_summary(part, path, version)
    assert got == want and keep_summary(parts[2], path, 2) == want
    assert kept_summary(spark, path, 0).count() == 12


def test_uploads_are_typed_by_all_tasks(spark, sf):
    """Rows of a file that one task would read are dealt out before their cells are typed."""
    assert inferring._mixed_cells(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
