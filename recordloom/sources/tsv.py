"""Tab-separated record files."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.errors import InvalidTsv
from recordloom.functions import recognise as R
from recordloom.functions.convert import convert
from recordloom.functions.infer import is_quoted, tsv_array, tsv_type
from recordloom.functions.jsontext import canonical_json
from recordloom.model import AttributeType as A
from recordloom.model import quoted, tag
from recordloom.operators.inference import infer_schema
from recordloom.sources.places import in_place

ORDINAL = "sys_ordinal"
ODD_ROW = "sys_odd_row"


def check_header(columns: Sequence[str], primary_key: str | None = None) -> str:
    """The primary key column of a header, which must be free of blanks and repeats."""
    if any(not c.strip() for c in columns):
        raise InvalidTsv("the header has blank column names")
    if any(n > 1 for n in Counter(columns).values()):
        raise InvalidTsv("the header repeats a column name")
    if primary_key is not None and primary_key not in columns:
        raise InvalidTsv(f"there is no column {primary_key!r}")
    return primary_key or columns[0]


def read_tsv(
    spark: SparkSession, paths: str | Sequence[str], primary_key: str | None = None, multi_line: bool = False
) -> tuple[DataFrame, str]:
    """All cells as text, and the primary key column (default: the leftmost).

    Cells may be quoted and hold tabs; quotes inside them are doubled or escaped by
    a backslash. Newlines inside cells need ``multi_line``, with which a file can't
    be split among tasks. All files must have the same header: Spark compares every
    file's with the first one's. A row with more cells than the header, and text
    that is no UTF-8 (or holds the replacement character itself), fails the read.
    """
    options = {"sep": "\t", "quote": '"', "escape": '"', "multiLine": multi_line}
    reader = spark.read.options(**options)
    # read the header as data: as a header, Spark would rename blanks and repeats
    first = reader.csv(paths).first()
    if first is None:
        raise InvalidTsv("there are no rows")
    names = [c if c is not None else "" for c in first]
    key = check_header(names, primary_key)
    schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    odd = {"enforceSchema": False, "columnNameOfCorruptRecord": ODD_ROW}
    cells = reader.options(**odd).csv(paths, schema=f"{schema}, `{ODD_ROW}` string", header=True)
    # a row is odd with fewer cells too, which then are null; only a surplus is an error
    again = F.from_csv(quoted(ODD_ROW), ", ".join(f"c{i} string" for i in range(len(names) + 1)), options)
    surplus = quoted(ODD_ROW).isNotNull() & again[f"c{len(names)}"].isNotNull()
    broken = F.concat_ws("", *[quoted(n) for n in names]).contains("\ufffd")
    where = F.input_file_name()
    fault = F.when(surplus, F.concat(F.lit("a row has more cells than the header: "), where, F.lit(": "), quoted(ODD_ROW)))
    fault = fault.when(broken, F.concat(F.lit("a row is not UTF-8: "), where))
    checked = cells.filter(F.when(fault.isNull(), True).otherwise(F.raise_error(fault).cast("boolean")))
    if checked.isEmpty():
        raise InvalidTsv("there are no rows")
    return checked.select(*[_unescape(quoted(n)).alias(n) for n in names]), key


def _unescape(c: Column) -> Column:
    """Cells still in quotes used backslashes; empty cells are null."""
    inside = F.regexp_replace(F.substr(c, F.lit(2), F.length(c) - 2), r"\\(.)", "$1")
    return F.nullif(F.when(is_quoted(c) & c.contains("\\"), inside).otherwise(c), F.lit(""))


def bad_keys(cells: DataFrame, key: str) -> DataFrame:
    """Key values that are blank or occur twice: ``(key_value, rows, problem)``.

    Counted with map-side combining, so a value on every row costs no more.
    """
    c = quoted(key)
    counted = cells.groupBy(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("")).alias("blank"), c.alias("key_value"))
    rows = counted.agg(F.count(F.lit(1)).alias("rows"))
    problem = F.when(F.col("blank") == "", "blank").when(F.col("rows") > 1, "duplicate")
    return rows.withColumn("problem", problem).filter("problem is not null").drop("blank")


def infer_tsv(cells: DataFrame, key: str, ordinal: Column | None = None) -> dict[str, A]:
    """Attribute types of the columns; rows are in the order of ``ordinal``, or else of their files and place in them."""
    if ordinal is None:
        cells, ordinal = in_place(cells, ORDINAL), quoted(ORDINAL)
    kinds = {c: tsv_type(c) for c in cells.columns if c != key and c != ORDINAL}
    return infer_schema(cells, kinds, ordinal)


def typed_cell(c: Column, target: A) -> Column:
    """A TSV cell as a value of its column's type."""
    text = F.when(is_quoted(c), F.substr(c, F.lit(2), F.length(c) - 2)).otherwise(c)
    if target.is_array:
        base = target.stored.base
        values = F.variant_get(tsv_array(c), "$", "array<variant>")
        if base is A.JSON:
            return F.transform(values, lambda v: F.to_json(v))
        texts = F.transform(values, lambda v: F.variant_get(v, "$", "string"))
        return F.transform(texts, lambda t: typed_text(t, base))
    return typed_text(text, target.stored)


def typed_text(c: Column, target: A) -> Column:
    if target is A.JSON:
        return canonical_json(c)
    if target is A.BOOLEAN:
        return F.lower(c) == "true"
    if target is A.DATE_TIME:
        return F.translate(c, "t", "T").cast("timestamp_ntz")
    if target in (A.NUMBER, A.DATE):
        return convert(c, A.STRING, target)
    # a boolean in a column of text is stored in lower case
    return F.when(R.is_boolean(c), F.lower(c)).otherwise(c)


def load_tsv(cells: DataFrame, key: str, schema: dict[str, A] | None = None) -> DataFrame:
    """Typed and tagged records of TSV cells; bad keys are an error.

    Tags are the inferred types: a column of nothing but nulls says so.
    """
    problems = bad_keys(cells, key)
    worst = problems.groupBy("problem").count().collect()
    for row in worst:
        raise InvalidTsv(f"{row['count']} {row['problem']} primary key values in column {key!r}")
    kinds = schema or infer_tsv(cells, key)
    typed = [typed_cell(quoted(n), k).cast(k.stored.spark_type).alias(n) for n, k in kinds.items()]
    records = cells.select(quoted(key), *typed)
    return tag(records, key, kinds)
