"""Filtering, sorting and paging of record tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.constants import DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE, RELATION_SCHEME
from recordloom.errors import InvalidQuery
from recordloom.functions.jsontext import canonical_json
from recordloom.functions.relation import relation_uri
from recordloom.model import AttributeType as A
from recordloom.model import RecordTable, quoted

# Up to this many ids are tested in place; longer lists become a join.
INLINE_IDS = 200
# Pages that start deeper than this are located before anything is sorted.
DEEP_OFFSET = 100_000


# ---- ids -------------------------------------------------------------------


def get_record(table: RecordTable, record_id: str) -> DataFrame:
    return filter_ids(table, [record_id])


def records_exist(table: RecordTable, ids: DataFrame) -> DataFrame:
    """``(record_id, found)`` for each requested id in ``ids.record_id``."""
    keys = table.df.select(quoted(table.primary_key).alias("key"), F.lit(True).alias("hit"))
    asked = ids.select("record_id").distinct()
    joined = asked.join(keys, asked["record_id"] == keys["key"], "left")
    return joined.select("record_id", F.coalesce("hit", F.lit(False)).alias("found"))


def filter_ids(table: RecordTable, ids: Sequence[str] | DataFrame) -> DataFrame:
    """Records with one of the ids; no ids, no records."""
    key, native = quoted(table.primary_key), table.native
    if isinstance(ids, DataFrame):
        if native:
            return native.joined(ids)
        wanted = ids.select(F.col("record_id").alias("__id"))
        return table.df.join(wanted, key == F.col("__id"), "left_semi")
    if not ids:
        return table.df.filter(F.lit(False))
    if len(ids) <= INLINE_IDS:
        return native.among(ids) if native else table.df.filter(key.isin(*ids))
    return filter_ids(table, table.df.sparkSession.createDataFrame([(i,) for i in set(ids)], "record_id string"))


# ---- terms -----------------------------------------------------------------


def term(table: RecordTable, column: str, value) -> Column:
    """Condition that ``column`` matches ``value``, by the column's type.

    Scalars are equal, arrays have an equal element. Text ignores case. In arrays
    of text the *elements* are the patterns: ``%`` and ``_`` in stored data are
    wildcards, in the searched value they are not.
    """
    if column not in table.types:
        raise InvalidQuery(f"{table.name} has no attribute {column!r}")
    kind = table.type(column)
    c = quoted(column)
    if kind in (A.NULL, A.EMPTY_ARRAY):
        return F.lit(False)
    if kind.base in (A.STRING, A.FILE) and kind.is_array:
        wanted = F.lit(str(value).lower())
        # a backslash before an ordinary character means that character
        plain = lambda e: F.regexp_replace(e, r"\\([^%_\\])", "$1")
        return F.exists(c, lambda e: F.call_function("ilike", wanted, plain(e)))
    if kind is A.ARRAY_OF_RELATION:
        wanted = F.lit(str(value).lower())
        return F.exists(c, lambda e: F.lower(F.split_part(e, F.lit("/"), F.lit(3))) == wanted)
    if kind in (A.STRING, A.FILE, A.RELATION):
        return F.lower(c) == str(value).lower()
    if kind.base is A.NUMBER:
        wanted = F.lit(_number(value))
        return _matches(c, kind, lambda e: e.cast("double") == wanted)
    if kind.base is A.JSON:
        wanted = canonical_json(F.lit(_text(value)))
        return _matches(c, kind, lambda e: canonical_json(e) == wanted)
    if kind.base is A.DATE_TIME:
        # as text: a Python date-time would be moved by the driver's own zone
        wanted = F.lit(_date_time(value).isoformat(sep=" ")).cast("timestamp_ntz")
    else:
        wanted = F.lit({A.BOOLEAN: _boolean, A.DATE: _date}[kind.base](value))
    return F.array_contains(c, wanted) if kind.is_array else c == wanted


def _matches(c: Column, kind: A, test) -> Column:
    return F.exists(c, test) if kind.is_array else test(c)


def _text(value) -> str:
    if not isinstance(value, str):
        raise InvalidQuery("a JSON term is given as JSON text")
    return value


def _number(value) -> float:
    try:
        return float(Decimal(str(value)))
    except InvalidOperation:
        raise InvalidQuery(f"not a number: {value!r}") from None


def _boolean(value) -> bool:
    if str(value).lower() not in ("true", "false"):
        raise InvalidQuery(f"neither true nor false: {value!r}")
    return str(value).lower() == "true"


def _date(value) -> date:
    try:
        return value if isinstance(value, date) else date.fromisoformat(value)
    except ValueError:
        raise InvalidQuery(f"not an ISO date: {value!r}") from None


def _date_time(value) -> datetime:
    try:
        found = value if isinstance(value, datetime) else datetime.fromisoformat(value)
    except ValueError:
        raise InvalidQuery(f"not an ISO date-time: {value!r}") from None
    if found.tzinfo is not None:
        raise InvalidQuery("a date-time term carries no zone")
    return found


# ---- sort and page ---------------------------------------------------------


def sort_order(table: RecordTable, sort: str | None, descending: bool) -> list[Column]:
    """Order by one attribute, nulls after all values; ties by primary key."""
    key = quoted(table.primary_key).asc_nulls_last()
    if sort is None or sort == table.primary_key:
        main = quoted(table.primary_key)
        return [main.desc_nulls_first() if descending else main.asc_nulls_last()]
    main = quoted(sort)
    return [main.desc_nulls_first() if descending else main.asc_nulls_last(), key]


def page(
    table: RecordTable,
    df: DataFrame,
    sort: str | None = None,
    descending: bool = False,
    limit: int = DEFAULT_PAGE_SIZE,
    offset: int = 0,
    deep_offset: int = DEEP_OFFSET,
) -> DataFrame:
    """``limit`` records of ``df`` after skipping ``offset`` in sort order."""
    if not 1 <= limit <= MAX_PAGE_SIZE:
        raise InvalidQuery(f"limit must be between 1 and {MAX_PAGE_SIZE}")
    if offset < 0:
        raise InvalidQuery("offset must not be negative")
    if sort is not None and sort not in df.columns:
        raise InvalidQuery(f"{table.name} has no attribute {sort!r}")
    if offset > deep_offset:
        df, offset = _skip_ranges(table, df, sort, descending, offset, deep_offset)
    return df.orderBy(*sort_order(table, sort, descending)).offset(offset).limit(limit)


def _skip_ranges(table, df, sort, descending, offset, enough):
    """Drop whole leading key ranges that lie before a deep page.

    Each round counts the rows of the ranges between sampled keys, keeps those
    from the range holding the offset onwards, and lowers the offset by the rows
    dropped. Only the two sort columns are read, a few counts reach the driver,
    and the page that is finally sorted starts near the front of what is left.
    The sample only decides how much one round can drop, never which rows count.
    """
    key = table.primary_key
    names = [key] if sort in (None, key) else [sort, key]
    flags = [descending if i == 0 else False for i in range(len(names))]
    order = sort_order(table, sort, descending)
    rows = df.count()
    if offset >= rows:
        return df.filter(F.lit(False)), 0
    for _ in range(16):
        if offset <= enough:
            break
        keys = df.select(*[quoted(n).alias(f"k{i}") for i, n in enumerate(names)])
        sampled = keys.sample(min(1.0, 2000 / rows)).limit(10_000)
        splits = sampled.toDF(*names).orderBy(*order).collect()
        step = max(1, len(splits) // 64)
        splits = splits[step::step]
        counts = keys.toDF(*names).agg(
            *[F.count_if(_not_after(names, flags, s)).alias(f"c{i}") for i, s in enumerate(splits)]
        )
        before = list(counts.first()) if splits else []
        usable = [(n, s) for n, s in zip(before, splits, strict=True) if 0 < n <= offset]
        if not usable:
            break
        dropped, split = max(usable, key=lambda p: p[0])
        df = df.filter(~_not_after(names, flags, split))
        offset, rows = offset - dropped, rows - dropped
    return df, offset


def _not_after(names, flags, values) -> Column:
    """Rows sorting at or before ``values``: never null, nulls last (first if descending)."""
    condition = F.lit(True)
    for name, descending, value in reversed(list(zip(names, flags, values, strict=True))):
        c = quoted(name)
        if value is None:
            same, less = c.isNull(), (F.lit(False) if descending else c.isNotNull())
        else:
            v = F.lit(value)
            same = F.coalesce(c == v, F.lit(False))
            less = F.coalesce(c > v, F.lit(True)) if descending else F.coalesce(c < v, F.lit(False))
        condition = less | (same & condition)
    return condition


def search(
    table: RecordTable,
    ids: Sequence[str] | None = None,
    where: tuple[str, object] | None = None,
    sort: str | None = None,
    descending: bool = False,
    limit: int = DEFAULT_PAGE_SIZE,
    offset: int = 0,
) -> DataFrame:
    """One page of the records that pass both the id list and the term."""
    df = table.df if ids is None else filter_ids(table, ids)
    if where is not None:
        df = df.filter(term(table, *where))
    return page(table, df, sort, descending, limit, offset)


def search_with_total(table: RecordTable, **request) -> DataFrame:
    """A page whose rows also carry the *unfiltered* number of records."""
    total = count_records(table).scalar()
    return search(table, **request).withColumn("total_records", total)


def count_records(table: RecordTable) -> DataFrame:
    return table.df.agg(F.count(F.lit(1)).alias("total_records"))


def scan_ordered(table: RecordTable) -> DataFrame:
    """All records by primary key, as a range-partitioned sort."""
    return table.df.orderBy(quoted(table.primary_key).asc_nulls_last())


# ---- reading ---------------------------------------------------------------


def read_records(table: RecordTable) -> DataFrame:
    """Records as callers see them: key first, relations as URIs."""
    targets = table.relations
    columns = []
    for name in [n for n in table.attributes if n in table.df.columns]:
        c = quoted(name)
        if table.type(name) is A.RELATION:
            # relation columns store the bare id
            uri = relation_uri(targets[name], c)
            c = F.when(c.startswith(RELATION_SCHEME), c).otherwise(uri).alias(name)
        columns.append(c)
    return table.df.select(*columns)
