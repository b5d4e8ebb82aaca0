"""Schema operators over record tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions import infer
from recordloom.model import AttributeType as A
from recordloom.model import RecordTable, tag
from recordloom.operators import catalog as C
from recordloom.operators import evolve as E
from recordloom.operators.inference import infer_schema
from recordloom.operators.integrity import relation_pairs
from recordloom.operators.write import upsert
from recordloom.plans.inferring import tsv_cells
from recordloom.plans.registry import query
from recordloom.plans.star import JSON_COLUMNS, RECORD_TABLES, raw, records, star
from recordloom.sources.tsv import typed_cell

_SQL_NUMBER = "rtrim(rtrim(CAST(CAST({} AS DECIMAL(38,6)) AS VARCHAR), '0'), '.')"


@query(
    "create_type",
    """SELECT CAST(event_id AS VARCHAR) event_id, value, user_id AS who,
              CASE event_type WHEN 'view' THEN 'true' WHEN 'click' THEN 'false' END AS seen FROM events""",
)
def create_type(spark, sf):
    """A new type with an inferred schema, and the records it was inferred from."""
    events = raw(spark, sf, "events")
    cells = events.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("event_id").alias("seq"),
        F.col("value").cast("string").alias("value"), F.col("user_id").cast("string").alias("who"),
        F.when(F.col("event_type") == "view", "TRUE").when(F.col("event_type") == "click", "false").alias("seen"),
    )
    schema = infer_schema(cells, {c: infer.tsv_type(c) for c in ("value", "who", "seen")}, F.col("seq"))
    table = E.create_type(spark, "event", schema, "event_id")
    typed = cells.select("event_id", *[typed_cell(F.col(n), k).alias(n) for n, k in schema.items()])
    state = upsert(table, typed)
    return state.select("event_id", F.col("value").cast("double").alias("value"), F.col("who").cast("long").alias("who"),
                        F.col("seen").cast("string").alias("seen"))


@query(
    "schema_diff",
    """SELECT 'mixed' AS attribute, 'differs' AS change, 'NUMBER' AS existing_type, 'DATE' AS incoming_type, (SELECT count(*) FROM events) AS records
       UNION ALL SELECT 'named', 'differs', 'RELATION', 'STRING', (SELECT count(*) FROM events)
       UNION ALL SELECT 'listed', 'differs', 'ARRAY_OF_NUMBER', 'ARRAY_OF_BOOLEAN', (SELECT count(*) FROM events)
       UNION ALL SELECT 'more', 'new', NULL, 'ARRAY_OF_STRING', (SELECT count(*) FROM events)""",
)
def schema_diff(spark, sf):
    """What the sign-ups would change in a table made from the views."""
    cells = tsv_cells(raw(spark, sf, "events"))

    def schema_of(event, names):
        rows = cells.filter(F.col("event_type") == event)
        return infer_schema(rows, {n: infer.tsv_type(n) for n in names}, F.col("event_id"))

    existing = schema_of("view", ("mixed", "named", "listed"))
    diff = E.schema_diff(existing, schema_of("signup", ("mixed", "named", "listed", "more")))
    rows = [(n, "new", None, t.value) for n, t in diff.only_new.items()]
    rows += [(n, "differs", a.value, b.value) for n, (a, b) in diff.differing.items()]
    described = [
        F.struct(*[F.lit(v).cast("string").alias(k) for k, v in
                   zip(("attribute", "change", "existing_type", "incoming_type"), r, strict=True)])
        for r in rows
    ]
    counted = cells.agg(F.count(F.lit(1)).alias("records"))
    return counted.select("records", F.inline(F.array(*described)))


@query(
    "add_columns",
    """SELECT CAST(c_custkey AS VARCHAR) c_custkey, c_name, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS VARCHAR) AS score
       FROM customer""",
)
def add_columns(spark, sf):
    table = E.add_columns(records(spark, sf, "customer"), {"note": A.STRING, "score": A.NUMBER})
    return table.df.select("c_custkey", "c_name", "note", F.col("score").cast("string").alias("score"))


@query(
    "widen_column",
    f"""SELECT CAST(o_orderkey AS VARCHAR) o_orderkey, strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS day,
               {_SQL_NUMBER.format("o_totalprice")} AS price FROM orders""",
)
def widen_column(spark, sf):
    """A date column meets date-times, a number column meets text."""
    orders = records(spark, sf, "orders")
    df = orders.df.select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_totalprice").cast("decimal(38,18)").alias("price"),
    )
    table = E.evolve(orders.with_df(df), {"day": A.DATE_TIME, "price": A.STRING})
    return table.df.select("o_orderkey", F.col("day").cast("string").alias("day"), "price")


@query("rename_attr", "SELECT CAST(c_custkey AS VARCHAR) c_custkey, c_name AS \"full name\", c_acctbal FROM customer")
def rename_attr(spark, sf):
    table = E.rename_attribute(records(spark, sf, "customer"), "c_name", "full name")
    return table.df.select("c_custkey", "full name", "c_acctbal")


@query("drop_attr", "SELECT CAST(s_suppkey AS VARCHAR) s_suppkey, CAST(s_nationkey AS VARCHAR) s_nationkey, s_name FROM supplier")
def drop_attr(spark, sf):
    return E.drop_attribute(records(spark, sf, "supplier"), "s_acctbal").df


def _described(name: str) -> str:
    """SQL for the description of a table, from the catalog of its columns."""
    key, relations = RECORD_TABLES[name]
    edges = {"orders": ("parts", "suppliers"), "customer": ("orders",)}.get(name, ())
    targets = {**relations, **{"parts": "part", "suppliers": "supplier", "orders": "orders"}}
    extra = "".join(f" UNION ALL SELECT '{e}', 'ARRAY_OF_RELATION', '{targets[e]}'" for e in edges)
    cases = "".join(f" WHEN column_name = '{c}' THEN 'RELATION'" for c in relations)
    cases += "".join(f" WHEN column_name = '{c}' THEN 'JSON'" for c in JSON_COLUMNS.get(name, ()))
    pointed = " ".join(f"WHEN column_name = '{c}' THEN '{t}'" for c, t in relations.items())
    target = f"CASE {pointed} END" if pointed else "NULL"
    return f"""SELECT '{name}' AS record_type, '{key}' AS primary_key, (SELECT count(*) FROM {name}) AS record_count,
        CAST(row_number() OVER (ORDER BY attribute <> '{key}', attribute) - 1 AS INTEGER) AS position,
        attribute, attribute_type, relation_target FROM (
          SELECT column_name AS attribute, CASE WHEN column_name = '{key}' THEN 'STRING' {cases}
            WHEN column_type LIKE '%[]' THEN 'ARRAY_OF_NUMBER' WHEN column_type = 'VARCHAR' THEN 'STRING'
            WHEN column_type LIKE 'TIMESTAMP%' THEN 'DATE_TIME' ELSE 'NUMBER' END AS attribute_type,
            {target} AS relation_target FROM (DESCRIBE {name}) {extra})"""


@query("describe_type", _described("orders"))
def describe_type(spark, sf):
    return E.describe_type(star(spark, sf)["orders"])


@query("describe_types", " UNION ALL ".join(f"({_described(n)})" for n in RECORD_TABLES))
def describe_types(spark, sf):
    return E.describe_types(star(spark, sf))


@query(
    "list_types",
    """SELECT DISTINCT source || '_' || lang AS record_type, count(*) AS records FROM documents
       WHERE source <> 'src1' GROUP BY ALL""",
)
def list_types(spark, sf):
    """Types found in a catalog of documents; those of a reserved name are hidden."""
    documents = raw(spark, sf, "documents")
    kind = F.concat("source", F.lit("_"), "lang")
    kind = F.when(F.col("source") == "src1", F.concat(F.lit("sys_"), kind)).otherwise(kind)
    catalog = documents.groupBy(kind.alias("record_type")).agg(F.count(F.lit(1)).alias("records"))
    return E.visible_types(catalog)


@query(
    "list_relations",
    """SELECT 'nation' AS record_type, 'n_regionkey' AS relation, 'region' AS target, false AS is_array, count(*) AS pairs FROM nation
       UNION ALL SELECT 'customer', 'c_nationkey', 'nation', false, count(*) FROM customer
       UNION ALL SELECT 'customer', 'orders', 'orders', true, count(*) FROM orders
       UNION ALL SELECT 'supplier', 's_nationkey', 'nation', false, count(*) FROM supplier
       UNION ALL SELECT 'orders', 'o_custkey', 'customer', false, count(*) FROM orders
       UNION ALL SELECT 'orders', 'parts', 'part', true, count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
       UNION ALL SELECT 'orders', 'suppliers', 'supplier', true, count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)""",
)
def list_relations(spark, sf):
    """All relations, with how many pairs of records each holds."""
    tables = star(spark, sf)
    listed = None
    for t in tables.tables.values():
        for relation, target in t.relations.items():
            pairs = relation_pairs(t, relation).agg(F.count(F.lit(1)).alias("pairs"))
            one = pairs.select(
                F.lit(t.name).alias("record_type"), F.lit(relation).alias("relation"), F.lit(target).alias("target"),
                F.lit(t.type(relation).is_array).alias("is_array"), "pairs",
            )
            listed = one if listed is None else listed.unionByName(one)
    return listed


@query(
    "drop_type",
    """SELECT 'customer' AS record_type, count(*) AS records FROM customer UNION ALL SELECT 'nation', count(*) FROM nation
       UNION ALL SELECT 'region', count(*) FROM region""",
)
def drop_type(spark, sf):
    """What is left of the order tables after the orders, and their edges, are dropped."""
    tables = star(spark, sf)
    customer = tables["customer"]
    kept = {n: tables[n] for n in ("region", "nation", "orders")}
    rest = E.drop_type(
        type(tables)({**kept, "customer": RecordTable("customer", customer.df, customer.primary_key)}), "orders"
    )
    counts = None
    for name in rest.record_types():
        one = rest[name].df.agg(F.count(F.lit(1)).alias("records")).withColumn("record_type", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    return counts


_CATALOG = "(SELECT md5(CAST(c_custkey AS VARCHAR)) AS id, md5(c_mktsegment) AS workspace_id, c_name AS name, c_mktsegment AS description FROM customer)"


def _catalog(spark, sf):
    customer = raw(spark, sf, "customer")
    return customer.select(
        F.md5(F.col("c_custkey").cast("string")).alias("id"), F.md5("c_mktsegment").alias("workspace_id"),
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"),
    )


@query("list_collections", f"SELECT * FROM {_CATALOG} WHERE workspace_id = md5('BUILDING') ORDER BY name, id")
def list_collections(spark, sf):
    import hashlib

    return C.collections_of(_catalog(spark, sf), hashlib.md5(b"BUILDING").hexdigest())


@query(
    "default_collections",
    f"""SELECT id, workspace_id, name, description FROM (SELECT * FROM {_CATALOG} UNION ALL
          SELECT DISTINCT md5(c_mktsegment), md5(c_mktsegment), 'default', 'default' FROM customer) WHERE id = workspace_id""",
)
def default_collections(spark, sf):
    """Every workspace is given its default collection."""
    catalog = _catalog(spark, sf)
    return C.default_collections(C.ensure_defaults(catalog, catalog))


@query(
    "find_collections",
    f"""SELECT id, workspace_id, name, description FROM {_CATALOG} WHERE name IN (SELECT c_name FROM customer WHERE c_acctbal < 0)""",
)
def find_collections(spark, sf):
    """Collections of customers in debt; asked for in a wrong workspace, others are not found."""
    customer = raw(spark, sf, "customer")
    workspace = F.when(F.col("c_acctbal") < 0, F.md5("c_mktsegment")).otherwise("elsewhere")
    wanted = customer.select(workspace.alias("workspace_id"), F.md5(F.col("c_custkey").cast("string")).alias("id"))
    return C.find_collections(_catalog(spark, sf), wanted)


@query(
    "case_sensitive_names",
    "SELECT CAST(c_custkey AS VARCHAR) c_custkey, c_name AS note, c_mktsegment AS \"Note2\" FROM customer",
)
def case_sensitive_names(spark, sf):
    """Attributes that differ in case only stay apart."""
    table = records(spark, sf, "customer")
    df = tag(table.df.select("c_custkey", F.col("c_name").alias("note"), F.col("c_mktsegment").alias("Note")), "c_custkey")
    renamed = E.rename_attribute(table.with_df(df), "Note", "Note2")
    return renamed.df


@query(
    "relation_validate",
    """SELECT DISTINCT 'o_orderstatus' AS attribute, 'exists and is no relation' AS problem FROM orders
       UNION ALL SELECT DISTINCT 'fresh', 'refers to more than one record type' FROM orders
       UNION ALL SELECT DISTINCT 'listed', 'holds arrays of more than one record type' FROM orders
       UNION ALL SELECT DISTINCT 'o_custkey', 'refers to more than one record type' FROM orders""",
)
def relation_validate(spark, sf):
    """What is wrong with relation values that arrive for the orders."""
    from recordloom.functions.relation import relation_uri
    from recordloom.operators.inference import relation_targets
    from recordloom.operators.integrity import relation_problems

    orders = records(spark, sf, "orders")
    c = F.col("o_custkey")
    kind = F.when(F.col("o_orderstatus") == "F", "part").otherwise("supplier")
    arriving = orders.df.select(
        relation_uri("customer", c).alias("good"), relation_uri("part", c).alias("o_custkey"),
        relation_uri("part", c).alias("o_orderstatus"), relation_uri(kind, c).alias("fresh"),
        F.array(relation_uri("part", c), relation_uri("customer", c)).alias("listed"),
    )
    kinds = {n: A.ARRAY_OF_RELATION if n == "listed" else A.RELATION for n in arriving.columns}
    return relation_problems(orders, relation_targets(arriving, kinds))
