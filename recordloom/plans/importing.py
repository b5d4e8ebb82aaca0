"""TSV, JSON operations, nested rows and manifests, made from the tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from recordloom.constants import MANIFEST_DEFAULT_KEY, RELATION_SCHEME
from recordloom.model import RecordTable, tag
from recordloom.plans.registry import query
from recordloom.plans.star import raw, records
from recordloom.session import shared_dir
from recordloom.sinks.export import write_counts, write_tsv
from recordloom.sources import manifest as M
from recordloom.sources import nested as N
from recordloom.sources import operations as O
from recordloom.sources import tsv as T


def scratch(spark, name: str) -> str:
    """A fresh folder for one run, where all executors can reach it."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- TSV -------------------------------------------------------------------

_SQL_NUMBER = "rtrim(rtrim(CAST(CAST({} AS DECIMAL(38,6)) AS VARCHAR), '0'), '.')"


@query(
    "tsv_scan",
    f"""SELECT CAST(c_custkey AS VARCHAR) c_custkey, {_SQL_NUMBER.format("c_acctbal")} AS c_acctbal, c_mktsegment,
          'say "' || c_name || '"' || chr(9) || chr(10) || 'bye' AS c_name FROM customer""",
)
def tsv_scan(spark, sf):
    """Customers written as TSV and read back; names hold quotes, a tab and a newline."""
    table = records(spark, sf, "customer")
    name = F.concat(F.lit('say "'), F.col("c_name"), F.lit('"\t\nbye'))
    table = table.with_df(tag(table.df.drop("c_nationkey").withColumn("c_name", name), "c_custkey"))
    path = scratch(spark, "tsv")
    write_tsv(table, path)
    cells, _ = T.read_tsv(spark, path, multi_line=True)
    return cells


@query(
    "tsv_infer_files",
    """SELECT unnest(['later', 'sooner', 'value']) AS attribute, unnest(['DATE_TIME', 'STRING', 'NUMBER']) AS attribute_type
       FROM (SELECT count(*) AS n FROM events) WHERE n > 1""",
)
def tsv_infer_files(spark, sf):
    """Types of a column over two folders of files: the first by name, which is the smaller one, has the dates or the date-times."""
    events = raw(spark, sf, "events")
    day, stamp = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    path = scratch(spark, "tsv-files")
    first = F.col("event_id") % 100 == 0
    for name, part, early, late in (("a", events.where(first), day, stamp), ("b", events.where(~first), stamp, day)):
        cells = part.select(F.col("event_id").cast("string").alias("id"), early.alias("later"), late.alias("sooner"), F.col("value").cast("string").alias("value"))
        cells.write.option("sep", "\t").option("header", True).csv(f"{path}/{name}")
    cells, key = T.read_tsv(spark, [f"{path}/a", f"{path}/b"])
    kinds = T.infer_tsv(cells, key)
    return spark.createDataFrame([(n, k.value) for n, k in kinds.items()], "attribute string, attribute_type string")


@query(
    "tsv_load",
    """SELECT CAST(event_id AS VARCHAR) event_id, CASE event_type WHEN 'view' THEN value END AS number,
         CASE event_type WHEN 'click' THEN strftime(ts, '%Y-%m-%d') END AS day,
         CASE event_type WHEN 'view' THEN 'true' WHEN 'click' THEN 'false' END AS flag,
         '[' || CAST(user_id AS VARCHAR) || ',null]' AS numbers, '{"a":"' || event_type || '","b":1}' AS doc
       FROM events""",
)
def tsv_load(spark, sf):
    """Cells typed by their inferred columns."""
    e = F.col("event_type")
    cells = raw(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(e == "view", F.col("value").cast("string")).alias("number"),
        F.when(e == "click", F.date_format("ts", "yyyy-MM-dd")).alias("day"),
        F.when(e == "view", "TRUE").when(e == "click", "false").alias("flag"),
        F.concat(F.lit("["), F.col("user_id"), F.lit(", null]")).alias("numbers"),
        F.concat(F.lit('{"b": 1.0, "a": "'), e, F.lit('"}')).alias("doc"),
    )
    loaded = T.load_tsv(cells, "event_id")
    numbers = F.transform("numbers", lambda n: n.cast("long").cast("string"))
    return loaded.select(
        "event_id", F.col("number").cast("double").alias("number"), F.col("day").cast("string").alias("day"),
        F.col("flag").cast("string").alias("flag"),
        F.concat(F.lit("["), F.array_join(numbers, ",", "null"), F.lit("]")).alias("numbers"), "doc",
    )


@query(
    "tsv_bad_keys",
    """SELECT k AS key_value, count(*) AS rows, CASE WHEN k IS NULL OR trim(k) = '' THEN 'blank' ELSE 'duplicate' END AS problem
       FROM (SELECT CASE o_orderstatus WHEN 'P' THEN '  ' ELSE CAST(o_custkey AS VARCHAR) END AS k FROM orders)
       GROUP BY k HAVING count(*) > 1 OR k IS NULL OR trim(k) = ''""",
)
def tsv_bad_keys(spark, sf):
    orders = records(spark, sf, "orders").df
    key = F.when(F.col("o_orderstatus") == "P", "  ").otherwise(F.col("o_custkey"))
    return T.bad_keys(orders.select(key.alias("key"), "o_totalprice"), "key")


@query(
    "tsv_json_equivalence",
    """SELECT event_id, true AS same_number, true AS same_text, true AS same_list FROM events""",
)
def tsv_json_equivalence(spark, sf):
    """A value means the same as a TSV cell and in a JSON operation."""
    from recordloom.functions.infer import json_type, tsv_type

    events = raw(spark, sf, "events")
    value, day = F.col("value").cast("string"), F.date_format("ts", "yyyy-MM-dd")
    listed = F.concat(F.lit("["), value, F.lit(",null]"))
    cells = events.select(
        "event_id", value.alias("number"), day.alias("text"), listed.alias("list"),
        F.concat(F.lit('"'), day, F.lit('"')).alias("quoted"),
    )
    return cells.select(
        "event_id",
        (tsv_type("number") == json_type(F.parse_json("number"))).alias("same_number"),
        (tsv_type("text") == json_type(F.parse_json("quoted"))).alias("same_text"),
        (tsv_type("list") == json_type(F.parse_json("list"))).alias("same_list"),
    )


# ---- JSON operations -------------------------------------------------------


def _operation_lines(spark, sf):
    e = F.col("event_type")
    op = F.when(e == "error", "DELETE").otherwise("upsert")
    attributes = F.when(e == "view", F.concat(F.lit('{"value":'), F.col("value"), F.lit("}"))).when(
        e == "click", F.concat(F.lit('{"value":null,"props":'), F.col("props"), F.lit("}"))
    ).otherwise(F.lit("{}"))
    line = F.concat(
        F.lit('{"operation":"'), op, F.lit('","record":{"id":"'), F.col("user_id"),
        F.lit('","type":"user","attributes":'), attributes, F.lit("}}"),
    )
    return raw(spark, sf, "events").select("event_id", line.alias("line"))


@query(
    "json_ops",
    """SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'delete' ELSE 'upsert' END AS operation,
         CAST(user_id AS VARCHAR) record_id, 'user' AS type,
         CASE event_type WHEN 'view' THEN 'value' WHEN 'click' THEN 'props,value' ELSE '' END AS given,
         CASE event_type WHEN 'view' THEN value END AS value, CASE event_type WHEN 'click' THEN props END AS props
       FROM events""",
)
def json_ops(spark, sf):
    ops = O.parse_operations(_operation_lines(spark, sf), "line", "event_id")
    a = F.col("attributes")
    return ops.select(
        "seq", "operation", "record_id", "type",
        F.array_join(F.array_sort(F.map_keys(a)), ",").alias("given"),
        F.variant_get(a["value"], "$", "double").alias("value"),
        F.replace(F.variant_get(a["props"], "$", "string"), F.lit(":"), F.lit(": ")).alias("props"),
    )


@query("json_ops_infer", "SELECT DISTINCT 'value' AS attribute, 'NUMBER' AS attribute_type FROM events UNION ALL SELECT DISTINCT 'props', 'JSON' FROM events")
def json_ops_infer(spark, sf):
    ops = O.parse_operations(_operation_lines(spark, sf), "line", "event_id")
    return O.infer_operations(ops)


@query(
    "json_ops_scan",
    """SELECT CASE event_type WHEN 'error' THEN 'delete' ELSE 'upsert' END AS operation, CAST(user_id AS VARCHAR) record_id, count(*) AS n
       FROM events GROUP BY ALL""",
)
def json_ops_scan(spark, sf):
    """The operations written as lines of JSON and read back."""
    path = scratch(spark, "ops")
    _operation_lines(spark, sf).select("line").write.mode("overwrite").text(path)
    ops = O.read_operations(spark, path, multi_line=False)
    return ops.groupBy("operation", "record_id").agg(F.count(F.lit(1)).alias("n"))


# ---- nested rows -----------------------------------------------------------


def nested_rows(spark, sf):
    """Customers and orders in one nested table, with their relations."""
    customer, orders, nation = (raw(spark, sf, t) for t in ("customer", "orders", "nation"))
    fields = "struct<label:string,amount:double,tags:array<struct<element:string>>,extra:map<string,string>,consent:string,snapshot:string>"

    def rows(df, key, name, label, amount, tags, consent, snapshot, *relations):
        obj = F.struct(
            label, amount, F.transform(F.array(*tags), lambda t: F.struct(t.alias("element"))).alias("tags"),
            F.create_map(F.lit("k"), label).alias("extra"), consent.alias("consent"), snapshot.alias("snapshot"),
        ).cast(fields)
        links = F.array(*[
            F.struct(c.cast("string").alias("dst_id"), F.lit(t).alias("dst_name")) for c, t in relations
        ]) if relations else F.array().cast("array<struct<dst_id:string,dst_name:string>>")
        return df.select(F.col(key).cast("string").alias("id"), F.lit(name).alias("name"), obj.alias("object"), links.alias("relations"))

    digest = F.md5(F.col("c_nationkey").cast("string"))
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    snapshot = F.when(F.col("c_mktsegment") == "BUILDING", uuid).otherwise("not-an-id")
    none = F.lit(None).cast("string")
    return (
        rows(customer, "c_custkey", "customer", F.col("c_name"), F.col("c_acctbal"), [F.col("c_mktsegment")],
             F.when(F.col("c_acctbal") < 0, "").otherwise("NRES"), snapshot, (F.col("c_nationkey"), "nation"))
        .unionByName(rows(orders, "o_orderkey", "orders", F.col("o_orderstatus"),
                          F.when(F.col("o_orderstatus") == "P", F.lit(float("nan"))).otherwise(F.col("o_totalprice")),
                          [F.col("o_orderstatus"), F.col("o_orderpriority")], F.col("o_orderstatus"), none,
                          (F.col("o_orderkey"), "customer"), (F.col("o_custkey"), "customer")))
        .unionByName(rows(nation, "n_nationkey", "nation", F.col("n_name"), F.lit(1.5), [], none, none))
    )


@query(
    "nested_base",
    """SELECT CAST(o_orderkey AS VARCHAR) id, o_orderstatus AS label, CASE o_orderstatus WHEN 'P' THEN NULL ELSE o_totalprice END AS amount,
         o_orderstatus || ',' || o_orderpriority AS tags, '{"k":"' || o_orderstatus || '"}' AS extra, o_orderstatus AS consent FROM orders""",
)
def nested_base(spark, sf):
    """Base attributes: NaN is null, maps are JSON, element records are unwrapped."""
    found = N.base_records(nested_rows(spark, sf), "orders")
    return found.select("id", "label", "amount", F.array_join("tags", ",").alias("tags"), "extra", "consent")


@query(
    "import_base",
    "SELECT CAST(o_orderkey AS VARCHAR) o_orderkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) o_orderdate, o_orderpriority FROM orders",
)
def import_base(spark, sf):
    orders = records(spark, sf, "orders")
    relations = [c for c in orders.relations if c in orders.df.columns]
    return M.base_columns(orders.df, relations).withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query(
    "import_relations",
    "SELECT CAST(o_orderkey AS VARCHAR) id, CAST(o_custkey AS VARCHAR) customer FROM orders",
)
def import_relations(spark, sf):
    """Of an order's two customer relations the last is kept."""
    return N.relation_records(nested_rows(spark, sf), "orders", ["customer", "part"]).select("id", "customer")


@query(
    "import_relation_uris",
    f"""SELECT CAST(o_orderkey AS VARCHAR) o_orderkey, rel || o_custkey AS o_custkey, rel || o_custkey || ',' || rel || o_orderkey AS both
        FROM orders, (SELECT '{RELATION_SCHEME}/customer/' AS rel)""",
)
def import_relation_uris(spark, sf):
    orders = raw(spark, sf, "orders").select("o_orderkey", "o_custkey", F.array("o_custkey", "o_orderkey").alias("both"))
    uris = N.relation_uris(orders, {"o_custkey": "customer", "both": "customer"})
    return uris.select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_custkey", F.array_join("both", ",").alias("both"))


@query(
    "import_two_pass",
    """SELECT CAST(o_orderkey AS VARCHAR) id, o_orderstatus AS label, CAST(o_custkey AS VARCHAR) customer,
              o_custkey IN (SELECT c_custkey FROM customer) AS resolves FROM orders""",
)
def import_two_pass(spark, sf):
    """Base attributes, then relations to records that may come later in the input."""
    from recordloom.operators.write import upsert

    rows = nested_rows(spark, sf)
    base = N.base_records(rows, "orders").select("id", "label")
    both = upsert(RecordTable("orders", base, "id"), N.relation_records(rows, "orders", ["customer"]))
    customers = N.base_records(rows, "customer").select(F.col("id").alias("known"))
    joined = both.join(customers, F.col("customer") == F.col("known"), "left")
    return joined.select("id", "label", "customer", F.col("known").isNotNull().alias("resolves"))


@query(
    "nested_import",
    """SELECT 'orders' AS record_type, CAST(o_orderkey AS VARCHAR) id, o_orderstatus AS label, c_name AS reached, n_name AS "further",
              'amount,consent,customer,extra,label,tags' AS attributes, (SELECT count(*) FROM orders) AS written
       FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
       UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_name, n_name, NULL,
              'amount,consent,extra,label,nation,snapshot,tags', (SELECT count(*) FROM customer)
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
       UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_name, NULL, NULL, 'amount,extra,label,tags', (SELECT count(*) FROM nation) FROM nation""",
)
def nested_import(spark, sf):
    """A nested file of three types, loaded as one collection; its records, what they lead to, and their types' attributes."""
    from recordloom.operators.expressions import evaluate, this

    path = scratch(spark, "nested-file")
    nested_rows(spark, sf).write.parquet(path)
    tables, written = N.load_nested(N.read_nested(spark, path, "parquet"))
    paths = {
        "orders": (this("customer", "label"), this("customer", "nation", "label")), "customer": (this("nation", "label"), None), "nation": (None, None),
    }
    out = None
    for name, (reached, further) in paths.items():
        rows = evaluate(tables, name, {"label": this("label"), "reached": reached, "further": further})
        # text as JSON: the names have no quotes in them
        plain = [F.nullif(F.translate(c, '"', ""), F.lit("null")).alias(c) for c in ("label", "reached", "further")]
        one = rows.select(
            F.lit(name).alias("record_type"), F.col("record_id").alias("id"), *plain,
            F.lit(",".join(c for c in tables[name].attributes if c != "id")).alias("attributes"), F.lit(written[name]).cast("long").alias("written"),
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "list_unwrap",
    """SELECT CAST(o_orderkey AS VARCHAR) id, o_orderstatus || ',' || o_orderpriority AS tags FROM orders
       UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_mktsegment FROM customer UNION ALL SELECT CAST(n_nationkey AS VARCHAR), '' FROM nation""",
)
def list_unwrap(spark, sf):
    rows = nested_rows(spark, sf).select("id", "object.tags")
    tags, _ = N.unwrap_list(F.col("tags"), rows.schema["tags"].dataType, "tags")
    return rows.select("id", F.array_join(tags, ",").alias("tags"))


@query(
    "import_convert",
    """SELECT event_id, CASE event_type WHEN 'view' THEN NULL ELSE value END AS number, strftime(ts, '%Y-%m-%d') AS day,
         strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS stamp, strftime(ts, '%H:%M:%S') AS clock, '{"a":' || user_id || ',"b":"' || event_type || '"}' AS doc,
         '[' || ascii(event_type) || ', ' || ascii(substr(event_type, 2)) || ', -1]' AS bytes,
         '1.5' AS float FROM events""",
)
def import_convert(spark, sf):
    """Nested and physical values as record values."""
    e = F.col("event_type")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = raw(spark, sf, "events").select(
        "event_id",
        F.when(e == "view", F.lit(float("nan"))).otherwise(F.col("value")).alias("number"),
        N.date_value(F.floor(micros / 86_400_000_000)).alias("day"),
        N.date_time_value(micros).alias("stamp"),
        N.time_value(F.floor(micros / 1_000_000) % 86_400 * 1_000_000).alias("clock"),
        F.struct(F.col("user_id").alias("a"), e.alias("b")).alias("doc"),
        F.concat(F.substring(e, 1, 2).cast("binary"), F.unhex(F.lit("FF"))).alias("bytes"),
        F.lit(1.5).cast("float").alias("float"),
    )
    out = N.convert_columns(rows)
    return out.select(
        "event_id", "number", F.col("day").cast("string").alias("day"),
        F.date_format("stamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("stamp"), "clock", "doc", "bytes",
        F.col("float").cast("string").alias("float"),
    )


@query(
    "import_metadata",
    """SELECT CAST(c_custkey AS VARCHAR) c_custkey, c_name, '2024-05-06T07:08:09' AS "import:timestamp", md5(c_mktsegment) AS "import:snapshot_id"
       FROM customer""",
)
def import_metadata(spark, sf):
    df = records(spark, sf, "customer").df
    stamped = N.with_import_metadata(df, F.md5("c_mktsegment"), F.lit("2024-05-06 07:08:09").cast("timestamp_ntz"))
    return stamped.select("c_custkey", "c_name", "`import:timestamp`", "`import:snapshot_id`")


@query(
    "distinct_uuids",
    """SELECT DISTINCT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS snapshot_id
       FROM (SELECT md5(CAST(c_nationkey AS VARCHAR)) h FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def distinct_uuids(spark, sf):
    return N.snapshot_ids(nested_rows(spark, sf), "snapshot")


@query(
    "all_match_gate",
    """SELECT 'customer' AS kind, count(*) AS groups, count(*) > 0 AS all_open FROM customer WHERE c_acctbal >= 0
       UNION ALL SELECT 'orders', count(*), false FROM orders UNION ALL SELECT 'nation', 0, false""",
)
def all_match_gate(spark, sf):
    rows = nested_rows(spark, sf)
    gates = [N.consent_gate(rows, t, "consent").withColumn("kind", F.lit(t)) for t in ("customer", "orders", "nation")]
    return gates[0].unionByName(gates[1]).unionByName(gates[2])


# ---- manifests -------------------------------------------------------------


def manifests(spark, sf):
    """A manifest per order: an order table, and a customer table with one, two or no keys."""
    s = F.col("o_orderstatus")
    keys = F.when(s == "F", F.array(F.lit("c_custkey"))).when(s == "O", F.array(F.lit("c_custkey"), F.lit("c_name")))
    columns = F.array(F.struct(F.lit("c").alias("name"), F.lit("string").alias("datatype"), F.lit(False).alias("array_of")))

    def table(name, primary):
        return F.struct(F.lit(name).alias("name"), primary.cast("array<string>").alias("primaryKey"), columns.alias("columns"))

    def relation(name, column, to_column):
        source = F.struct(F.lit("orders").alias("table"), F.lit(column).alias("column"))
        target = F.struct(F.lit("customer").alias("table"), F.lit(to_column).alias("column"))
        return F.struct(F.lit(name).alias("name"), source.alias("from"), target.alias("to"))

    tables = F.array(table("orders", F.array(F.lit("o_orderkey"))), table("customer", keys))
    relations = F.array(relation("buyer", "o_custkey", "c_custkey"), relation("row", "o_rowid", MANIFEST_DEFAULT_KEY))
    paths = F.array(F.concat(F.lit("part-"), F.col("o_orderkey"), F.lit(".parquet")))
    files = F.array(
        F.struct(F.lit("orders").alias("name"), paths.alias("paths")),
        F.struct(F.lit("stray").alias("name"), paths.alias("paths")),
    )
    snapshot = F.struct(F.col("o_orderkey").cast("string").alias("id"), tables.alias("tables"), relations.alias("relationships"))
    location = F.struct(F.struct(F.struct(files.alias("tables")).alias("location")).alias("parquet"))
    return raw(spark, sf, "orders").select(snapshot.alias("snapshot"), location.alias("format"))


@query(
    "manifest_pk",
    f"""SELECT CAST(o_orderkey AS VARCHAR) snapshot_id, 'orders' AS "table", 'o_orderkey' AS primary_key FROM orders
        UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'customer', CASE o_orderstatus WHEN 'F' THEN 'c_custkey' ELSE '{MANIFEST_DEFAULT_KEY}' END FROM orders""",
)
def manifest_pk(spark, sf):
    return M.manifest_keys(manifests(spark, sf))


@query(
    "manifest_tables",
    """SELECT CAST(o_orderkey AS VARCHAR) snapshot_id, t AS "table", 'part-' || o_orderkey || '.parquet' AS paths,
         CASE t WHEN 'orders' THEN 'o_orderkey' END AS primary_key FROM orders, (SELECT unnest(['orders', 'stray']) AS t)""",
)
def manifest_tables(spark, sf):
    found = M.manifest_tables(manifests(spark, sf))
    return found.withColumn("paths", F.array_join("paths", ","))


@query(
    "manifest_relations",
    f"""SELECT CAST(o_orderkey AS VARCHAR) snapshot_id, 'orders' AS from_table, 'customer' AS to_table,
          CASE o_orderstatus WHEN 'F' THEN 'o_custkey' ELSE 'o_rowid' END AS from_column,
          CASE o_orderstatus WHEN 'F' THEN 'c_custkey' ELSE '{MANIFEST_DEFAULT_KEY}' END AS to_column FROM orders""",
)
def manifest_relations(spark, sf):
    return M.manifest_relations(manifests(spark, sf))


@query(
    "manifest_import",
    """SELECT CAST(o_orderkey AS VARCHAR) o_orderkey, o_orderstatus, CAST(c_custkey AS VARCHAR) c_custkey, c_name
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def manifest_import(spark, sf):
    """Two tables imported by manifest, joined over the relation it declares."""
    import json

    from recordloom.operators.traverse import follow

    def table(name, key):
        return {"name": name, "primaryKey": [key], "columns": []}

    model = {
        "snapshot": {
            "id": "s",
            "tables": [table("orders", "o_orderkey"), table("customer", "c_custkey")],
            "relationships": [{"name": "buyer", "from": {"table": "orders", "column": "o_custkey"},
                               "to": {"table": "customer", "column": "c_custkey"}}],
        },
        "format": {"parquet": {"location": {"tables": [
            {"name": t, "paths": [f"{sf}/{t}.parquet"]} for t in ("orders", "customer")
        ]}}},
    }
    path = scratch(spark, "manifest")
    spark.createDataFrame([(json.dumps(model),)], "value string").write.mode("overwrite").text(path)
    tables = M.load_manifest(spark, path)
    reached = follow(tables, "orders", ["o_custkey"])
    status = tables["orders"].df.select(F.col("o_orderkey"), "o_orderstatus")
    return reached.join(status, F.col("sys_root") == F.col("o_orderkey")).select(
        "o_orderkey", "o_orderstatus", "c_custkey", "c_name"
    )


@query(
    "write_counts",
    """SELECT 'customer' AS record_type, 2 * count(*) AS written FROM customer UNION ALL SELECT 'orders', 2 * count(*) FROM orders
       UNION ALL SELECT 'nation', count(*) FROM nation""",
)
def write_counts_query(spark, sf):
    """Rows of the base pass, plus those of the relation pass that have relations."""
    rows = nested_rows(spark, sf)
    return write_counts([rows, rows.filter(F.size("relations") > 0)], "name")
