"""Upserts, deletes, change feeds and the checks around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions.relation import relation_uri
from recordloom.model import AttributeType, Collection, RecordTable, tag
from recordloom.operators import integrity as I
from recordloom.operators import write as W
from recordloom.operators.edges import upserted_edges
from recordloom.operators.ingest import merge_records
from recordloom.operators.traverse import follow
from recordloom.plans.importing import scratch
from recordloom.plans.registry import query
from recordloom.plans.star import order_lines, raw, records, star
from recordloom.sinks.edges import apply_stored_delta, inbound, read_edges, write_edges

# customers, and changes to them: one row per user with events
_CHANGES = """(SELECT user_id, max_by(value, event_id) AS value, max_by(event_type, event_id) AS event_type,
                 count(*) AS n FROM events GROUP BY user_id)"""


def customers(spark, sf) -> RecordTable:
    table = records(spark, sf, "customer")
    return table.with_df(tag(table.df.drop("c_nationkey"), "c_custkey"))


def _latest_events(spark, sf):
    """The last event of each user, as changes to the customer of that number.

    Two in three users have no such customer at the smallest scale: they are new.
    """
    events = raw(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("c_custkey"), "event_id",
        F.col("value").alias("c_acctbal"), F.col("event_type").alias("last_event"),
    )
    return W.latest(events, "c_custkey", "event_id").drop("event_id")


def _ids(df, column):
    return df.select(F.col(column).cast("string").alias("record_id")).distinct()


_UPSERT = f"""SELECT CAST(coalesce(c_custkey, user_id) AS VARCHAR) c_custkey, c_name, c_mktsegment,
    CASE WHEN user_id IS NULL THEN c_acctbal ELSE value END AS c_acctbal, event_type AS last_event
  FROM customer FULL JOIN {_CHANGES} ON c_custkey = user_id"""


@query("upsert_batch", _UPSERT)
def upsert_batch(spark, sf):
    """Balances overwritten, a new attribute added, names kept, unknown customers inserted."""
    return W.upsert(customers(spark, sf), _latest_events(spark, sf))


@query("upsert_broadcast", _UPSERT)
def upsert_broadcast(spark, sf):
    """The same, naming the attributes that are to be touched, of changes whose keys are known to differ."""
    return W.upsert(customers(spark, sf), _latest_events(spark, sf), ["c_acctbal", "last_event"], unique=True)


@query(
    "insert_missing",
    """SELECT CAST(c_custkey AS VARCHAR) c_custkey, c_name FROM customer
       UNION ALL SELECT DISTINCT CAST(user_id + event_id % 2 * 1000000000 AS VARCHAR), NULL FROM events
       WHERE user_id + event_id % 2 * 1000000000 NOT IN (SELECT c_custkey FROM customer)""",
)
def insert_missing(spark, sf):
    """Every other event names a customer that isn't there."""
    table = customers(spark, sf)
    events = raw(spark, sf, "events").select((F.col("user_id") + F.col("event_id") % 2 * 1_000_000_000).alias("user_id"))
    return W.insert_missing(table, _ids(events, "user_id")).select("c_custkey", "c_name")


@query(
    "replace_record",
    f"""SELECT CAST(coalesce(c_custkey, user_id) AS VARCHAR) c_custkey,
          CASE WHEN user_id IS NULL THEN c_name END AS c_name, CASE WHEN user_id IS NULL THEN c_mktsegment END AS c_mktsegment,
          CASE WHEN user_id IS NULL THEN c_acctbal ELSE value END AS c_acctbal
        FROM customer FULL JOIN {_CHANGES} ON c_custkey = user_id""",
)
def replace_record(spark, sf):
    return W.replace_records(customers(spark, sf), _latest_events(spark, sf).drop("last_event"))


@query(
    "patch_record",
    f"""SELECT CAST(c_custkey AS VARCHAR) c_custkey, c_name,
          CASE WHEN event_type IN ('view', 'click') THEN value ELSE c_acctbal END AS c_acctbal,
          CASE WHEN event_type IN ('view', 'error') THEN event_type ELSE c_mktsegment END AS c_mktsegment
        FROM customer LEFT JOIN {_CHANGES} ON c_custkey = user_id""",
)
def patch_record(spark, sf):
    """Existing customers patched: views set both attributes, others one or none."""
    table = customers(spark, sf)
    last = _latest_events(spark, sf).withColumnRenamed("last_event", "c_mktsegment")
    e = F.col("c_mktsegment")
    given = F.array_compact(F.array(
        F.when(e.isin("view", "click"), "c_acctbal"), F.when(e.isin("view", "error"), "c_mktsegment")
    ))
    known = last.join(table.df.select(F.col("c_custkey").alias("k")), F.col("c_custkey") == F.col("k"), "left_semi")
    return W.patch_records(table, known.withColumn("given", given), "given").select(
        "c_custkey", "c_name", "c_acctbal", "c_mktsegment"
    )


@query(
    "delete_ids",
    """SELECT CAST(o_orderkey AS VARCHAR) o_orderkey, o_totalprice FROM orders
       WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error')""",
)
def delete_ids(spark, sf):
    """Orders of customers with an error event are deleted."""
    orders = records(spark, sf, "orders")
    failed = raw(spark, sf, "events").filter("event_type = 'error'").select(F.col("user_id").cast("string").alias("u"))
    gone = orders.df.join(failed, F.col("o_custkey") == F.col("u"), "left_semi")
    return W.delete_request(orders, ids=_ids(gone, "o_orderkey")).select("o_orderkey", "o_totalprice")


@query(
    "delete_except",
    """SELECT CAST(c_custkey AS VARCHAR) c_custkey, c_name FROM customer
       WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')""",
)
def delete_except(spark, sf):
    keep = _ids(raw(spark, sf, "events").filter("event_type = 'purchase'"), "user_id")
    kept = W.delete_request(customers(spark, sf), delete_all=True, excluded=keep)
    return kept.select("c_custkey", "c_name")


@query("delete_all", "SELECT CAST(c_custkey AS VARCHAR) c_custkey FROM customer WHERE false")
def delete_all(spark, sf):
    return W.delete_request(customers(spark, sf), delete_all=True).select("c_custkey")


@query(
    "delete_missing",
    """SELECT DISTINCT CAST(user_id AS VARCHAR) record_id FROM events
       WHERE user_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def delete_missing(spark, sf):
    good = raw(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").cast("string").alias("doc_id"))
    return W.missing_ids(RecordTable("labels", good, "doc_id"), _ids(raw(spark, sf, "events"), "user_id"))


@query(
    "delete_blocked",
    """SELECT CAST(c_custkey AS VARCHAR) record_id, count(*) AS "references"
       FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1""",
)
def delete_blocked(spark, sf):
    """Customers of a segment that cannot go, because orders refer to them."""
    tables = star(spark, sf)
    asked = _ids(tables["customer"].df.filter("c_mktsegment = 'BUILDING'"), "c_custkey")
    return I.blocked_deletes(tables, "customer", asked)


@query(
    "delete_blocked_edges",
    """SELECT CAST(p_partkey AS VARCHAR) record_id, count(DISTINCT l_orderkey) AS "references"
       FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size > 25 GROUP BY 1""",
)
def delete_blocked_edges(spark, sf):
    tables = star(spark, sf)
    asked = _ids(tables["part"].df.filter("p_size > 25"), "p_partkey")
    return I.blocked_deletes(tables, "part", asked)


@query(
    "dangling_relations",
    """SELECT CAST(o_orderkey AS VARCHAR) from_id, CAST(o_custkey AS VARCHAR) to_id FROM orders
       WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""",
)
def dangling_relations(spark, sf):
    """Orders left pointing at nothing if customers in debt were gone."""
    tables = star(spark, sf)
    customer = tables["customer"]
    solvent = RecordTable("customer", customer.df.filter("c_acctbal >= 0"), customer.primary_key)
    return I.dangling_relations(tables_with(tables, solvent), "orders", "o_custkey")


@query(
    "dangling_edges",
    """SELECT CAST(l_orderkey AS VARCHAR) from_id, CAST(l_partkey AS VARCHAR) to_id
       FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
       WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)""",
)
def dangling_edges(spark, sf):
    tables = star(spark, sf)
    part = tables["part"]
    small = RecordTable("part", part.df.filter("p_size <= 25"), part.primary_key)
    return I.dangling_relations(tables_with(tables, small), "orders", "parts")


# ---- guarded writes --------------------------------------------------------


def _orders_from_events(spark, sf):
    """Events as orders of the customer with the user's number; every other one of a customer who isn't there."""
    customer = F.col("user_id") + F.col("event_id") % 2 * 1_000_000_000
    events = raw(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("o_orderkey"), F.col("value").alias("o_totalprice"),
        relation_uri("customer", customer.cast("string")).alias("o_custkey"),
    )
    return tag(events, "o_orderkey", {"o_custkey": AttributeType.RELATION})


def _guarded_upsert(spark, sf):
    tables = star(spark, sf)
    orders = tables["orders"]
    plain = RecordTable("orders", orders.df.select("o_orderkey", "o_custkey", "o_totalprice"), orders.primary_key)
    return merge_records(plain, "orders", "o_orderkey", _orders_from_events(spark, sf), guard="report", collection=tables)


@query(
    "upsert_guarded",
    """SELECT CAST(coalesce(event_id, o_orderkey) AS VARCHAR) o_orderkey, CAST(coalesce(user_id, o_custkey) AS VARCHAR) o_custkey,
              coalesce(value, o_totalprice) AS o_totalprice
       FROM orders FULL JOIN (SELECT * FROM events WHERE event_id % 2 = 0 AND user_id IN (SELECT c_custkey FROM customer)) ON event_id = o_orderkey""",
)
def upsert_guarded(spark, sf):
    """Orders after an upsert that leaves out those of customers who don't exist."""
    return _guarded_upsert(spark, sf)[0].df.withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@query(
    "upsert_guarded_problems",
    """SELECT CAST(event_id AS VARCHAR) record_id, 'o_custkey' AS attribute, CAST(user_id + event_id % 2 * 1000000000 AS VARCHAR) AS target,
              'names no record' AS problem
       FROM events WHERE user_id + event_id % 2 * 1000000000 NOT IN (SELECT c_custkey FROM customer)""",
)
def upsert_guarded_problems(spark, sf):
    """What was left out, and why."""
    return _guarded_upsert(spark, sf)[1].drop("references")


_FAILED = "(SELECT DISTINCT user_id + event_id % 2 * 1000000000 AS user_id FROM events WHERE event_type = 'error')"
_PENDING = "(SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"


def _guarded_delete(spark, sf):
    tables = star(spark, sf)
    orders = tables["orders"]
    pending = RecordTable("orders", orders.df.filter("o_orderstatus = 'P'"), orders.primary_key)
    failed = raw(spark, sf, "events").filter("event_type = 'error'")
    asked = _ids(failed.select((F.col("user_id") + F.col("event_id") % 2 * 1_000_000_000).alias("user_id")), "user_id")
    return W.delete_request(tables["customer"], ids=asked, guard="report", collection=Collection.of(tables["customer"], pending))


@query(
    "delete_guarded",
    f"""SELECT CAST(c_custkey AS VARCHAR) c_custkey, c_name FROM customer
        WHERE c_custkey NOT IN (SELECT user_id FROM {_FAILED}) OR c_custkey IN {_PENDING}""",
)
def delete_guarded(spark, sf):
    """Customers without those asked for, but for the ones that pending orders refer to."""
    return _guarded_delete(spark, sf)[0].select("c_custkey", "c_name")


@query(
    "delete_guarded_problems",
    f"""SELECT CAST(user_id AS VARCHAR) record_id, CASE WHEN n IS NULL THEN 'does not exist' ELSE 'is referred to' END AS problem,
              coalesce(n, 0) AS "references"
        FROM {_FAILED} LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {_PENDING} GROUP BY 1) ON o_custkey = user_id
        WHERE n IS NOT NULL OR user_id NOT IN (SELECT c_custkey FROM customer)""",
)
def delete_guarded_problems(spark, sf):
    """Why the others could not go."""
    return _guarded_delete(spark, sf)[1].select("record_id", "problem", F.coalesce("references", F.lit(0)).alias("references"))


# ---- edges -----------------------------------------------------------------

_PARTS = "(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)"
_NEW_PARTS = """(SELECT DISTINCT l_orderkey, l_suppkey AS l_partkey FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'))"""
_AFTER = f"""(SELECT * FROM {_PARTS} WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
    UNION ALL SELECT * FROM {_NEW_PARTS})"""


def _given_parts(spark, sf, orders):
    """Some orders, each with an array of parts that is to replace the ones it has."""
    some = orders.df.filter("o_orderstatus = 'P'").select("o_orderkey")
    lines = order_lines(spark, sf, "l_suppkey").select("from_id", relation_uri("part", F.col("to_id")).alias("uri"))
    parts = lines.groupBy("from_id").agg(F.collect_list("uri").alias("parts"))
    given = some.join(parts, F.col("o_orderkey") == F.col("from_id"), "left").select("o_orderkey", "parts")
    return tag(given, "o_orderkey", {"parts": AttributeType.ARRAY_OF_RELATION})


@query(
    "edges_after_upsert",
    f"""SELECT CAST(l_orderkey AS VARCHAR) sys_root, CAST(p_partkey AS VARCHAR) p_partkey, p_name
        FROM {_AFTER} JOIN part ON p_partkey = l_partkey""",
)
def edges_after_upsert(spark, sf):
    """Parts reached from every order once an upsert has given some of them other parts."""
    tables = star(spark, sf)
    after = merge_records(tables["orders"], "orders", "o_orderkey", _given_parts(spark, sf, tables["orders"]))
    related = Collection.of(after, tables["part"])
    return follow(related, "orders", ["parts"]).select("sys_root", "p_partkey", "p_name")


@query(
    "edges_stored_inbound",
    f"""SELECT CAST(p_partkey AS VARCHAR) to_id, count(*) AS "references"
        FROM {_AFTER} JOIN part ON p_partkey = l_partkey WHERE p_size > 25 GROUP BY 1""",
)
def edges_stored_inbound(spark, sf):
    """References to some parts, from stored edges that an upsert's delta has changed, read by part alone."""
    orders = star(spark, sf)["orders"]
    path = scratch(spark, "edges")
    stored = orders.edge_tables["parts"][1]
    write_edges(stored, path)
    delta = upserted_edges(RecordTable("orders", orders.df, "o_orderkey", {"parts": ("part", read_edges(spark, path))}), _given_parts(spark, sf, orders))
    where = f"{path}/delta"
    delta["parts"].write.parquet(where)
    apply_stored_delta(spark, path, spark.read.parquet(where))
    asked = _ids(raw(spark, sf, "part").filter("p_size > 25"), "p_partkey")
    return inbound(spark, path, asked).groupBy("to_id").agg(F.count(F.lit(1)).alias("references"))


@query(
    "upsert_repeated_keys",
    f"""SELECT CAST(o_custkey AS VARCHAR) o_custkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1""",
)
def upsert_repeated_keys(spark, sf):
    """Changes that give keys many times are refused by an upsert, and taken once they are narrowed down."""
    orders = raw(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("o_custkey"), "o_totalprice")
    empty = RecordTable("spender", tag(orders.limit(0), "o_custkey"), "o_custkey")
    try:
        W.upsert(empty, orders).write.format("noop").mode("overwrite").save()
    except Exception as error:
        if "more than once" not in str(error):
            raise
        return W.upsert(empty, W.latest(orders, "o_custkey", "o_totalprice"), unique=True)
    return empty.df


def tables_with(tables: Collection, table: RecordTable) -> Collection:
    return Collection({n: (table if n == table.name else tables[n]) for n in ("customer", "orders", "part")})


@query("split_by_type", "SELECT event_type AS type, count(*) AS records, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def split_by_type(spark, sf):
    events = raw(spark, sf, "events")
    parts = W.split_by_type(events, column="event_type")
    counted = None
    for name, rows in parts.items():
        one = rows.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("user_id").alias("users"))
        one = one.withColumn("type", F.lit(name))
        counted = one if counted is None else counted.unionByName(one)
    return counted


# ---- change feeds ----------------------------------------------------------

_FEED = """(SELECT event_id AS seq, user_id, value, event_type,
    CASE event_type WHEN 'error' THEN 'delete' ELSE 'upsert' END AS op FROM events)"""


def event_feed(spark, sf):
    """Events as a change feed on customers: an error deletes, anything else upserts."""
    e = F.col("event_type")
    return raw(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("record_id"),
        F.when(e == "error", "delete").otherwise("upsert").alias("operation"),
        F.col("value").alias("c_acctbal"), e.alias("last_event"),
    )


APPLIED = f"""WITH f AS (SELECT user_id, max(seq) FILTER (op = 'delete') d, max(seq) FILTER (op = 'upsert') u,
                     max_by(value, seq) FILTER (op = 'upsert') v, max_by(event_type, seq) FILTER (op = 'upsert') e
                   FROM {_FEED} GROUP BY user_id)
        SELECT CAST(coalesce(c_custkey, user_id) AS VARCHAR) c_custkey,
               CASE WHEN d IS NULL THEN c_name END AS c_name, CASE WHEN d IS NULL THEN c_mktsegment END AS c_mktsegment,
               CASE WHEN u IS NULL THEN c_acctbal ELSE v END AS c_acctbal, e AS last_event
        FROM customer FULL JOIN f ON c_custkey = user_id WHERE d IS NULL OR u > d"""


@query("apply_changes", APPLIED)
def apply_changes(spark, sf):
    return W.apply_changes(customers(spark, sf), event_feed(spark, sf), ["c_acctbal", "last_event"])


# events of one kind give one attribute, and set only that
_GIVEN = f"""
  WITH f AS (SELECT user_id, max(seq) FILTER (op = 'delete') d, max(seq) FILTER (op = 'upsert') u,
          max(seq) FILTER (op = 'upsert' AND event_type = 'view') sv, max(seq) FILTER (op = 'upsert' AND event_type = 'click') sc
        FROM {_FEED} GROUP BY user_id)
  SELECT CAST(coalesce(c_custkey, f.user_id) AS VARCHAR) c_custkey, CASE WHEN d IS NULL THEN c_name END AS c_name,
    CASE WHEN sv > coalesce(d, -1) THEN ev.value WHEN d IS NULL THEN c_acctbal END AS c_acctbal,
    CASE WHEN sc > coalesce(d, -1) THEN ec.value END AS clicked
  FROM customer FULL JOIN f ON c_custkey = f.user_id
  LEFT JOIN events ev ON ev.event_id = sv LEFT JOIN events ec ON ec.event_id = sc
  WHERE d IS NULL OR u > d"""


@query("apply_changes_batched", _GIVEN)
def apply_changes_batched(spark, sf):
    """A feed whose upserts each name the attributes they set, however it was cut into batches."""
    e = F.col("last_event")
    feed = event_feed(spark, sf).select(
        "seq", "record_id", "operation", F.when(e == "view", F.col("c_acctbal")).alias("c_acctbal"),
        F.when(e == "click", F.col("c_acctbal")).alias("clicked"),
        F.array_compact(F.array(F.when(e == "view", "c_acctbal"), F.when(e == "click", "clicked"))).alias("given"),
    )
    table = customers(spark, sf)
    table = table.with_df(table.df.drop("c_mktsegment"))
    return W.apply_changes(table, feed, ["c_acctbal", "clicked"], given="given")


@query(
    "edges_of_touched",
    """SELECT CAST(l_orderkey AS VARCHAR) from_id, CAST(l_partkey AS VARCHAR) to_id
       FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
       WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def edges_of_touched(spark, sf):
    """Edges cascade: those of deleted orders go with them."""
    parts = order_lines(spark, sf, "l_partkey")
    gone = _ids(raw(spark, sf, "orders").filter("o_orderstatus = 'F'"), "o_orderkey")
    return I.replace_edges(parts, gone, parts.limit(0))


@query(
    "json_ops_apply",
    f"""WITH f AS (SELECT user_id, max(seq) FILTER (op = 'delete') d, max(seq) FILTER (op = 'upsert') u,
              max(seq) FILTER (op = 'upsert' AND event_type IN ('view', 'click')) sv,
              max(seq) FILTER (op = 'upsert' AND event_type = 'click') sp FROM {_FEED} GROUP BY user_id)
      SELECT CAST(f.user_id AS VARCHAR) user_id,
        CASE WHEN sv > coalesce(d, -1) AND ev.event_type = 'view' THEN ev.value END AS value,
        CASE WHEN sp > coalesce(d, -1) AND ep.event_type = 'click' THEN replace(ep.props, ' ', '') END AS props
      FROM f LEFT JOIN events ev ON ev.event_id = sv LEFT JOIN events ep ON ep.event_id = sp
      WHERE u IS NOT NULL AND (d IS NULL OR u > d)""",
)
def json_ops_apply(spark, sf):
    """A JSON change batch made into a new table: inferred, evolved, applied in order."""
    from recordloom.operators.ingest import apply_operations
    from recordloom.plans.importing import _operation_lines
    from recordloom.sources.operations import parse_operations

    ops = parse_operations(_operation_lines(spark, sf), "line", "event_id")
    table = apply_operations(None, "user", ops, "user_id")
    return table.df.select("user_id", F.col("value").cast("double").alias("value"), "props")


@query(
    "tsv_upload",
    f"""SELECT CAST(coalesce(c_custkey, user_id) AS VARCHAR) c_custkey, c_name,
          CASE WHEN user_id IS NULL THEN rtrim(rtrim(CAST(CAST(c_acctbal AS DECIMAL(38,6)) AS VARCHAR), '0'), '.')
               ELSE '~' || CAST(value AS VARCHAR) END AS c_acctbal, event_type AS last_event
        FROM customer FULL JOIN {_CHANGES} ON c_custkey = user_id""",
)
def tsv_upload(spark, sf):
    """Two uploads of cells; the second turns a number column into text and adds one."""
    from recordloom.sinks.export import tsv_cells
    from recordloom.sources.tsv import load_tsv

    first = customers(spark, sf)
    first = first.with_df(first.df.select("c_custkey", "c_name", "c_acctbal"))
    table = merge_records(None, "customer", "c_custkey", load_tsv(tsv_cells(first), "c_custkey"))
    text = F.concat(F.lit("~"), F.col("c_acctbal").cast("string"))
    changes = load_tsv(_latest_events(spark, sf).withColumn("c_acctbal", text), "c_custkey")
    return merge_records(table, "customer", "c_custkey", changes).df
