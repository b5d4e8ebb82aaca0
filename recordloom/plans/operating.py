"""Jobs, activity, import rules and the streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions import infer
from recordloom.operators import jobs as J
from recordloom.operators.rules import apply_rules, host_of, path_of
from recordloom.plans.changing import APPLIED, customers, event_feed
from recordloom.plans.importing import scratch
from recordloom.plans.registry import query
from recordloom.plans.star import raw
from recordloom.sinks.table import read_table
from recordloom.sources.tsv import typed_cell
from recordloom.streaming.changes import read_records, start_changes, start_table
from recordloom.streaming.decisions import start_decisions
from recordloom.streaming.ingest import start_upserts
from recordloom.streaming.status import start_status_fold

# every order is a job: placed, then updated when its last line ships
_JOBS = """(SELECT CAST(o_orderkey AS VARCHAR) job_id, CAST(o_custkey AS VARCHAR) collection_id, o_orderpriority AS job_type,
    CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'RUNNING' ELSE 'QUEUED' END AS status,
    o_orderdate AS created, coalesce(last_ship, o_orderdate) AS updated
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) last_ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def _jobs(spark, sf):
    s = F.col("o_orderstatus")
    shipped = raw(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"))
    joined = raw(spark, sf, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(
        F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_custkey").cast("string").alias("collection_id"),
        F.col("o_orderpriority").alias("job_type"),
        F.when(s == "F", "SUCCEEDED").when(s == "O", "RUNNING").otherwise("QUEUED").alias("status"),
        F.col("o_orderdate").alias("created"), F.coalesce("last_ship", "o_orderdate").alias("updated"),
    )


@query("jobs_by_status", f"SELECT job_id, collection_id, status FROM {_JOBS} WHERE status IN ('RUNNING', 'QUEUED')")
def jobs_by_status(spark, sf):
    return J.jobs_of(_jobs(spark, sf), statuses=["RUNNING", "QUEUED"]).select("job_id", "collection_id", "status")


@query("jobs_of_collection", f"SELECT job_id, status FROM {_JOBS} WHERE collection_id = '37'")
def jobs_of_collection(spark, sf):
    return J.jobs_of(_jobs(spark, sf), collection_id="37").select("job_id", "status")


@query(
    "stalled_jobs",
    f"""SELECT job_id, 'ERROR' AS status, 'no update for 6 hours' AS error FROM {_JOBS}
        WHERE status <> 'SUCCEEDED' AND updated < TIMESTAMP '1999-01-01 12:00:00' - INTERVAL 6 HOUR""",
)
def stalled_jobs(spark, sf):
    now = F.lit("1999-01-01 12:00:00").cast("timestamp_ntz")
    return J.stalled_jobs(_jobs(spark, sf), now).select("job_id", "status", "error")


_EXTERNAL = {"view": "ReadyForUpsert", "click": "Upserting", "purchase": "Done", "error": "Error"}
_STATUS = {"view": "RUNNING", "click": "RUNNING", "purchase": "SUCCEEDED", "error": "ERROR"}
_UPDATES = (
    "(SELECT CAST(user_id AS VARCHAR) job_id, event_id AS seq, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items())
    + " ELSE 'UNKNOWN' END AS status FROM events)"
)


def _updates(events):
    """Events as status updates: each user is a job; sign-ups carry no status."""
    external = F.create_map(*[F.lit(x) for p in _EXTERNAL.items() for x in p])
    status = J.job_status(F.try_element_at(external, F.col("event_type")))
    return events.select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), status.alias("status"),
        F.col("ts").cast("timestamp").alias("updated"),
    )


@query("status_map", f"SELECT seq, status FROM {_UPDATES}")
def status_map(spark, sf):
    return _updates(raw(spark, sf, "events")).select("seq", "status")


_FOLDED = f"""(SELECT job_id, coalesce(min_by(status, seq) FILTER (status IN ('SUCCEEDED', 'ERROR')), 'RUNNING') AS status,
    coalesce(min(seq) FILTER (status IN ('SUCCEEDED', 'ERROR')), -1) AS finished_at FROM {_UPDATES} GROUP BY job_id)"""


@query("status_fold", f"SELECT * FROM {_FOLDED}")
def status_fold(spark, sf):
    folded = J.fold_statuses(_updates(raw(spark, sf, "events")))
    return folded.withColumn("finished_at", F.coalesce("finished_at", F.lit(-1)))


_CLASSIFIED = f"""SELECT u.job_id, count(*) FILTER (seq = t) AS accepted,
          count(*) FILTER (seq <> t AND u.status = CASE WHEN seq < t THEN 'RUNNING' ELSE f.status END) AS ignored,
          count(*) FILTER (seq <> t AND u.status <> CASE WHEN seq < t THEN 'RUNNING' ELSE f.status END) AS rejected
        FROM {_UPDATES} u JOIN (SELECT job_id, status, CASE finished_at WHEN -1 THEN 9223372036854775807 ELSE finished_at END AS t FROM {_FOLDED}) f
          ON f.job_id = u.job_id GROUP BY 1"""


@query("status_classify", _CLASSIFIED)
def status_classify(spark, sf):
    return J.classify_updates(_updates(raw(spark, sf, "events")))


@query(
    "job_elapsed",
    f"""SELECT job_type, status, count(*) AS jobs, CAST(round(avg(epoch(updated) - epoch(created))) AS BIGINT) AS mean_seconds,
               CAST(max(epoch(updated) - epoch(created)) AS BIGINT) AS max_seconds
        FROM {_JOBS} WHERE status = 'SUCCEEDED' GROUP BY 1, 2""",
)
def job_elapsed(spark, sf):
    found = J.elapsed_by_tags(_jobs(spark, sf), ["job_type", "status"])
    return found.withColumns({
        "mean_seconds": F.round("mean_seconds").cast("long"), "max_seconds": F.col("max_seconds").cast("long")
    })


_ACTION = {"view": "created", "click": "updated", "signup": "upserted", "purchase": "deleted", "error": "renamed"}
_SQL_ACTION = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ACTION.items()) + " END"


def _activity(spark, sf):
    e = F.col("event_type")
    action = F.create_map(*[F.lit(x) for p in _ACTION.items() for x in p])[e]
    return raw(spark, sf, "events").select(
        "event_id", F.col("user_id").cast("string").alias("subject"), action.alias("action"),
        F.when(e == "view", "table").otherwise("record").alias("thing"),
        F.when(e.isin("click", "signup"), "customer").alias("record_type"),
        F.when(e.isin("click", "purchase"), F.get_json_object("props", "$.k").cast("long")).alias("quantity"),
        F.when(e == "signup", F.array(F.col("user_id").cast("string"), F.col("event_id").cast("string"))).alias("ids"),
    )


@query(
    "activity_text",
    f"""SELECT event_id, 'user ' || user_id || ' ' || {_SQL_ACTION} ||
          CASE WHEN event_type = 'signup' THEN ' 2' WHEN event_type IN ('click', 'purchase') THEN ' ' || (props->>'$.k') ELSE '' END ||
          CASE event_type WHEN 'view' THEN ' table(s)' ELSE ' record(s)' END ||
          CASE WHEN event_type IN ('click', 'signup') THEN ' of type customer' ELSE '' END ||
          CASE WHEN event_type = 'signup' THEN ' with id(s) [' || user_id || ', ' || event_id || ']' ELSE '' END AS line
        FROM events""",
)
def activity_text(spark, sf):
    c = F.col
    line = J.activity_text(c("subject"), c("action"), c("thing"), c("quantity"), c("record_type"), c("ids"))
    return _activity(spark, sf).select("event_id", line.alias("line"))


@query(
    "activity_counts",
    f"""SELECT {_SQL_ACTION} AS action, CASE event_type WHEN 'view' THEN 'table' ELSE 'record' END AS thing,
          CASE WHEN event_type IN ('click', 'signup') THEN 'customer' END AS record_type, count(*) AS events,
          coalesce(CAST(sum(CASE WHEN event_type IN ('click', 'purchase') THEN CAST(props->>'$.k' AS BIGINT) END) AS BIGINT), 0) AS quantity
        FROM events GROUP BY 1, 2, 3""",
)
def activity_counts(spark, sf):
    return J.activity_counts(_activity(spark, sf)).withColumn("quantity", F.coalesce("quantity", F.lit(0)))


_HOST = "split_part(split_part(split_part(url, '/', 3), ':', 1), '?', 1)"


@query(
    "import_rules",
    f"""SELECT page_id, problem IS NULL AS allowed, coalesce(problem, '') AS problem, private AS private_workspace, private AS protected_policy,
          CASE WHEN private THEN 'curators,readers' ELSE '' END AS required_groups FROM (
          SELECT page_id, regexp_matches(url, '^https://[^/]*example[.]org') AS private,
            CASE WHEN url LIKE 'http://%' THEN 'scheme not allowed: http'
                 WHEN NOT regexp_full_match({_HOST}, '.*[.]example[.]com') AND NOT regexp_matches(url, '^https://[^/]*example[.]org')
                   THEN 'host not allowed: ' || {_HOST} END AS problem FROM pages)""",
)
def import_rules(spark, sf):
    """Page addresses as import requests."""
    requests = raw(spark, sf, "pages").select("page_id", "url", F.lit("MANIFEST").alias("import_type"))
    source = J.ImportSource(
        urls=(r"^https://[^/]*example[.]org",), private_workspace=True, protected_policy=True, groups=("curators", "readers")
    )
    checked = J.check_imports(requests, {"https": [r".*[.]example[.]com"]}, [source])
    return checked.select(
        "page_id", "allowed", F.coalesce("problem", F.lit("")).alias("problem"), "private_workspace", "protected_policy",
        F.array_join("required_groups", ",").alias("required_groups"),
    )


_PLACES = """(SELECT page_id, lower(regexp_extract(url, '^[^:/?#]+://([^:/?#]*)', 1)) AS host, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)"""
_RULES = f"""(SELECT host, path, min(page_id) AS n FROM (
    SELECT page_id, CASE page_id % 3 WHEN 0 THEN host WHEN 1 THEN regexp_extract(host, '[^.]*[.]?[^.]*$') ELSE '' END AS host,
           CASE page_id % 3 WHEN 2 THEN path ELSE regexp_extract(path, '^/[^/]*') END AS path FROM {_PLACES}) GROUP BY 1, 2)"""


@query(
    "import_rules_table",
    f"""SELECT page_id AS request_id, count(n) AS rules, coalesce(bool_or(n % 2 = 0), false) AS private,
               coalesce(bool_or(n % 5 = 0), false) AS protected, coalesce(string_agg(DISTINCT 'group' || (n % 7), ',' ORDER BY 'group' || (n % 7)), '') AS groups
        FROM {_PLACES} p LEFT JOIN {_RULES} r
          ON (p.host = r.host OR r.host = '' OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
        GROUP BY 1""",
)
def import_rules_table(spark, sf):
    """Page addresses under as many rules as pages give: by host, by domain with the first part of a path, by whole path."""
    pages = raw(spark, sf, "pages").select("page_id", "url")
    host, path, kind = host_of(F.col("url")), path_of(F.col("url")), F.col("page_id") % 3
    first = F.regexp_extract(path, "^/[^/]*", 0)
    places = pages.select(
        "page_id", F.when(kind == 0, host).when(kind == 1, F.regexp_extract(host, "[^.]*[.]?[^.]*$", 0)).otherwise("").alias("host"),
        F.when(kind == 2, path).otherwise(first).alias("path"),
    )
    n = F.col("n")
    rules = places.groupBy("host", "path").agg(F.min("page_id").alias("n")).select(
        n.cast("string").alias("rule_id"), "host", "path", F.lit(None).cast("string").alias("pattern"), (n % 2 == 0).alias("private"),
        (n % 5 == 0).alias("protected"), F.array(F.concat(F.lit("group"), (n % 7).cast("string"))).alias("groups"),
    )
    found = apply_rules(pages, rules, request_id="page_id")
    return found.select("request_id", "rules", "private", "protected", F.array_join("groups", ",").alias("groups"))


# ---- streams ---------------------------------------------------------------


def _event_stream(spark, sf):
    schema = raw(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query(
    "stream_upsert",
    """SELECT CAST(user_id AS VARCHAR) user_id, max_by(value, event_id) AS value, max_by(event_type, event_id) AS event_type,
              max_by(CASE event_type WHEN 'view' THEN strftime(ts, '%Y-%m-%d') END, event_id) AS day
       FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY 1""",
)
def stream_upsert(spark, sf):
    """Text cells streamed into a record table by user."""
    stream = _event_stream(spark, sf).select(
        F.col("user_id").cast("string").alias("user_id"), "event_id", F.col("value").cast("string").alias("value"), "event_type",
        F.when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd")).alias("day"),
    )
    path, state = scratch(spark, "streamed"), scratch(spark, "stream-state")
    start_upserts(stream, path, "user", "user_id", "event_id", infer.tsv_type, typed_cell, state).awaitTermination()
    table = read_table(spark, path, "user").df
    return table.select(
        "user_id", F.col("value").cast("double").alias("value"), "event_type", F.col("day").cast("string").alias("day")
    )


@query("stream_status", f"SELECT * FROM {_FOLDED}")
def stream_status(spark, sf):
    """The status fold on a stream; the sink keeps each job's newest row."""
    path = scratch(spark, "status")

    def sink(rows, batch_id):
        rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    start_status_fold(_updates(_event_stream(spark, sf)), scratch(spark, "status-state"), sink).awaitTermination()
    newest = spark.read.parquet(path).groupBy("job_id").agg(
        F.max_by("status", "batch").alias("status"), F.max_by("finished_at", "batch").alias("finished_at")
    )
    return newest.withColumn("finished_at", F.coalesce("finished_at", F.lit(-1)))


@query("stream_changes", APPLIED)
def stream_changes(spark, sf):
    """Upserts and deletes of customers from a stream whose files have the operations in no order."""
    source, path = scratch(spark, "feed"), scratch(spark, "changed")
    feed = event_feed(spark, sf)
    feed.repartition(4, F.xxhash64("seq")).write.parquet(source)
    start_table(customers(spark, sf), path)
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(source)
    start_changes(stream, path, "customer", "c_custkey", ["c_acctbal", "last_event"], scratch(spark, "changes-state")).awaitTermination()
    return read_records(spark, path, "customer").df


@query("stream_classify", _CLASSIFIED)
def stream_classify(spark, sf):
    """A decision for each status update as it arrives, counted per job."""
    path = scratch(spark, "decisions")
    start_decisions(_updates(_event_stream(spark, sf)), path, scratch(spark, "decisions-state"), None).awaitTermination()
    made = spark.read.parquet(path)
    return made.groupBy("job_id").agg(*[F.count_if(F.col("decision") == d).alias(d) for d in ("accepted", "ignored", "rejected")])


@query(
    "stream_stalled",
    """SELECT CAST(event_id // 3 AS VARCHAR) job_id, 'ERROR' AS status FROM events GROUP BY event_id // 3
       HAVING count(*) FILTER (event_type IN ('purchase', 'error')) = 0 AND max(ts) + INTERVAL 6 HOUR < (SELECT max(ts) FROM events)""",
)
def stream_stalled(spark, sf):
    """Jobs without an end that had no update for six hours when the stream's time had moved on."""
    path = scratch(spark, "stalled")
    # three events in a row are a job of their own
    updates = _updates(_event_stream(spark, sf)).withColumn("job_id", F.floor(F.col("seq") / 3).cast("string"))
    start_decisions(updates, path, scratch(spark, "stalled-state")).awaitTermination()
    return spark.read.parquet(path).where("decision = 'stalled'").select("job_id", "status")
