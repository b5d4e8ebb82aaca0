"""Import rules as a table, any number of them, applied to any number of requests.

A rule names a host (it fits that host and all hosts below it; empty: any), the beginning of a path (empty: any) and may
have a pattern for the whole address. An address is expanded to its host and all hosts above, and meets the rules by an
equi-join on the host; path and pattern are looked at only where the host fits. So rules are never all compared with all
requests, and which side is sent to the other is left to the planner, which knows their sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = "rule_id string, host string, path string, pattern string, private boolean, protected boolean, groups array<string>"


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^[^:/?#]+://(?:[^/?#@]*@)?([^:/?#]*)", 1))


def path_of(url: Column) -> Column:
    """The path of an address, empty where there is none."""
    return F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def hosts_above(host: Column) -> Column:
    """A host, all hosts that it is below, and the empty one that stands for any."""
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.array_distinct(F.concat(above, F.array(F.lit(""))))


def matching_rules(requests: DataFrame, rules: DataFrame, url: str = "url", request_id: str = "request_id") -> DataFrame:
    """``request_id`` and the columns of each rule that fits its address; an address that is null fits none."""
    parts = requests.where(F.col(url).isNotNull()).select(
        F.col(request_id).alias("request_id"), F.col(url).alias("sys_url"), path_of(F.col(url)).alias("sys_path"),
        F.explode(hosts_above(host_of(F.col(url)))).alias("host"),
    )
    known = rules.select(
        "rule_id", F.lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "pattern", "private", "protected", "groups"
    )
    joined = parts.join(known, "host")
    fits = F.col("sys_path").startswith(F.col("path")) & (F.col("pattern").isNull() | F.rlike("sys_url", F.col("pattern")))
    return joined.where(fits).drop("sys_url", "sys_path")


def apply_rules(requests: DataFrame, rules: DataFrame, url: str = "url", request_id: str = "request_id") -> DataFrame:
    """Each request once: how many ``rules`` fit, whether it is ``allowed`` (one does), and what all of them ask for.

    ``private`` and ``protected`` hold if one of them says so; ``groups`` are those of all, in order. Ids of requests are
    unique. Rules count up where requests are, and groups are told apart before they are gathered.
    """
    found = matching_rules(requests, rules, url, request_id)
    counted = found.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("rules"), F.coalesce(F.bool_or("private"), F.lit(False)).alias("private"),
        F.coalesce(F.bool_or("protected"), F.lit(False)).alias("protected"),
    )
    single = found.select(F.col("request_id").alias("of"), F.explode("groups").alias("group")).where("group is not null").distinct()
    groups = single.groupBy("of").agg(F.array_sort(F.collect_list("group")).alias("groups"))
    asked = requests.select(F.col(request_id).alias("asked_id"))
    joined = asked.join(counted, F.col("asked_id") == F.col("request_id"), "left").join(groups, F.col("asked_id") == F.col("of"), "left")
    no = F.lit(False)
    return joined.select(
        F.col("asked_id").alias("request_id"), F.coalesce("rules", F.lit(0)).alias("rules"), F.col("rules").isNotNull().alias("allowed"),
        F.coalesce("private", no).alias("private"), F.coalesce("protected", no).alias("protected"),
        F.coalesce("groups", F.array().cast("array<string>")).alias("groups"),
    )
