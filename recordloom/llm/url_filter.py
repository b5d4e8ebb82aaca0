"""URL filters by hashed host-suffix and path-prefix expressions.

A URL is expanded into every ``host suffix + path prefix`` that a rule could name, each expression is hashed, and the
short prefixes of the digests are joined with those of the rules. A full digest settles what only shared its first
bytes, and among the rules that fit the longest one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.tables import ascii_lower

PREFIX_DIGITS = 8
DEFAULT_VERDICT = "allow"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both are empty where it is null or has no ``://``."""
    start = F.locate("://", F.col("url") if url is None else url)
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def checked_rules(rules: DataFrame) -> DataFrame:
    """Rules with the digest of their expression. Rows without a host or a verdict are left out, a null path is ``/``.

    A path has to begin and end with a slash, since prefixes of URL paths are cut at slashes: another one is an error.
    """
    path = F.coalesce(F.col("path"), F.lit("/"))
    good = path.startswith("/") & path.endswith("/")
    return (
        rules.where(F.col("host").isNotNull() & F.col("verdict").isNotNull())
        .select(
            ascii_lower(F.col("host")).alias("rule_host"),
            F.when(good, path)
            .otherwise(F.raise_error(F.concat(F.lit("a rule's path must begin and end with /: "), path)))
            .alias("rule_path"),
            "verdict",
        )
        .distinct()
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .withColumn("digest", F.sha2("rule", 256))
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    )


def judge_urls(urls: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to ``urls``, by its column ``url``.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains of it if the URL's path starts with the
    rule's path. The longest rule wins; of rules with the same host and path, ``block`` wins. Where none fits, ``rule``
    is null and ``verdict`` is ``default``. Rows of ``urls`` stay as they are, repeats included; columns of these
    four names that it has already are replaced.

    An expression with more labels or more slashes than any rule has can't match, so the expansion stops at the depth of
    the deepest rule. It is made once for each distinct pair of host and path that is left when both are cut to that
    depth: a host with a third of all rows is one row before the join.
    """
    names = ("host", "path", "rule", "verdict")
    known = checked_rules(rules)
    labels, slashes = known.agg(
        F.max(F.size(F.split("rule_host", r"\."))), F.max(F.size(F.split("rule_path", "/")) - 1)
    ).first()
    host, path = split_url(F.col("url"))
    kept = [F.col(f"`{c}`") for c in urls.columns if c not in names]
    parts = urls.select(*kept, host.alias("host"), path.alias("path"))
    if not labels:
        return parts.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    def cut_path(n: int) -> Column:
        head = F.substring_index("path", "/", n)
        return F.when(F.length("path") > F.length(head), F.concat(head, F.lit("/")))

    # null stands for a prefix that the path doesn't reach
    host_key = F.substring_index("host", ".", -labels)
    path_key = F.coalesce(*[cut_path(n) for n in range(slashes, 0, -1)], F.lit(""))
    keyed = parts.select("*", host_key.alias("~host_key"), path_key.alias("~path_key"))
    expressions = F.array_compact(
        F.array(
            *[
                F.concat(F.substring_index("host", ".", -k), cut_path(n))
                for k in range(1, labels + 1)
                for n in range(1, slashes + 1)
            ]
        )
    )
    expanded = (
        keyed.select(F.col("~host_key").alias("host"), F.col("~path_key").alias("path"))
        .distinct()
        .select("host", "path", F.explode(F.array_distinct(expressions)).alias("expression"))
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    )
    best = F.max(F.struct(F.length("rule"), F.length("rule_host"), F.col("known.verdict") == "block", "rule", "known.verdict"))
    decided = (
        expanded.alias("url")
        .join(known.alias("known"), F.col("url.short") == F.col("known.short"))
        .where(F.col("url.digest") == F.col("known.digest"))
        .groupBy(F.col("url.host").alias("~host_key"), F.col("url.path").alias("~path_key"))
        .agg(best.alias("~best"))
    )
    return (
        keyed.join(decided, ["~host_key", "~path_key"], "left")
        .withColumn("rule", F.col("~best.rule"))
        .withColumn("verdict", F.coalesce(F.col("~best.verdict"), F.lit(default)))
        .drop("~host_key", "~path_key", "~best")
    )
