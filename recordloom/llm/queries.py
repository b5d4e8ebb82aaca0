"""The named queries of this subpackage, and SQL statements with the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import (
    alignment,
    chat,
    decontaminate,
    language_model,
    lengths,
    packing,
    pii,
    quality,
    repair,
    simhash,
    toxicity,
    url_filter,
    weighted_sampling,
)
from recordloom.llm.tables import held_out, table, written

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


# host, path and verdict of the rules that the URL query applies: fixed values
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

URL_SQL = r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
),
rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
),
fitting AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts)
  JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fitting USING (host, path)
"""


@query("op6_url_filter", URL_SQL)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL, judged by the rules above."""
    rules = spark.range(1).select(
        F.inline(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("host", "path", "verdict"), r, strict=True)]) for r in URL_RULES]))
    )
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


CHAT_PROBE = "</s>[INST] ok [/INST]"

CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
pieces AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g'))
    + CASE WHEN role = 'assistant' THEN 9 ELSE 19 + length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')) END AS piece,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM turns
),
ends AS (
  SELECT *, sum(piece) OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS upto FROM pieces
),
whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS every,
    coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(upto) FILTER (WHERE role = 'assistant' OR n = n_turns) AS formatted_chars
  FROM ends GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(every) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars
FROM whole
"""


@query("op3_chat_format", CHAT_SQL)
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations, read back from the examples' texts and loss masks.

    ``formatted_chars`` counts the code points of all examples of a conversation.
    """
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CHAT_PROBE).alias("text"),
    )
    turns = chat.parsed_turns(F.col("text"))
    as_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = (
        chat.chat_examples(rows.unionByName(probe))
        .select(
            "conv_id",
            "example",
            F.length("text").alias("chars"),
            F.when(F.col("whole"), turns).alias("turns"),
            chat.trained_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
        )
        .select(
            "conv_id",
            F.when(F.col("turns").isNotNull(), F.size("turns").cast("long")).alias("n_turns"),
            F.when(F.col("turns").isNotNull(), F.sha2(as_text, 256)).alias("turns_sha256"),
            "chars",
            F.struct("example", "loss").alias("loss"),
        )
    )
    loss = F.array_join(F.transform(F.sort_array("losses"), lambda x: x["loss"]), "")
    return (
        read.groupBy("conv_id")
        .agg(
            F.max("n_turns").alias("n_turns"),
            F.max("turns_sha256").alias("turns_sha256"),
            F.sum("chars").alias("formatted_chars"),
            F.collect_list("loss").alias("losses"),
        )
        .select("conv_id", "n_turns", "turns_sha256", "formatted_chars", loss.alias("loss"))
        .select(
            "conv_id",
            "n_turns",
            "turns_sha256",
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of all documents with its suffix sums, one row per length."""
    documents = table(spark, sf_dir, "documents")
    # sums read the histogram twice, which is small once it is there
    return lengths.suffix_sums(written(lengths.length_histogram(lengths.token_lengths(documents)), "lengths"))


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of 2048 ids."""
    return packing.pack_digests(table(spark, sf_dir, "documents"))


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents by shingles of three words, and components over links of at most two bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts of base spans, their digest, and all spans."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    kinds = F.transform("~base", lambda s: s["kind"])

    def count(kind: int) -> Column:
        return F.size(F.filter(kinds, lambda k: k == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)],
        F.sha2(pii.listed(F.col("~base")), 256).alias("base_sha256"),
        pii.listed(F.col("~spans")).alias("spans"),
    )


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document by a model that has not seen the labels of a fifth of them."""
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    return toxicity.with_toxicity(documents, model, ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op4_decontamination")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of a document that is near an item of the benchmark; documents without one have no row."""
    return decontaminate.contaminated_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_language_model")
def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of nine tenths of them."""
    return language_model.language_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op8_weighted_sampling")
def op8_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return weighted_sampling.neighbour_likeness(table(spark, sf_dir, "documents"))


def damaged_turns(turns: DataFrame) -> DataFrame:
    """``turns`` with a fault in every fourth row or so, by the crc32 of its ids; nulls are one space."""
    space = F.lit(" ")

    def known(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), space)

    fault = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % F.lit(20)
    return turns.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), fault.alias("~fault")).select(
        "conv_id",
        "turn",
        F.when(F.col("~fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("~fault") == 1, "").when(F.col("~fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("~fault") == 0, F.array().cast("array<int>")).when(F.col("~fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("~copy"),
    ).drop("~copy")


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults, and the cheapest edits that repair it."""
    turns = table(spark, sf_dir, "conversations")
    found = repair.digests(repair.repair(damaged_turns(turns))).withColumnRenamed("conv_id", "~conv_id")
    every = turns.select("conv_id").distinct()
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit(""), 256)
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("~conv_id")), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256")
    )


@query("op11_quality")
def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document by its nearest labelled documents, a third of which take no part."""
    documents = table(spark, sf_dir, "documents")
    model = quality.train(documents, table(spark, sf_dir, "labels"))
    return quality.with_quality(documents, model, ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document, with counts of links over all documents."""
    return alignment.link_counts(table(spark, sf_dir, "documents"))
