"""Session settings the record semantics depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that change results, not only speed.
SEMANTIC_CONF = {
    # attributes `a` and `A` may live side by side
    "spark.sql.caseSensitive": "true",
    # date-times carry no zone; epoch arithmetic is done in UTC
    "spark.sql.session.timeZone": "UTC",
    # a value that cannot be converted fails the conversion
    "spark.sql.ansi.enabled": "true",
}

# Settings that keep plans healthy on large, skewed inputs.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join even where that costs one more shuffle afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # beyond this many rows a sorted page is taken from a distributed sort
    # instead of per-task heaps merged on the driver
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
}

# Settings a session can only be started with.
STATIC_CONF = {
    # capturing a call site per column operation makes wide plans slow to build
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings above to an existing session and return it."""
    for key, value in {**SEMANTIC_CONF, **SCALE_CONF}.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "recordloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SEMANTIC_CONF, **SCALE_CONF, **STATIC_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local run may leave it unset; its scratch folders are then made below the warehouse.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/recordloom-scratch"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured
