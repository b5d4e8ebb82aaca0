"""Time the headline queries; prints one line of JSON.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
tables and the cores. Each query runs once to warm up and is then timed from
building its plan to writing its last row to a sink that discards it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from recordloom.plans import registry  # noqa: E402
from recordloom.session import build_session  # noqa: E402

HEADLINE = [
    "get_record", "filter_ids_and_term", "term_string", "term_number", "term_array_string", "term_array_number",
    "term_datetime", "term_json", "sort_attr", "page", "page_deep", "page_with_total", "scan_ordered", "read_relations",
    "hop_scalar", "hop_array", "hop_chain", "hop_array_after_array", "related_with_array", "edge_replace",
    "expr_path", "expr_shared", "expr_shape", "expr_template", "expr_eval_array",
    "infer_cell", "infer_column", "infer_array", "tsv_infer", "recognisers", "relation_targets", "type_mismatch",
    "convert_string_number", "convert_number_datetime", "convert_array_number_string", "describe_types", "widen_column",
    "upsert_batch", "upsert_broadcast", "apply_changes", "apply_changes_batched", "patch_record", "delete_ids",
    "delete_blocked", "dangling_edges", "tsv_scan", "tsv_load", "json_ops", "nested_base", "import_relations",
    "manifest_relations", "tsv_export", "entity_ops", "sink_upsert", "status_fold", "status_classify", "job_elapsed",
    "import_rules", "stream_upsert", "json_ops_apply", "tsv_upload",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "recordloom-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    queries, _ = registry.load()
    wanted = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in wanted:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
