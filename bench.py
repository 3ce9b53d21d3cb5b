"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from runledger import get_session
from workload import QUERIES

HEADLINE = (
    "span_pairs", "span_pairs_split", "nested_spans", "log_iterations", "log_iterations_split", "log_epochs", "log_evals",
    "log_parse_quality", "stream_spans_in_batches", "log_files_numbered", "event_positions", "best_event_per_user",
    "slots_last_wins", "paired_rows", "tail_n", "ordered_arrays", "evaluation_slots", "best_model_per_iteration",
    "best_model_per_job", "accuracy_curves", "result_files", "job_eta", "job_tree", "update_latest", "upsert_latest",
    "transitions", "metadata_merge", "request_validation", "derived_configs", "sync_plan",
)


def main(names: list[str]) -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = get_session(
        "bench", master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count().collect()
    seconds = {}
    for name in names or HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
