"""Wall-clock seconds of the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores, BENCH_QUERIES a
comma-separated subset. Queries run once untimed on BENCH_WARM_DIR first, if it exists.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from rankloom.plans.queries import QUERIES
from rankloom.session import get_spark

HEADLINE = (
    "popularity_metrics dedup_latest kcore split_temporal split_random relevance_labels user_history sequence_export "
    "negative_samples interaction_graph graph_smooth item_neighbors neighbor_metrics transition_metrics dot_top_k "
    "dot_target_ranks candidate_scores encode_numeric encode_categories encode_lists clean_pages clean_documents "
    "entity_stats class_counts enrollment_events atomic_export friedman stream_history"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        # One untimed run on the smallest tables, so that times show queries, not start-up.
        for name in chosen:
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in chosen:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name:24s} {times[name]:8.3f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
