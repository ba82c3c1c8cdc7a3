"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Median of $BENCH_RUNS after one warm-up."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from codeweft.catalog import all_queries
from codeweft.session import build_session

QUERIES = [
    "bm25_topk",
    "vector_topk",
    "rrf_fuse",
    "neighbors",
    "expand_graph",
    "shortest_call_path",
    "resolve_edges",
    "suggest_prefix",
    "extract_symbols",
    "build_graph",
    "route_messages",
    "answer_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or QUERIES
    spark = build_session(
        "codeweft-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(2 * int(cpus) if cpus.isdigit() else 16),
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered, spent = all_queries(), {}
    for name in names:
        times = []
        for attempt in range(runs + 1):
            started = time.perf_counter()
            # Every row and column is computed and thrown away.
            registered[name](spark, folder).write.format("noop").mode("overwrite").save()
            if attempt:
                times.append(time.perf_counter() - started)
        spent[name] = round(statistics.median(times), 3)
        print(f"{name}: {spent[name]}", file=sys.stderr, flush=True)
    total = round(sum(spent.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": spent, "sf": os.path.basename(folder)}))


if __name__ == "__main__":
    main()
