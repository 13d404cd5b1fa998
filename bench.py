"""Benchmark: headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR.

Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query is executed completely (``noop`` sink: every row computed,
nothing shipped to the driver) in one warm session: every headline query
runs once on the smallest tables, and the flagship once, untimed, at the
measured scale factor (JVM code generation and Python workers warm; no
data is cached by Spark).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "retrieval_eval",
    "bm25_top3",
    "postings",
    "knn_top10",
    "knn_filtered",
    "trim_history",
    "attempts",
    "change_log",
    "describe",
    "split_counts",
    "histogram",
    "chunk_stride",
    "halstead",
    "top_reasons",
    "patch_exact",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from glean.plans.registry import load_all
    from glean.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="glean-bench")
    reg = load_all()
    # Warm-up on the smallest tables (JIT, code generation, Python workers);
    # nothing of the measured scale factor is read or cached here.
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in HEADLINE:
            reg[name].fn(spark, warm_dir).write.format("noop").mode("overwrite").save()
    reg[HEADLINE[0]].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        reg[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
