"""Benchmark: run the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed in full with the ``noop`` sink (every row computed,
nothing collected).  ``value`` is the sum of the per-query seconds.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from winnow.plans.queries import QUERIES  # noqa: E402
from winnow.session import get_spark  # noqa: E402

HEADLINE = [
    "select_bm25", "bm25_max", "bm25_anchor", "chat_to_record", "mix_sources", "select_random",
    "encode_position_pool", "select_embedding", "nearest_neighbor", "weights_embed",
    "select_ppl", "select_ifd", "select_miwv", "influence_score", "stream_reweight",
    "policy_diversity",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", app="winnow-bench", shuffle_partitions=2 * cpus,
                      conf={"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    # Warm up the JVM (JIT) and the Python workers outside the timings: each
    # query once on the smallest scale factor (different files, nothing cached).
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in names:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
