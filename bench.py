"""Headline queries, timed: prints one JSON line.

Data folder ``$BENCH_SF_DIR``, cores ``$BENCH_CPUS``. Every query is read to the end by a
no-op sink after one small warm-up.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from claimloom.plans import catalog
from claimloom.session import build_session

HEADLINE = [
    "A3_provider_volume", "A12_high_cost_claims", "C9_median_imputation", "F3_provider_features", "F9_gold_features",
    "V6_V7_batch_duplicates", "V9_V10_rule_violations", "V17_scoring_chain", "V13_batch_status", "D4_nearest_vectors", "H6_version_history",
    "M4_random_forest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    with tempfile.TemporaryDirectory(prefix="claimloom-bench-") as shared:
        timed(build_session("claimloom-bench", f"local[{cores}]", cores, shared), folder)


def timed(spark: SparkSession, folder: str) -> None:
    spark.sparkContext.setLogLevel("ERROR")
    runs = {e.name: catalog.runner(e) for e in catalog.entries()}
    runs["Q2_range_checks"](spark, folder).collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        runs[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
