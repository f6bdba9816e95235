"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each registered query is executed to completion with the ``noop`` sink (all
rows computed, nothing collected) after one untimed warm-up query; its time is
the median of three runs, or of fewer once $BENCH_SECONDS (default 400) have
passed.  The Spark start-up is excluded.  Prints one JSON line: {"metric",
"value", "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "ag1",    # daily -> weekly aggregation (one partial-aggregate shuffle)
    "fe14",   # full model-ready feature pipeline (checkpoints, quantile selection)
    "cl22",   # full cleaning pipeline on the damaged table
    "ml11",   # flagship: weekly features -> one-feature OLS -> metrics
    "ml14",   # train pipeline: Gram fit + 5 time folds + summary
    "ml16",   # ridge tuning: 50 alphas x 5 folds from one Gram aggregate
    "cv4",    # fold detail (one scoring pass)
    "kp13",   # overall KPI score (several KPI aggregates)
    "dg6",    # Anderson-Darling with distributed ranks
    "dg11",   # residual outlier flags (quantiles + projection)
    "sc5",    # batch scenario scoring (row-local, codegen)
    "wn2",    # 7-row creator windows
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    from growthspark.session import get_spark
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                      conf={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g")})
    from growthspark.plans import load_all
    from growthspark.plans.registry import spark_queries
    load_all()
    qs = spark_queries()
    limit = float(os.environ.get("BENCH_SECONDS", "400"))

    def run(n):
        t0 = time.time()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.time() - t0

    run("ag1")  # warm the JVM
    began, times = time.time(), {}
    for n in names:
        taken = [run(n)]
        while len(taken) < 3 and time.time() - began < limit * (len(times) + 1) / len(names):
            taken.append(run(n))
        times[n] = round(statistics.median(taken), 3)
    total = round(sum(times.values()), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
