"""Wall time of the quality analytics queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3).
Each query runs its whole plan into a no-op sink, BENCH_RUNS times; the median
counts.  A query that isn't measured warms the session up first.  The stored
tables are made once, before their queries are measured, and reported as stored_run.
"""

from __future__ import annotations

import json
import os
import sys
import time

from statistics import median

from fleetlens.plans.registry import QUERIES
from fleetlens.session import local_session, remove_scratch


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(QUERIES)
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus), app="fleetlens-bench")
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand").count().collect()
    seconds = {}
    if any(n.startswith("stored_") or n in ("gold_checks", "summary_cards") for n in names):
        seconds["stored_run"] = run("stored_counts")
    seconds |= {name: round(median(run(name) for _ in range(runs)), 3) for name in names}
    remove_scratch(spark)
    print(json.dumps({
        "metric": "total wall time of all queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
