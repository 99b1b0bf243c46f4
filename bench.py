"""Benchmark: build the claims warehouse and run every registered query.

Runs on local[$BENCH_CPUS] against $BENCH_SF_DIR (default /root/testdata/sf0.1)
and prints ONE JSON line:
  {"metric": "report_suite_total", "value": <sec>, "unit": "sec",
   "queries": {name: sec, ...}, "sf": ...}

Stages (the same split the original pipeline has: build, then dashboards):
  build_raw   derive the raw claims tables from the driver tables, write parquet
  build_star  build the 6 dimensions + 2 facts from them, write parquet
  <query>     each registered query against the written tables, executed
              with a `noop` write (the whole plan runs, every column is
              produced, nothing is pulled into the Python driver)
  e2e_*       the flagship report straight from the driver tables (no
              materialised inputs), to show the cost of the whole lineage
`value` is the sum of the per-query times (the dashboard suite).
Streaming queries (which write their own tables) are timed separately.
Before timing, one report runs end to end on the smallest data set to warm
the JVM (class loading, JIT, codegen caches); that run is not timed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SKIP = {"stream_fact_claims", "run_history", "stream_status"}   # write files; timed once below


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("lossledger-bench")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", str(max(8, cpus * 2)))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "16g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    from lossledger.catalog import builders
    from lossledger.context import Context
    from lossledger.plans.reports import region_performance
    from lossledger.shared import shared_dir

    run_dir = shared_dir(spark, "bench")
    times: dict[str, float] = {}

    def timed(name, fn):
        t = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t, 3)
        return out

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    # warm-up (JVM, codegen caches), not timed
    warm_dir = "/root/testdata/sf0.001" if os.path.isdir("/root/testdata/sf0.001") else sf_dir
    run(region_performance(Context(spark, warm_dir)))

    raw_dir, star_dir = f"{run_dir}/raw", f"{run_dir}/star"
    timed("build_raw", lambda: Context(spark, sf_dir).raw.materialize(raw_dir))
    ctx_raw = Context(spark, sf_dir, raw_dir=raw_dir)

    timed("build_star", lambda: ctx_raw.star.write(star_dir))

    suite = 0.0
    for key, builder in sorted(builders().items()):
        if key in SKIP:
            continue
        ctx = Context(spark, sf_dir, raw_dir=raw_dir, star_dir=star_dir)
        t = time.perf_counter()
        run(builder(ctx))
        dt = time.perf_counter() - t
        times[key] = round(dt, 3)
        suite += dt

    timed("e2e_region_performance", lambda: run(region_performance(Context(spark, sf_dir))))
    from lossledger.streaming.pipeline import stream_fact_claims
    timed("stream_fact_claims", lambda: stream_fact_claims(Context(spark, sf_dir, raw_dir=raw_dir,
                                                                    star_dir=star_dir)).count())

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "report_suite_total", "value": round(suite, 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus,
                      "n_queries": len([k for k in builders() if k not in SKIP])}))
    spark.stop()


if __name__ == "__main__":
    main()
