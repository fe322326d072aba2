"""Seconds for each headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from meterloom import catalog

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
HEADLINE = "usage_hourly_series canonical_bucket two_winners two_registers top_n_per_group max_merge latest_revision_join interval_overlap keyed_diff reconcile local_day_series point_state latency_percentiles lag_increments session_segments price_rows price_marginals two_stage_agg conditional_agg repeated_result redact".split()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    for name in HEADLINE:
        best = []
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - start)
        took[name] = round(min(best), 3)
    print(json.dumps({"metric": "headline queries, best of two, summed", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
