"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

A figure is the median of three runs, of fewer where a query has already taken ``ENOUGH`` seconds. Each query's seconds
go to stderr as they come.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from strandline import catalog

HEADLINE = ("perf_stats", "corr_matrix", "macro_correlations", "regime_performance", "factor_vs_reference", "block_ranks", "asof_backward", "factor_attribution", "walk_forward", "sharpe_diff_test", "pbo_cscv", "path_summary")
ENOUGH = 30.0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = catalog.queries()
    seconds = {}
    for name in HEADLINE:
        took = []
        while len(took) < 3 and sum(took) < ENOUGH:
            start = time.perf_counter()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took), 3)
        print(name, seconds[name], f"({len(took)} runs)", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
