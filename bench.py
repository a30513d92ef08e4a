"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "protein_matrix", "range_join", "nearest_asof_join", "best_per_key", "summary_stats", "interp_quantiles", "intensity_matrix", "tic_normalize", "replicate_cv", "unique_rollup", "roc_auc",
    "moving_sum_fwd", "moving_median_baseline", "savgol9", "trapezoid_area", "apex_centroid", "bh_adjust", "tdc_qvalue", "evalue_fit", "linreg", "cosine", "spearman", "tokenize_mods", "cleave", "topk_exclusion", "lda_semisup",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    work = tempfile.mkdtemp(prefix="peakfold-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{work}").config("spark.sql.files.maxPartitionBytes", "4m").config("spark.sql.files.openCostInBytes", "1m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from peakfold.plans import catalog

    queries = catalog.queries()
    names = sys.argv[1:] or [n for n in HEADLINE if n in queries]
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(repeats + 1):  # the first run compiles code and is not counted
            began = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "sum of median seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
