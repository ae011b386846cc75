"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query is written to the no-op sink, so every row is computed and none is collected. The best
of BENCH_RUNS runs (default 2) counts, so that JIT warm-up does not hide the plan.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "e25_profile_columns",
    "e06_numeric_stats",
    "e10_distinct_counts",
    "e11_top_values",
    "e04_duplicate_count",
    "e14_histogram",
    "e15_density_curve",
    "e17_corr_matrix",
    "c02_fill_na_mean",
    "c07_forward_fill",
    "c13_one_hot",
    "c14_label_encode",
    "c20_recipe",
    "d01_detect_outliers_iqr",
    "d09_quality_score",
    "f03_downsample",
    "h19_folds_stratified",
    "h33_roc_curve",
    "h34_auc",
    "h24_batch_score",
    "j01_classify_intent",
    "h13_nearest_neighbors",
    "h16_random_forest",
    "h18_xgboost_preset",
    "i02_tree_explanation",
    "e25_full_profile_dashboard",
    "e25_full_profile_engine",
]


def main() -> None:
    from lodestat.plans.catalog import QUERIES
    from lodestat.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    took = {}
    for name in names:
        times = []
        for _ in range(runs):
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
        took[name] = round(min(times), 3)
    line = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
