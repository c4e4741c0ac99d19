"""Time the headline queries once each, after one warm-up query. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tallygrid.catalog import QUERIES
from tallygrid.session import local_session

HEADLINE = [
    "d8_brand_stats", "b11_segments", "c1_assemble_panel", "c6_neighbour_search", "d11_describe", "d13_null_profile", "d16_crosstab_pct",
    "d18_quantiles", "d21_basket_totals", "d26_histogram", "d28_kde", "e5_metric_subsets", "h6_slug", "h8_palindrome", "i7_geo_features",
    "j2_spearman", "j5_ols_hc3", "j11_influence", "j12_quantile_regression", "j13_panel_fe", "j15_lowess_grid", "j20_spline_fit",
    "k4_knn_cv", "k5_logit_coefficients", "k12_kmeans_auto", "l3_roc_auc", "l7_threshold_table", "l10_best_threshold", "m1_matmul",
    "w1_demean", "w3_cumulative_lift", "w4_stratified_folds", "w8_integrate_derivative",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench", shared=tempfile.mkdtemp(prefix="spark-"))
    QUERIES["d6_group_mean"](spark, sf_dir).collect()
    took = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    total = round(sum(took.values()), 3)
    scale = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
