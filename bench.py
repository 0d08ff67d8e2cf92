"""Time the headline queries and print one JSON line.

Each query is built and written to the ``noop`` sink, so every row and column is computed and nothing
is collected. ``queries`` holds the second run of each, with code already compiled; ``first_run`` the
first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from curvelake.operators import search as se
from curvelake.operators.grouped import release
from curvelake.plans import load_registry
from curvelake.session import get_session
from curvelake.sources import bindings as b

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "s01_clean_light_curve", "s03_noise_segments", "a01_bin_mean", "a02_global_view", "a03_local_view",
    "a04_normalize_view", "w08_deepest_bin", "a10_fold_bin", "a11_white_sigma", "a12_quality_metrics",
    "w02_running_median", "w04_flatten", "w04_flatten_own_window", "j05_gap_mask", "a05_box_periodogram",
    "x03_periodogram_arrow", "a08_box_least_squares", "a09_refine_epoch", "a13_roc_auc", "a18_completeness",
    "a21_sbc_ranks", "a22_sbc_uniformity", "a25_interval_coverage", "a32_posterior_summary",
    "a35_stratified_characterization", "a28_wasserstein", "a30_jensen_shannon", "a41_marginal_log_likelihood",
    "a42_importance_weights", "w09_resample", "f19_model_flux", "a50_gate_report", "a54_loss_trend",
    "s08_manifest", "t06_windowed_throughput",
)


def periodogram_256(engine):
    return lambda spark, sf: se.box_periodogram(b.sparse_cadence(spark, sf), 0.5, 13.0, 256, engine=engine)


def main() -> None:
    spark = get_session(
        "curvelake-bench", master=f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.driver.host": "127.0.0.1"},
    )
    spark.sparkContext.setLogLevel("OFF")
    registry = load_registry()
    plans = {name: registry[name].build for name in HEADLINE}
    plans["periodogram_256_sql"] = periodogram_256("sql")
    plans["periodogram_256_arrow"] = periodogram_256("pandas")
    wanted = sys.argv[1:]
    b.sparse_cadence(spark, SF_DIR).groupBy("object_id").agg(F.avg("flux")).write.format("noop").mode("overwrite").save()
    seconds, first = {}, {}
    for name, build in plans.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        for into in (first, seconds):
            start = time.perf_counter()
            build(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            into[name] = round(time.perf_counter() - start, 3)
            release()
    objects = b.sparse_cadence(spark, SF_DIR).select("object_id").distinct().count()
    rate = {k: round(objects / v, 1) for k, v in seconds.items() if k.startswith("periodogram_256")}
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": SF_DIR, "cpus": int(CPUS), "curves_per_second": rate,
        "first_run_total": round(sum(first.values()), 3), "first_run": first,
    }))


if __name__ == "__main__":
    main()
