"""Headline timings: prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma separated subset).
"""

from __future__ import annotations

import json
import os
import time

from windrow.plans import load_all
from windrow.session import build_session

HEADLINES = (
    "settlement_by_group", "year_slice_comparison", "time_regime_comparison", "bootstrap_score_deltas", "run_shape_features", "run_sequence_features",
    "gap_fill", "idw_interpolation", "wake_layout_features", "terrain_horizon", "joint_provider_features", "telemetry_hourly", "isotonic_power_curve",
    "hourly_states", "simplex_blend", "locked_forecast_chain", "affine_calibration", "ordinal_class_action", "forest_weighted_mean", "wasserstein_shift",
    "rank_associations", "energy_weighted_auc", "past_run_neighbours", "cutoff_window_summary", "record_index_ranges",
)

#: fits take longer than any headline, so they are timed beside them and not added to the total
MODELS = ("density_ratio_weights", "seasonal_wind_ridge", "shared_regressor", "analog_run_forecast", "leaf_empirical_decision")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINES)
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    entries = load_all()
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start the executors before timing

    def seconds(name: str) -> float:
        start = time.perf_counter()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    timings = {name: seconds(name) for name in names}
    models = {} if "BENCH_QUERIES" in os.environ else {name: seconds(name) for name in MODELS}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "models": models,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
