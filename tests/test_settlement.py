"""Literal facts of the settlement metric and invariants of what is derived from it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.operators import bootstrap as B
from windrow.operators import settlement as S
from windrow.operators import utility as U


def rows(spark, data):
    return spark.createDataFrame(data, "grp string, actual double, forecast double, capacity double")


def test_price_edges_are_inclusive(spark):
    df = rows(spark, [("g", 50.0, 56.0, 100.0), ("g", 50.0, 58.0, 100.0), ("g", 50.0, 58.000001, 100.0)])
    out = S.group_metrics(df, ["grp"], "forecast").first()
    assert out["ficr"] == pytest.approx(7 / 12)
    assert (out["within_6_count"], out["within_8_count"], out["over_8_count"]) == (1, 1, 1)


def test_ten_percent_floor_is_inclusive_and_missing_actuals_are_left_out(spark):
    df = rows(spark, [("g", 10.0, 10.0, 100.0), ("g", 9.999, 0.0, 100.0), ("g", None, 0.0, 100.0), ("g", float("nan"), 0.0, 100.0)])
    assert S.group_metrics(df, ["grp"], "forecast").first()["n_evaluated"] == 1


def test_missing_forecast_on_a_scored_row_is_an_error(spark):
    df = rows(spark, [("g", 50.0, None, 100.0)])
    with pytest.raises(Exception, match="non-finite forecast"):
        S.group_metrics(df, ["grp"], "forecast").collect()


def test_groups_weigh_the_same(spark):
    data = [("a", 50.0, 50.0, 100.0)] * 5 + [("b", 50.0, 57.0, 100.0), ("c", 50.0, 59.0, 100.0)]
    total = S.macro_score(S.group_metrics(rows(spark, data), ["grp"], "forecast")).first()["total_score"]
    assert total == pytest.approx(0.5 * (1 - (0 + 0.07 + 0.09) / 3) + 0.5 * (1 + 0.75 + 0) / 3)
    assert total == pytest.approx(0.765)


def random_rows(spark, n=400):
    rng = np.random.default_rng(5)
    return spark.createDataFrame(
        [(f"g{i % 3}", i, float(rng.uniform(0, 60)), float(rng.uniform(0, 60)), float(rng.uniform(0, 60)), 60.0) for i in range(n)],
        "grp string, id int, actual double, base double, cand double, capacity double")


def test_row_utility_means_to_the_score(spark):
    df = random_rows(spark)
    mean = U.with_mean_actual(df).withColumn("u", U.row_utility("base")).groupBy("grp").agg(F.avg("u").alias("u"))
    scores = S.group_metrics(df, ["grp"], "base").join(mean, "grp").collect()
    for r in scores:
        assert r["u"] == pytest.approx(0.5 * r["one_minus_nmae"] + 0.5 * r["ficr"], abs=1e-12)


def test_rowwise_oracle_is_at_least_as_good_as_every_candidate(spark):
    df = random_rows(spark)
    best = U.rowwise_best(df, ["base", "cand"], "base")
    score = lambda d, c: {r["grp"]: 0.5 * r["one_minus_nmae"] + 0.5 * r["ficr"] for r in S.group_metrics(d, ["grp"], c).collect()}
    top, a, b = score(best, "oracle"), score(df, "base"), score(df, "cand")
    assert all(top[g] >= max(a[g], b[g]) - 1e-12 for g in top)
    outside = best.where(F.col("actual") < 6).where(F.col("selected") != "base").count()
    assert outside == 0


def test_smooth_loss_gradient_matches_finite_differences(spark):
    df = spark.createDataFrame([(p / 50, 0.4) for p in range(5, 45)], "p double, y double")
    h = 1e-6
    loss, grad, curve = U.smooth_settlement_loss("p", "y", F.lit(0.5))
    up, _, _ = U.smooth_settlement_loss(F.col("p") + h, "y", F.lit(0.5))
    down, _, _ = U.smooth_settlement_loss(F.col("p") - h, "y", F.lit(0.5))
    for r in df.select(grad.alias("g"), ((up - down) / (2 * h)).alias("n"), curve.alias("c"), loss.alias("l")).collect():
        assert r["g"] == pytest.approx(r["n"], abs=1e-5, rel=1e-5)
        assert 0.001 <= r["c"] <= 200.0


def test_bootstrap_of_identical_forecasts_is_zero_and_blocks_wrap(spark):
    data = [("g1" if i % 2 else "g2", f"2024-01-{i // 2 + 1:02d} 12:00:00", 30.0 + i, 31.0, 31.0, 60.0) for i in range(40)]
    df = spark.createDataFrame(data, "grp string, ts string, actual double, base double, cand double, capacity double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    daily = B.daily_totals(df, "base", ["cand"], F.lit(1))
    out = B.block_bootstrap(daily, "base", ["cand"], replicates=25)
    assert out.count() == 25
    assert out.agg(F.max(F.abs("delta_cand"))).first()[0] == 0.0


def test_bootstrap_equals_a_direct_resampling(spark):
    rng = np.random.default_rng(3)
    days = 17
    data = [("g1", d, float(rng.uniform(10, 60)), float(rng.uniform(10, 60)), float(rng.uniform(10, 60)), 60.0) for d in range(days)]
    df = spark.createDataFrame(data, "grp string, d int, actual double, base double, cand double, capacity double").withColumn(
        "ts", F.timestamp_add("DAY", F.col("d"), F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")))
    out = {r["replicate"]: r["delta_cand"] for r in B.block_bootstrap(B.daily_totals(df, "base", ["cand"], F.lit(7)), "base", ["cand"], 6).collect()}
    import hashlib

    def score(pred, act):
        e = np.abs(pred - act) / 60
        return 0.5 * (1 - e.mean()) + 0.5 * (act * np.where(e <= 0.06, 4, np.where(e <= 0.08, 3, 0))).sum() / (4 * act.sum())

    a, b, c = (np.array([r[i] for r in data]) for i in (2, 3, 4))
    for rep in range(6):
        picked = []
        for block in range(3):
            start = int(hashlib.md5(f"7-{rep}-{block}".encode()).hexdigest()[:8], 16) % days
            picked += [(start + k) % days for k in range(7)]
        picked = picked[:days]
        assert out[rep] == pytest.approx(score(c[picked], a[picked]) - score(b[picked], a[picked]), abs=1e-12)
