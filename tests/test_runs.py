"""Run isolation, smoothing facts, gap filling, shape features against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.functions import timekeys as T
from windrow.functions.ranks import average_ranks, exact_quantiles, normal_quantile, quantile_grid, running_totals
from windrow.operators import checks as C
from windrow.operators import gaps, runs

SCHEMA = "forecast_ts string, x double"


def two_runs(spark, second=100.0):
    rows = [(f"2024-01-{1 + (h + 1) // 24:02d} {(h + 1) % 24:02d}:00:00", float(h if h < 24 else second + h - 24)) for h in range(48)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("forecast_ts", F.col("forecast_ts").cast("timestamp_ntz"))
    return df.withColumn("run_key", T.run_key("forecast_ts"))


def test_run_key_keeps_midnight_with_the_day_before(spark):
    df = two_runs(spark).groupBy("run_key").count().orderBy("run_key").collect()
    assert [r["count"] for r in df] == [24, 24]
    assert str(df[0]["run_key"]) == "2024-01-01 00:00:00"


def test_smoothing_on_a_ramp_changes_only_the_edges(spark):
    out = runs.smooth(two_runs(spark), "x", 0.2, ["run_key"], "forecast_ts").orderBy("forecast_ts").collect()
    assert out[0]["smoothed"] == pytest.approx(0.1)
    assert out[23]["smoothed"] == pytest.approx(22.9)
    assert out[11]["smoothed"] == pytest.approx(11.0)
    assert out[24]["smoothed"] == pytest.approx(100.1)


def test_incomplete_run_fails(spark):
    with pytest.raises(Exception, match="24 contiguous"):
        runs.smooth(two_runs(spark).limit(30), "x", 0.2, ["run_key"], "forecast_ts").collect()


def test_changing_one_run_leaves_the_other_alone(spark):
    first = lambda second: [tuple(r) for r in runs.run_shape(two_runs(spark, second), ["x"], ["run_key"]).where(F.col("run_key") < F.lit("2024-01-02").cast("timestamp_ntz")).orderBy("position").collect()]
    assert first(100.0) == first(-7.0)


def test_shape_features_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=24)
    df = spark.createDataFrame([(h, float(x[h])) for h in range(24)], "h int, x double").withColumn(
        "forecast_ts", F.timestamp_add("HOUR", F.col("h") + 1, F.lit("2024-03-05").cast("timestamp_ntz"))).withColumn("run_key", T.run_key("forecast_ts"))
    out = runs.run_shape(df, ["x"], ["run_key"]).orderBy("position").collect()
    fft = np.fft.rfft(x) / 24
    h = np.arange(24) - 11.5
    row = out[5]
    assert row["x__run_std"] == pytest.approx(x.std())
    assert row["x__run_q25"] == pytest.approx(np.quantile(x, 0.25))
    assert row["x__run_linear_slope"] == pytest.approx((x @ h) / (h ** 2).sum())
    assert row["x__run_fft2_imag"] == pytest.approx(fft[2].imag)
    assert row["x__run_peak_position"] == pytest.approx(np.argmax(x) / 23)
    rank = np.argsort(np.argsort(x, kind="stable"), kind="stable") / 23
    assert [r["x__within_run_rank"] for r in out] == pytest.approx(list(rank))


def test_dct_is_orthonormal(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=24)
    df = spark.createDataFrame([(0, h, float(x[h])) for h in range(24)], "r int, h int, x double")
    out = runs.dct_coefficients(df, "x", ["r"], "h", 24).first()
    assert sum(out[f"x__dct_{k}"] ** 2 for k in range(24)) == pytest.approx((x ** 2).sum())


def test_anchor_values_survive_interpolation(spark):
    anchors = [1, 4, 7, 10, 13, 16, 19, 22, 24]
    df = spark.createDataFrame([("d", p, p * 0.1 + (p % 3)) for p in anchors], "day string, p int, v double")
    out = runs.interpolate_anchors(df, ["v"], ["day"], "p", F.sequence(F.lit(1), F.lit(24))).orderBy("p").collect()
    assert [r["p"] for r in out] == list(range(1, 25))
    want = np.interp(range(1, 25), anchors, [p * 0.1 + (p % 3) for p in anchors])
    assert [r["v"] for r in out] == pytest.approx(list(want))


def test_gap_fill_uses_midpoint_then_space_then_training(spark):
    base = "2024-01-01 {:02d}:00:00"
    rows = [("i", g, base.format(h), v) for g, vals in {1: [1.0, None, None, 7.0], 2: [None, 2.0, None, None], 3: [None] * 4}.items() for h, v in enumerate(vals)]
    rows += [("j", 1, "2024-01-02 00:00:00", None)]
    df = spark.createDataFrame(rows, "issued_ts string, grid_id int, forecast_ts string, x double").withColumn("forecast_ts", F.col("forecast_ts").cast("timestamp_ntz"))
    out = gaps.fill_gaps(df, ["x"], spark.createDataFrame([("x", 9.0)], "variable string, median double"))
    got = {(r["issued_ts"], r["grid_id"], r["forecast_ts"].hour): r["x"] for r in out.collect()}
    assert got[("i", 1, 1)] == 4.0 and got[("i", 1, 2)] == 4.0
    assert got[("i", 2, 0)] == 2.0 and got[("i", 2, 3)] == 2.0
    assert got[("i", 3, 0)] == 1.5 and got[("i", 3, 3)] == 4.5
    assert got[("j", 1, 0)] == 9.0


def test_recency_weights_have_mean_one_and_refuse_the_future(spark):
    df = two_runs(spark).select("forecast_ts")
    end = F.lit("2024-01-03").cast("timestamp_ntz")
    out = runs.recency_weights(df, "forecast_ts", end, 2.0)
    assert out.agg(F.avg("weight")).first()[0] == pytest.approx(1.0)
    with pytest.raises(Exception, match="after the training end"):
        runs.recency_weights(df, "forecast_ts", F.lit("2024-01-01 05:00:00").cast("timestamp_ntz"), 2.0).collect()


def test_cutoff_is_two_in_the_afternoon_of_the_day_before(spark):
    rows = [("2024-01-05 01:00:00", "2024-01-04 14:00:00", False), ("2024-01-06 00:00:00", "2024-01-04 14:00:01", True), ("2024-01-05 00:00:00", "2024-01-03 15:00:00", True)]
    df = spark.createDataFrame(rows, "ts string, a string, late boolean").select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("a").cast("timestamp_ntz").alias("a"), "late")
    assert all(r["late"] == r["got"] for r in df.withColumn("got", C.after_cutoff("ts", "a")).collect())


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(2)
    data = [("hot", float(np.round(rng.normal(), 2))) for _ in range(3000)] + [("a", float(i % 7)) for i in range(50)] + [("one", 4.0)]
    return data, spark.createDataFrame(data, "k string, x double").repartition(4)


def test_exact_quantiles_equal_numpy(skewed):
    data, df = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for r in exact_quantiles(df, ["k"], "x", probs).collect():
        assert r["q"] == pytest.approx(list(np.quantile([x for k, x in data if k == r["k"]], probs)))


def test_quantile_grid_equals_numpy(skewed):
    data, df = skewed
    out = quantile_grid(df, ["k"], "x", 257).collect()
    for k in ("hot", "a", "one"):
        got = [r["q"] for r in sorted((r for r in out if r["k"] == k), key=lambda r: r["i"])]
        assert got == pytest.approx(list(np.quantile([x for g, x in data if g == k], np.linspace(0, 1, 257))))


def test_average_ranks_share_ties(skewed):
    data, df = skewed
    got = {r["x"]: r["r"] for r in average_ranks(df.where(F.col("k") == "a"), ["k"], "x", "r").collect()}
    assert got[0.0] == pytest.approx(4.5) and got[6.0] == pytest.approx(47.0)


def test_running_totals_cover_every_partition(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").alias("o"), F.lit(1).alias("v"))
    out = running_totals(df, ["k"], ["o"], {"c": F.sum("v")}).orderBy("o").collect()
    assert [r["c"] for r in out] == list(range(1, 1001))


def test_normal_quantile(spark):
    from statistics import NormalDist

    ps = [1e-9, 0.001, 0.02, 0.3, 0.5, 0.8, 0.99, 1 - 1e-7]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(normal_quantile(F.col("p")).alias("z")).collect()
    assert [r["z"] for r in got] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-8, abs=1e-12)
