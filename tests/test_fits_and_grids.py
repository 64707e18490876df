import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.operators import decisions as D
from windrow.operators import extra_trees as X
from windrow.operators import models as M
from windrow.plans import composition as C
from windrow.plans import learning as L


class Table:
    """Stands for the views: a named frame."""

    def __init__(self, **frames):
        self.__dict__ |= frames


def test_grid_choice_equals_the_column_form(spark):
    """Action and utility against the definition, with ties, missing values and no quadratic pass over the grid."""
    rows = [(i, None if i % 11 == 5 else 60.0 * (i % 17) / 20, None if i % 13 == 7 else 60.0 * (i % 7) / 8, None if i % 19 == 3 else 60.0 * (i % 23) / 25, 60.0) for i in range(120)]
    df = spark.createDataFrame(rows, "site int, cand double, third double, base double, capacity double").withColumns({"grp": F.lit("g1"), "ts": F.lit(0)})
    plan = C.interval_probability_action(Table(fcst=df))
    assert "array_max" not in plan._jdf.queryExecution().optimizedPlan().toString()
    got = {r["site"]: (r["action"], r["utility"]) for r in plan.collect()}
    for i, cand, third, base, cap in rows:
        if cand is None:
            assert got[i] == (None, None)
            continue
        u = []
        for a in D.ACTION_GRID:
            p6, p8 = max(1 - abs(a - cand / cap) * 9, 0.0), 0.0 if third is None else max(0.9 - abs(a - third / cap) * 6, 0.0)
            p6, p8 = (0.5 * (p6 + p8),) * 2 if p6 > p8 else (p6, p8)
            u.append(-0.5 * min(abs(a - cand / cap), 1.2) + 0.5 * (0.25 * p6 + 0.75 * p8))
        tied = [k for k in range(len(u)) if u[k] >= max(u) - D.TIE]
        best = min(tied, key=lambda k: (0.0 if base is None else abs(D.ACTION_GRID[k] - base / cap), k))
        assert got[i] == (pytest.approx(D.ACTION_GRID[best], abs=1e-6), pytest.approx(u[best], abs=1e-6))


def test_grid_choice_of_odd_utilities(spark):
    nan = float("nan")
    rows = [(0, [1.0, None, 1.0], 0.9), (1, [None, None, None], 0.5), (2, None, 0.5), (3, [nan, 2.0, nan], 0.6), (4, [1.0, 1.0, 0.0], None), (5, [0.0, 1.0, 1.0], 0.75)]
    df = spark.createDataFrame(rows, "i int, u array<double>, b double")
    got = {r["i"]: r["c"] and r["c"]["action"] for r in df.withColumn("c", D.choose_on_grid("u", "b", [0.0, 0.5, 1.0])).collect()}
    assert got == {0: 1.0, 1: None, 2: None, 3: 1.0, 4: 0.0, 5: 0.5}


def test_trees_call_a_node_once_a_block(spark, monkeypatch):
    """Same trees whatever the block, equal to a plain walk, and one visit a node and block instead of one a small batch."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    rows = [(float(a), None if i % 9 == 4 else float(b), float(a > 0) + 0.1 * float(b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, y double").coalesce(1)
    whole = X.grow(df, ["a", "b"], "y", trees=2, depth=3)
    monkeypatch.setattr(X, "BLOCK", 50)
    parts = X.grow(df, ["a", "b"], "y", trees=2, depth=3)
    assert (whole.split == parts.split).all() and whole.threshold == pytest.approx(parts.threshold) and whole.value == pytest.approx(parts.value)
    got = [r["prediction"] for r in whole.score(df).select("prediction").collect()]
    for (a, b, _), p in zip(rows, got):
        want = 0.0
        for t in range(2):
            k = 1
            while whole.split[t, k] >= 0:
                v = (a, b)[whole.split[t, k]]
                k = 2 * k + (0 if v is not None and v <= whole.threshold[t, k] else 1)
            want += whole.value[t, k] / 2
        assert p == pytest.approx(want, abs=1e-12)
    batches = df.toArrow().to_batches(max_chunksize=10)
    assert [b.num_rows for b in X._blocks(iter(batches))] == [50] * 8


def test_independent_fits_run_side_by_side():
    """Each of two fits waits for the other, which only ends if they run together; models keep their order."""
    met = threading.Barrier(2, timeout=30)

    def fit(name):
        met.wait()
        return name

    assert M.side_by_side([lambda: fit("a"), lambda: fit("b")]) == ["a", "b"]


def test_run_table_is_formed_once_for_all_residual_models(spark, monkeypatch):
    """Every fit, scaler and prediction reads kept rows: the weather is read once for the training and once for the applied runs."""
    for kind in ("huber", "boosted"):
        monkeypatch.setattr(M, kind, lambda d, features, target, **params: M.ridge(d, features, target, 1.0))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    hours = spark.range(24 * 25 * 2).select((F.col("id") % 2).cast("int").alias("grid_id"), F.floor(F.col("id") / 2).alias("h"))
    rows = hours.select("grid_id", F.timestamp_add("HOUR", F.col("h"), F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")).alias("forecast_ts"),
                        F.timestamp_add("DAY", F.floor(F.col("h") / 24), F.lit("2024-01-01").cast("timestamp_ntz")).alias("run_key"),
                        (F.col("h") * 7 % 13 / 2.0).alias("u"), (10 + F.col("h") * 5 % 11 / 1.0 + F.col("grid_id")).alias("gust"), F.lit(1.0).alias("t2"))
    out = L.run_residual_models(Table(wx=rows.mapInArrow(counted, rows.schema))).collect()
    assert len(out) == 3 * 24 * 5 * 2 and read.value <= 2 * 24 * 25 * 2


def test_common_factor_keeps_days_and_no_wide_rows(spark, monkeypatch):
    """All 24 columns of every site row were kept, and predictions met the rows of all years by shuffle."""
    from windrow.operators import calibrate as K
    from windrow.operators import models as M
    from windrow.plans import learning as LP

    days = [f"{y}-{m:02d}-{d:02d}" for y in (1997, 1998, 1999, 2000) for m in (2, 7) for d in range(1, 11)]
    values = [(g, s, day, 12.0 + (7 * i + 5 * s) % 41, 9.0 + (11 * i + s) % 37, 11.0 + (5 * i + s) % 40, 8.0 + (3 * i) % 35, 60.0)
              for i, day in enumerate(days) for s, g in enumerate(("g1", "g2", "g3"))]
    fcst = spark.createDataFrame(values, "grp string, site long, ts string, actual double, base double, cand double, third double, capacity double")
    fcst = fcst.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    kept, real = [], LP.checkpoint
    monkeypatch.setattr(LP, "checkpoint", lambda df: kept.append(set(df.columns)) or real(df))
    monkeypatch.setattr(M, "boosted", lambda d, names, target, **_: M.ridge(d, names, target, 1.0))  # any fit will do
    joined, fit_affine = [], K.fit_affine
    monkeypatch.setattr(K, "fit_affine", lambda df, *rest: joined.append(df) or fit_affine(df, *rest))
    out = LP.common_factor_forward(type("V", (), {"fcst": fcst, "spark": spark})())
    assert {r["grp"] for r in out.collect()} == {"g1", "g2", "g3"}
    assert kept and all(columns <= {"ts", *LP.FEATURES, "actual_cf", "n", "common_cf"} for columns in kept)
    assert joined[0].count() == 3 * 40 and {r["y"] for r in joined[0].select(F.year("ts").alias("y")).distinct().collect()} == {1998, 1999}
    assert "SortMergeJoin" not in joined[0]._jdf.queryExecution().executedPlan().toString()
