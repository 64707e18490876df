"""Results that must not depend on the size of a farm, the number of nodes or repeated rows."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.operators import analogs as N
from windrow.operators import calibrate as K
from windrow.operators import decisions as D
from windrow.operators import design
from windrow.operators import models as M
from windrow.operators import spatial as X
from windrow.operators import telemetry as TE
from windrow.plans import composition as C


def test_leaf_utility_equals_all_pairs():
    rng = np.random.default_rng(5)
    residuals = np.sort(np.r_[rng.normal(0, 0.3, 200).round(2), np.zeros(7), [-2.0, 2.0]])
    base, steps = np.r_[rng.uniform(0, 1.1, 30).round(2), 0.0, 1.2], np.asarray(D.ACTION_DELTAS)
    actions, outcomes = np.clip(base[:, None] + steps, *D.ACTION_BOUNDS), np.clip(base[:, None] + residuals, *D.OUTCOME_BOUNDS)
    want = D._expected(actions, outcomes, np.ones((len(base), len(residuals))), np.full(len(base), 0.4))
    assert D._leaf_utility(residuals, base, steps, 0.4) == pytest.approx(want, abs=1e-9)
    assert not D._leaf_utility(np.zeros(0), base, steps, 0.4).any()


def test_runs_of_one_day_are_told_apart_by_member(spark):
    rng = np.random.default_rng(6)
    rows = [(day, cell, rng.normal(size=3).tolist()) for day in range(6) for cell in (0, 1, 10_000, 20_000)]
    df = spark.createDataFrame(rows, "run int, cell int, embedding array<double>")
    got = {}
    for r in N.past_neighbours(df, df, 3, member="cell", block=2, block_rows=3).collect():
        got.setdefault((r["run"], r["member"]), []).append((r["rank"], r["neighbour"], r["neighbour_member"]))
    for day, cell, v in rows:
        past = sorted((np.linalg.norm(np.subtract(v, w)), d, c) for d, c, w in rows if d < day)[:3]
        assert [x[1:] for x in sorted(got.get((day, cell), []))] == [p[1:] for p in past]


def test_leave_one_out_median_of_many_members(spark):
    rng = np.random.default_rng(7)
    values = [None if i % 7 == 0 else float(v) for i, v in enumerate(rng.integers(0, 9, 600))]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("b", 0, 1.0), ("c", 0, None), ("c", 1, 5.0)], "k string, m int, v double")
    got = {(r["k"], r["m"]): r["peer_median"] for r in TE.leave_one_out_median(df, ["k"], "m", "v").collect()}
    for i in range(600):
        assert got["a", i] == np.median([v for j, v in enumerate(values) if j != i and v is not None])
    assert got["b", 0] is None and got["c", 0] == 5.0 and got["c", 1] is None


def test_node_rows_hold_what_the_matrix_holds(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-01 05:00:00' + make_interval(0, 0, 0, 0, id % 5) AS forecast_ts, timestamp_ntz'2024-02-29 12:00:00' AS issued_ts, CAST(id div 5 AS int) AS grid_id, CAST(id AS double) AS u FROM range(40)")
    long = {(r["forecast_ts"], r["grid_id"]): r for r in design.node_rows(df, ["u"]).collect()}
    assert len(long) == 40
    for r in design.node_matrix(df, ["u"], [0, 7]).collect():
        for g in (0, 7):
            assert r[f"grid_{g:02d}__u"] == long[r["forecast_ts"], g]["value"] and r["lead_hours"] == long[r["forecast_ts"], g]["lead_hours"]


def test_equal_rows_stay_apart_in_the_interval_policy(spark):
    train = spark.range(300).select((F.col("id") % 10 / 10.0).alias("b"), (0.1 + F.col("id") % 9 / 10.0).alias("y"))
    ask = spark.createDataFrame([(0.3,), (0.3,), (0.5,)], "b double")
    out = M.interval_policy(train, ask, ["b"], "y", "b", [0.0, 0.5, 1.0], maxIter=1, maxDepth=2).collect()
    assert sorted(r["b"] for r in out) == [0.3, 0.3, 0.5] and len({(r["action"], r["utility"]) for r in out if r["b"] == 0.3}) == 1


def test_small_groups_take_their_level(spark):
    rows = [("big", i, float(i % 5), 10.0 + i % 5) for i in range(120)] + [("small", i, 1.0, 3.0) for i in range(120, 130)]
    df = spark.createDataFrame(rows, "grp string, t int, x double, y double")
    lone = spark.createDataFrame([("new", 999, 1.0)], "grp string, t int, x double")
    early = F.col("t") < 125
    out = M.auxiliary_predictions(df.drop("y").unionByName(lone), df.drop("x"), ["grp", "t"], ["x"], ["y"], [(early, ~early)], "grp", {"y": (0.0, 11.5)}, maxIter=2, maxDepth=2)
    got = {(r["grp"], r["t"]): r["pred_y"] for r in out.collect()}
    assert got["small", 129] == 3.0 and got["new", 999] == 11.5 and got["big", 0] is None and len(got) == 131


def test_flow_projection_orders_turbines_downwind(spark):
    turbines = spark.createDataFrame([("f", i, 37.0, 128.0 + 0.01 * i, 3.0, 126.0) for i in range(3)], "farm string, turbine_id int, lat double, lon double, capacity_mw double, rotor_m double")
    wind = spark.createDataFrame([(h, i, u, 0.0) for h, u in ((0, 5.0), (1, -5.0)) for i in range(3)], "forecast_ts int, turbine_id int, u double, v double")
    rows = X.flow_projection(wind, turbines, "u", "v").orderBy("forecast_ts", "projection").collect()
    assert [r["turbine_id"] for r in rows] == [0, 1, 2, 2, 1, 0] and len(rows) == 6


def test_perturbations_keep_the_sum_and_refuse_large_moves():
    family = K.perturbation_family([0.5, 0.3, 0.2], 1.0, 0.0, 0.0, 1.02, (0.0, 0.04), (0.0,), (0.0,))
    assert all(sum(c.weights) == pytest.approx(1.0) for c, _ in family) and len(family) == 13
    with pytest.raises(ValueError, match="masses"):
        K.perturbation_family([0.5, 0.5], 1.0, 0.0, 0.0, 1.02, (0.9,), (0.0,), (0.0,))


def test_choice_kernel_holds_a_bounded_block():
    rng = np.random.default_rng(8)
    actions, outcomes, weights = rng.uniform(0, 1, (3000, 61)), rng.uniform(0.1, 1.2, (3000, 42)), rng.dirichlet(np.ones(42), 3000)
    tracemalloc.start()
    got = D._expected(actions, outcomes, weights, np.full(3000, 0.4), np.full(3000, 1.5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    gap = np.abs(actions[7][:, None] - outcomes[7]) / 1.5
    want = ((outcomes[7] / 1.5) * np.where(gap <= 0.06, 4.0, np.where(gap <= 0.08, 3.0, 0.0)) / 1.6 - gap) @ weights[7]
    assert got[7] == pytest.approx(want, abs=1e-12) and peak < 12_000_000  # 3000 x 61 x 42 numbers are 61 MB


def test_class_weights_are_totalled_once_a_row(spark):
    df = spark.createDataFrame([(0.3,), (0.9,), (None,)], "x double")
    out = C._pmf(df, D.CLASS_CENTRES, F.col("x"))
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = out.collect()
    for r in rows[:2]:
        p = np.maximum(1 - 4 * np.abs(np.array(D.CLASS_CENTRES) - r["x"]), 0) + 0.01
        assert r["pmf"] == pytest.approx(p / p.sum())


def test_nearest_rows_equal_all_differences_in_bounded_memory():
    rng = np.random.default_rng(9)
    vectors = np.r_[rng.normal(size=(1500, 32)), rng.integers(0, 2, (500, 32)).astype(float)]  # the second part has many equal distances
    vectors[700] = vectors[3]
    ids = np.sort(rng.integers(0, 900, 2000))
    tracemalloc.start()
    row, at, d = N._nearest(vectors, ids, vectors, ids, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000  # all differences are 1 GB
    for q in (0, 3, 700, 1200, 1600, 1999):
        near = np.round(np.sqrt(((vectors[ids < ids[q]] - vectors[q]) ** 2).sum(axis=1)), 12)
        want = np.argsort(near, kind="stable")[:4]
        assert at[row == q].tolist() == want.tolist() and d[row == q] == pytest.approx(near[want], abs=1e-11)


def test_small_parts_of_a_leaf_share_a_task(spark):
    cuts = spark.createDataFrame([(1, 1), (64, 70_000), (70_000, 5)], "size long, asked long").withColumns(D.leaf_cuts(64))
    assert [tuple(r)[2:] for r in cuts.collect()] == [(1, 1, 1), (1, 1, 3), (1094, 3, 1)]


def test_interpolation_shuffles_cells_not_sites(spark):
    """Every site and hour against the definition, with repeated and missing rows, and no shuffle by (hour, site)."""
    cells = [(h, c, None if (h + c) % 7 == 0 else float(h * c % 11)) for h in range(5) for c in range(9) if (h, c) != (2, 3)] + [(1, 4, 2.5), (1, 4, 2.5)]
    weights = [(s, (s * 5 + r * r) % 9, 0.1 * (r + 1), r + 1) for s in range(200) for r in range(4)] + [(None, 1, 1.0, 1), (7, 99, 1.0, 2)]
    static = [(s, f"f{s // 6}", 1.0) for s in range(190)] + [(5, "f0", 1.0), (300, "f9", 1.0)]
    df = spark.createDataFrame(cells, "forecast_ts int, grid_id int, x double")
    w = spark.createDataFrame(weights, "turbine_id int, grid_id int, weight double, rank int")
    about = spark.createDataFrame(static, "turbine_id int, farm string, capacity_mw double")
    key = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    want = []
    for h in range(5):
        for s in {r[0] for r in weights}:
            met = [(r[2], r[3], c[2]) for r in weights if r[0] == s for c in cells if c[:2] == (h, r[1])]
            known, close, first = [m for m in met if m[2] is not None], [m[2] for m in met if m[2] is not None and m[1] <= 3], [m[2] for m in met if m[2] is not None and m[1] == 1]
            if met:
                want.append((h, s, round(sum(a * b for a, _, b in known), 9) if known else None, max(first, default=None), round(float(np.std(close)), 9) if close else None))
    plain = X.interpolate(df, w, ["x"], near_k=3)
    assert "hashpartitioning(forecast_ts" not in plain._jdf.queryExecution().executedPlan().toString()
    round9 = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    assert sorted(map(round9, plain.collect()), key=key) == sorted(want, key=key)
    beside = X.interpolate(df, w, ["x"], static=about, group=["farm"]).select("forecast_ts", "turbine_id", "farm", "capacity_mw", "idw__x")
    joined = plain.join(about, "turbine_id", "left").select(*beside.columns)
    assert sorted(map(round9, beside.collect()), key=key) == sorted(map(round9, joined.collect()), key=key)


def test_leaf_quantiles_go_to_the_queries(spark):
    rng = np.random.default_rng(4)
    fit = [([int(a), int(b)], float(y)) for a, b, y in zip(rng.integers(0, 3, 80), rng.integers(0, 4, 80), rng.normal(size=80))]
    ask = [(i, [int(a), int(b)]) for i, (a, b) in enumerate(zip(rng.integers(0, 4, 30), rng.integers(0, 4, 30)))]  # leaf 3 of the first tree has no member
    out = M.leaf_quantile_surface(spark.createDataFrame(fit, "leaves array<bigint>, y double"), spark.createDataFrame(ask, "id int, leaves array<bigint>"), "leaves", ["id"], "y", [0.1, 0.5])
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r["quantiles"] for r in out.collect()}
    for i, own in ask:
        members = [[y for at, y in fit if at[tree] == own[tree]] for tree in range(2)]
        assert got[i] == pytest.approx(np.mean([np.quantile(m, [0.1, 0.5]) for m in members if m], axis=0), abs=1e-12)
