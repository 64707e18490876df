"""Facts and invariants of providers, telemetry, composition, decisions and gates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.functions import wind as P
from windrow.operators import calibrate as K
from windrow.operators import compose as E
from windrow.operators import decisions as D
from windrow.operators import gates as G
from windrow.operators import providers as R
from windrow.operators import telemetry as M


def test_agreement_gate_table(spark):
    rows = [(0.20, 0.3, 0.2, 0.25, 3, 0.20), (0.20, 0.3, 0.2, -0.4, 2, 0.2 * 2 / 3), (-0.30, -0.3, -0.5, 0.1, 2, -0.30 * 2 / 3), (0.0, 0.1, 0.1, 0.1, 0, 0.0),
            (0.4, 0.1, -0.1, 0.0, 1, 0.0), (0.4, 0.1, 0.2, 0.3, 3, 0.4 * 0.5)]
    df = spark.createDataFrame(rows, "j double, a double, b double, c double, n int, want double").withColumns(R.agreement_gate("j", ["a", "b", "c"]))
    for r in df.collect():
        assert r["agreement"] == r["n"]
        assert r["gated"] == pytest.approx(r["want"], abs=1e-15)
        assert abs(r["gated"]) <= abs(r["j"]) + 1e-15


def test_previous_day_choice(spark):
    df = spark.range(24).select(F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"))
    assert [r[0] for r in df.orderBy("ts").select(R.previous_day("ts")).collect()] == [2] + [1] * 13 + [2] * 10


def test_icing_needs_every_condition(spark):
    args = dict(ta=272.0, da=271.0, tb=272.0, db=271.0, wa=5.0, wb=5.0, hub=100.0)
    cols = {k: F.lit(v) for k, v in args.items()}

    def state(**change):
        c = {**cols, **{k: F.lit(v) for k, v in change.items() if k in cols}}
        out = P.icing_state(c["ta"], c["da"], c["tb"], c["db"], c["wa"], c["wb"], c["hub"], [F.lit(change.get("wet", True))], [F.lit(change.get("cloud", True))])
        return spark.range(1).select(out["icing_state"]).first()[0]

    assert state() == 1
    for change in ({"ta": 280.0}, {"da": 260.0}, {"wa": 1.0}, {"wb": 1.0}, {"wet": False}, {"cloud": False}, {"ta": 260.0, "tb": 260.0}):
        assert state(**change) == 0, change


def test_target_transforms_invert(spark):
    df = spark.createDataFrame([(x,) for x in (0.1, 0.33, 0.5, 0.97)], "cf double")
    for kind in P.TRANSFORMS:
        got = df.select("cf", P.inverse_target_transform(P.target_transform("cf", kind), kind).alias("b")).collect()
        assert all(r["b"] == pytest.approx(r["cf"], abs=1e-12) for r in got)


def test_pool_adjacent_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(4)
    y, w = rng.normal(size=40), rng.uniform(0.5, 3, size=40)
    fit = M.pool_adjacent(y, w)
    assert (np.diff(fit) >= -1e-12).all()
    assert (fit * w).sum() == pytest.approx((y * w).sum())


def test_outage_against_common_low(spark):
    rows = [("t1", i, 0.02 if i == 0 else 0.95, 10.0, 1.0) for i in range(5)] + [("t2", i, 0.3, 10.0, 1.0) for i in range(5)] + [("t3", 0, 2.0, 10.0, 1.0), ("t3", 1, 0.0, 1.0, 0.02)]
    df = spark.createDataFrame(rows, "t string, turbine int, p double, w double, c double")
    got = {(r["t"], r["turbine"]): r["state"] for r in M.proxy_states(df, ["t"], "turbine", "p", "w", "c").collect()}
    assert got[("t1", 0)] == "OUTAGE_LIKE" and got[("t1", 1)] == "NORMAL"
    assert all(got[("t2", i)] == "CURTAILMENT_LIKE" for i in range(5))
    assert got[("t3", 0)] == "SENSOR_OR_DATA_ANOMALY" and got[("t3", 1)] == "LOW_RESOURCE"


def test_entropy_and_divergence(spark):
    df = spark.createDataFrame([(2, 2, 0, 5, 0), (0, 0, 0, 1, 1)], "a int, b int, z int, c int, d int")
    e = [r[0] for r in df.select(M.entropy(["a", "b", "z"])).collect()]
    assert e[0] == pytest.approx(np.log(2)) and e[1] is None
    js = [r[0] for r in df.limit(1).select(M.jensen_shannon([("a", "a"), ("b", "b")])).collect()]
    assert js[0] == pytest.approx(0.0)
    far = spark.createDataFrame([(1, 0, 0, 1)], "a int, b int, c int, d int").select(M.jensen_shannon([("a", "c"), ("b", "d")])).first()[0]
    assert far == pytest.approx(np.log(2))


def test_strict_energy_needs_all_six_records(spark):
    df = spark.createDataFrame([("h", 1, float(i)) for i in range(6)] + [("h", 2, float(i)) for i in range(5)], "h string, turbine int, power double")
    got = {r["turbine"]: r["energy"] for r in M.strict_turbine_energy(df, ["h", "turbine"]).collect()}
    assert got == {1: 15.0, 2: None}


def test_curve_lookup_equals_interp(spark):
    rng = np.random.default_rng(8)
    xs, ys = np.sort(rng.uniform(0, 25, 12)), np.sort(rng.uniform(0, 1, 12))
    knots = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(xs, ys)], "turbine int, x double, y double")
    at = [float(x) for x in rng.uniform(-2, 28, 200)] + [float(x) for x in xs]
    df = spark.createDataFrame([(1, a) for a in at], "turbine int, ws double")
    got = M.curve_lookup(df, knots, "turbine", "ws", "cf").collect()
    assert [r["cf"] for r in got] == pytest.approx(list(np.interp([r["ws"] for r in got], xs, ys)))


def test_unselected_groups_keep_their_bits(spark):
    df = spark.createDataFrame([("g1", 0.1 + 0.2, 1.0, 2.0, 60.0), ("g2", 0.1 + 0.2, 1.0, 2.0, 60.0)], "grp string, t double, r double, a double, capacity double")
    got = {r["grp"]: r["x"] for r in df.withColumn("x", E.delta_transfer("t", "r", "a", "grp", ["g1"])).collect()}
    assert got["g2"] == 0.1 + 0.2 and got["g1"] == pytest.approx(1.3)


def test_power_bins_are_right_sided(spark):
    df = spark.createDataFrame([(0.0,), (0.2499,), (0.25,), (0.75,), (1.5,)], "cf double")
    got = [r[0] for r in df.select(E.power_bin_delta("cf", (0.0, 0.25, 0.75, 1.02), (1.0, 2.0, 3.0))).collect()]
    assert got == [1.0, 1.0, 2.0, 3.0, 3.0]


def test_blend_refuses_missing_models_and_bad_weights(spark):
    df = spark.createDataFrame([("a", "g", 1, 2.0)], "model string, grp string, id int, kwh double")
    with pytest.raises(Exception, match="model is missing"):
        E.blend_long(df, {"g": {"a": 0.5, "b": 0.5}}, ["grp", "id"]).collect()
    with pytest.raises(ValueError, match="simplex"):
        E.check_simplex({"g": {"a": 0.7, "b": 0.7}})


def brute_action(actions, prefer, outcomes, weights, mean):
    a, y = np.asarray(actions)[:, None], np.asarray(outcomes)[None, :]
    e = np.abs(a - y)
    u = ((y * np.where(e <= 0.06, 4, np.where(e <= 0.08, 3, 0)) / (4 * mean) - e) * np.asarray(weights)[None, :]).sum(axis=1)
    tied = np.flatnonzero(u >= u.max() - 1e-12)
    return actions[min(tied, key=lambda i: (round(prefer[i], 14), i))]


def test_best_action_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(60):
        n, m = int(rng.integers(3, 30)), int(rng.integers(2, 20))
        acts, outs, w = np.sort(rng.uniform(0, 1, n)), rng.uniform(0.1, 1.2, m), rng.dirichlet(np.ones(m))
        rows.append((i, acts.tolist(), np.abs(acts - 0.5).tolist(), outs.tolist(), w.tolist()))
    df = spark.createDataFrame(rows, "i int, a array<double>, p array<double>, y array<double>, w array<double>")
    got = {r["i"]: r["c"]["action"] for r in df.withColumn("c", D.best_action("a", "p", "y", "w", F.lit(0.45))).collect()}
    for i, a, p, y, w in rows:
        assert got[i] == pytest.approx(brute_action(a, p, y, w, 0.45))


def test_interval_repair_and_grid_interpolation(spark):
    df = spark.createDataFrame([(0.8, 0.4), (0.2, 0.5), (-1.0, 2.0)], "a double, b double")
    p6, p8, bad = D.repair_interval("a", "b")
    got = [tuple(r) for r in df.select(p6, p8, bad).collect()]
    assert [g[2] for g in got] == [True, False, False]
    assert got[0][0] == pytest.approx(0.6) and got[0][1] == pytest.approx(0.6) and got[2][:2] == (0.0, 1.0)
    u = F.array(*[F.lit(float(i)) for i in range(103)])
    at = spark.createDataFrame([(0.0,), (0.015,), (1.02,), (2.0,)], "q double").select(D.interpolate_utility(u, "q")).collect()
    assert [r[0] for r in at] == pytest.approx([0.0, 1.5, 102.0, 102.0])


def test_classes(spark):
    df = spark.createDataFrame([(0.10,), (0.1249999,), (0.125,), (1.149,), (2.0,)], "cf double")
    assert [r[0] for r in df.select(D.target_class("cf")).collect()] == [0, 0, 1, 41, 41]
    rs = spark.createDataFrame([(-2.0,), (-0.5125,), (0.0,), (0.0126,), (2.0,)], "r double")
    assert [r[0] for r in rs.select(D.residual_class("r")).collect()] == [0, 0, 21, 22, 42]


def toy(spark, n=300):
    rng = np.random.default_rng(21)
    rows = []
    for i in range(n):
        y = float(rng.uniform(8, 60))
        rows.append((f"g{i % 2 + 1}", y, y * 0.9 + 1 + float(rng.normal()), y + float(rng.normal() * 6), float(rng.uniform(8, 60)), 60.0))
    return rows, spark.createDataFrame(rows, "grp string, actual double, m1 double, m2 double, m3 double, capacity double")


def numpy_score(y, p, cap=60.0):
    keep = y >= 0.1 * cap
    e = np.abs(np.round(p[keep], 9) - y[keep]) / cap
    return 0.5 * (1 - e.mean()) + 0.5 * (y[keep] * np.where(e <= 0.06, 4, np.where(e <= 0.08, 3, 0))).sum() / (4 * y[keep].sum())


def test_affine_search_never_loses_to_its_own_grid(spark):
    rows, df = toy(spark)
    for r in K.fit_affine(df, "m1", ["g1", "g2"], grid=9, refinements=1).collect():
        part = [x for x in rows if x[0] == r["grp"]]
        y, m = np.array([x[1] for x in part]), np.array([x[2] for x in part])
        assert r["score"] == pytest.approx(numpy_score(y, r["scale"] * m + r["bias_fraction"] * 60.0))
        grid = [numpy_score(y, s * m + b * 60) for s in {*K.line(0.85, 1.25, 9), 1.0} for b in {*K.line(-0.1, 0.1, 9), 0.0}]
        assert r["score"] >= max(grid) - 1e-12


def sequential_simplex(y, m, extra, steps):
    """The search one point at a time."""
    n = m.shape[1]
    equal = np.full(n, 1 / n)
    parts = lambda w: (round(numpy_score(y, m @ w), 12), round(1 - (np.abs(np.round(m @ w, 9) - y)[y >= 6] / 60).mean(), 12))
    better = lambda a, b: a[0] > b[0] or (a[0] == b[0] and (a[1] > b[1] or (a[1] == b[1] and a[2] < b[2] - 1e-14)))
    key = lambda w: (*parts(np.array(w)), float(np.abs(np.array(w) - equal).sum()))
    points = [list(equal), *np.eye(n).tolist(), *[list(p) for p in extra]]
    best = points[0]
    for p in points[1:]:
        if better(key(p), key(best)):
            best = p
    for step in steps:
        moved = True
        while moved:
            moved = False
            for d in range(n):
                for r in range(n):
                    if d != r and best[d] + 1e-15 >= step and not moved:
                        p = list(best)
                        p[d] -= step
                        p[r] += step
                        if better(key(p), key(best)):
                            best, moved = p, True
    return best


def test_simplex_search_equals_the_sequential_search(spark):
    rows, df = toy(spark)
    out = K.fit_simplex(df, ["m1", "m2", "m3"], ["g1", "g2"], steps=(0.1, 0.05))
    for r in out.collect():
        part = [x for x in rows if x[0] == r["grp"]]
        y, m = np.array([x[1] for x in part]), np.array([x[2:5] for x in part])
        want = sequential_simplex(y, m, [], (0.1, 0.05))
        assert [r["w_m1"], r["w_m2"], r["w_m3"]] == pytest.approx(want)


def test_stack_is_a_simplex_and_beats_equal_weights(spark):
    rows, df = toy(spark)
    cf = df.select((F.col("actual") / 60).alias("y"), *[(F.col(f"m{i}") / 60).alias(f"m{i}") for i in (1, 2, 3)])
    fit = K.fit_stack(cf, ["m1", "m2", "m3"], "y", 0.001, rounds=60)
    w = np.array(list(fit["weights"].values()))
    assert w.sum() == pytest.approx(1.0) and (w >= 0).all() and abs(fit["intercept"]) <= 0.025
    y, m = np.array([x[1] for x in rows]) / 60, np.array([x[2:5] for x in rows]) / 60

    def objective(theta):
        r = m @ theta[:3] + theta[3] - y
        return (0.04 ** 2 * (np.sqrt(1 + (r / 0.04) ** 2) - 1)).mean() + 0.001 * ((theta[:3] - 1 / 3) ** 2).sum() + 0.1 * theta[3] ** 2

    assert fit["objective"] == pytest.approx(objective(np.append(w, fit["intercept"])))
    grid = [np.array([a, b, 1 - a - b, c]) for a in np.linspace(0, 1, 21) for b in np.linspace(0, 1 - a, 21) for c in np.linspace(-0.025, 0.025, 11)]
    assert fit["objective"] <= min(objective(t) for t in grid) + 1e-6


def test_forest_action_equals_brute_force(spark):
    rng = np.random.default_rng(33)
    fit_rows = [(i, float(rng.normal() * 0.1), [int(rng.integers(0, 3)), int(rng.integers(0, 2))]) for i in range(90)]
    ask_rows = [(i, float(rng.uniform(0.1, 0.9)), [int(rng.integers(0, 3)), int(rng.integers(0, 2))]) for i in range(25)]
    fit = spark.createDataFrame(fit_rows, "id int, residual double, leaves array<int>")
    ask = spark.createDataFrame(ask_rows, "id int, base double, leaves array<int>")
    got = {r["id"]: r["delta"] for r in D.forest_action(fit, ask, "leaves", ["id"], ["id"], "residual", "base", 0.5, part_rows=7).collect()}
    deltas = np.array(D.ACTION_DELTAS)
    for i, b, leaves in ask_rows:
        w = np.zeros(len(fit_rows))
        for t in (0, 1):
            member = np.array([r[2][t] == leaves[t] for r in fit_rows])
            w += member / member.sum() / 2
        acts, outs = np.clip(b + deltas, 0, 1.02), np.clip(b + np.array([r[1] for r in fit_rows]), 0.1, 1.2)
        e = np.abs(acts[:, None] - outs[None, :])
        u = ((outs * np.where(e <= 0.06, 4, np.where(e <= 0.08, 3, 0)) / 2 - e) * w).sum(axis=1)
        tied = np.flatnonzero(u >= u.max() - 1e-12)
        assert got[i] == pytest.approx(deltas[min(tied, key=lambda j: (round(abs(deltas[j]), 14), j))])


def test_gate_needs_every_slice_and_breaks_ties_in_order(spark):
    rows = [("a", s, 0.01) for s in ("full", "H1")] + [("b", "full", 0.02), ("b", "H1", -0.001)] + [("c", "full", 0.01), ("c", "H1", 0.01)] + [("d", "full", 0.5)]
    df = spark.createDataFrame(rows, "candidate string, slice string, delta_score double")
    s = G.summary(df, ["candidate"], required=["full", "H1"])
    assert {r["candidate"]: r["passed"] for r in s.collect()} == {"a": True, "b": False, "c": True, "d": False}
    won = G.choose(s, [], [F.when(F.col("candidate") == "a", 2).otherwise(1)]).collect()
    assert [r["candidate"] for r in won] == ["a"]
    assert G.choose(s.where("not passed")).count() == 0
