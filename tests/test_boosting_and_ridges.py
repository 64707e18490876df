"""Boosting on histograms and grouped ridges against plain numpy forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.operators import boosting as B
from windrow.operators import least_squares as Q
from windrow.operators import models as M
from windrow.session import checkpoint


@pytest.fixture(scope="module")
def curve(spark):
    """y = 2x on [0, 1] with noise that widens on one side, a second feature without meaning, some nulls in it."""
    r = random.Random(2)
    rows = []
    for i in range(4000):
        x = r.random()
        rows.append((i, x, None if i % 50 == 0 else r.random(), 2 * x + (0.05 + x) * (r.random() ** 2 - 0.3)))
    return checkpoint(spark.createDataFrame(rows, "id long, x double, z double, y double").repartition(4))


def test_quantile_boosting_nears_the_true_quantiles(curve):
    train, held = curve.where("id % 4 <> 0"), curve.where("id % 4 = 0")
    levels = [0.1, 0.5, 0.9]
    models = B.quantile_boost(train, ["x", "z"], "y", levels, rounds=8, depth=3, rate=0.5)
    boosted = B.quantile_surface(held, models)
    binned = M.binned_quantile_surface(train.withColumn("p", F.round("x", 1)), held.withColumn("p", F.round("x", 1)), "p", "y", levels, bins=3)
    truth = held.withColumn("quantiles", F.array(*[2 * F.col("x") + (0.05 + F.col("x")) * (q * q - 0.3) for q in levels]))
    cost = lambda df: df.agg(sum((F.avg(B.pinball(F.col("y"), F.element_at("quantiles", k + 1), q)) for k, q in enumerate(levels)), F.lit(0.0))).first()[0]
    assert cost(boosted) < 1.2 * cost(truth) and cost(boosted) < cost(binned)
    inside = boosted.agg(F.avg((F.col("y") <= F.element_at("quantiles", 1)).cast("double")), F.avg((F.col("y") <= F.element_at("quantiles", 3)).cast("double"))).first()
    assert abs(inside[0] - 0.1) < 0.04 and abs(inside[1] - 0.9) < 0.04
    assert boosted.where("quantiles[0] > quantiles[1] OR quantiles[1] > quantiles[2]").count() == 0


def test_newton_boosting_equals_a_plain_form(curve):
    features, rounds, depth, rate, penalty = ["x", "z"], 5, 2, 0.5, 2.0
    model = B.newton_boost(curve, features, lambda p: p - F.col("y"), lambda p: F.lit(1.0), rounds=rounds, depth=depth, rate=rate, penalty=penalty, minimum=30, bins=8)
    rows = curve.orderBy("id").toPandas()
    x, y = rows[features].to_numpy(float), rows["y"].to_numpy()
    edges = [sorted(set(np.nanquantile(x[:, f], [i / 8 for i in range(1, 8)]))) for f in range(2)]
    score = lambda g: g.sum() ** 2 / (len(g) + penalty)

    def tree(at, g, level):
        options = []
        if level:
            for f in range(2):
                for e in edges[f]:
                    left = x[at, f] <= e
                    if min(left.sum(), (~left).sum()) >= 30:
                        options.append((round(score(g[at][left]) + score(g[at][~left]) - score(g[at]), 9), -f, -e, left))
        if not options or max(options, key=lambda o: o[:3])[0] <= 1e-9:
            out[at] = -g[at].sum() / (len(at) + penalty)
            return
        left = max(options, key=lambda o: o[:3])[3]
        tree(at[left], g, level - 1)
        tree(at[~left], g, level - 1)

    p = np.zeros(len(y))
    for _ in range(rounds):
        out = np.zeros(len(y))
        tree(np.arange(len(y)), p - y, depth)
        p = p + rate * out
    got = B.apply_models(curve, {"p": model}).orderBy("id").toPandas()["p"].to_numpy()
    np.testing.assert_allclose(got, p, atol=1e-9)
    assert np.mean((p - y) ** 2) < 0.2 * np.var(y)


def test_boosting_of_no_more_than_one_leaf_is_the_start(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "x double, y double")
    model = B.newton_boost(rows, ["x"], lambda p: p - F.col("y"), lambda p: F.lit(1.0), rounds=2, rate=1.0, penalty=0.0, minimum=1)
    assert [round(r.p, 9) for r in B.apply_models(rows, {"p": model}).collect()] == [3.0, 3.0]
    assert B.apply_models(rows.limit(0), {"p": model}).count() == 0


def reference(x, y, alpha, w=None, standardise=False):
    w = np.ones(len(y)) if w is None else w
    mean, my = (w[:, None] * x).sum(axis=0) / w.sum(), (w * y).sum() / w.sum()
    c = x - mean
    s = np.sqrt((w[:, None] * c * c).sum(axis=0) / w.sum()) if standardise else np.ones(x.shape[1])
    c = c / s
    b = np.linalg.solve((w[:, None] * c).T @ c + alpha * np.eye(x.shape[1]), (w[:, None] * c).T @ (y - my)) / s
    return my - mean @ b, b


@pytest.mark.parametrize("standardise", [False, True])
@pytest.mark.parametrize("weight", [None, "w"])
def test_ridges_of_many_keys_equal_numpy(spark, monkeypatch, standardise, weight):
    monkeypatch.setattr(Q, "HELD", 200)  # hand matrices on all the time
    r = np.random.default_rng(5)
    rows = [(None if k == 3 else f"k{k}", k % 2, *map(float, r.normal(size=3)), float(r.normal()), float(r.random() + 0.1)) for k in range(12) for _ in range(5 + 40 * k)]
    rows += [("k1", 1, None, 1.0, 1.0, 1.0, 1.0), ("k1", 1, 1.0, float("nan"), 1.0, 1.0, 1.0), ("k1", 1, 1.0, 1.0, 1.0, float("inf"), 1.0)]  # take no part
    df = spark.createDataFrame(rows, "k string, j int, a double, b double, c double, y double, w double").repartition(3)
    got = {(m.k, m.j): m for m in Q.ridges(df, ["k", "j"], ["a", "b", "c"], "y", 0.7, weight, standardise, minimum=6 if weight is None else 0).collect()}
    for key in {(x[0], x[1]) for x in rows}:
        own = np.array([x[2:] for x in rows if (x[0], x[1]) == key and None not in x[2:]], float)
        own = own[np.isfinite(own).all(axis=1)]
        if weight is None and len(own) < 6:
            assert key not in got
            continue
        intercept, b = reference(own[:, :3], own[:, 3], 0.7, own[:, 4] if weight else None, standardise)
        np.testing.assert_allclose([got[key].intercept, *got[key].coefficients], [intercept, *b], atol=1e-9)


def test_overlapping_sets_are_sums_of_cells(spark):
    r = np.random.default_rng(6)
    rows = [(i % 4, *map(float, r.normal(size=3))) for i in range(400)]
    df = spark.createDataFrame(rows, "cell long, a double, b double, y double")
    sums = Q.grams(df, ["cell"], ["a", "b"], "y")
    models = Q.fitted(Q.members(sums, "cell", {"all": [0, 1, 2, 3], "some": [1, 3]}, "part"), ["part"], 0.3)
    for m in models.collect():
        own = np.array([x[1:] for x in rows if m.part == "all" or x[0] in (1, 3)])
        intercept, b = reference(own[:, :2], own[:, 2], 0.3)
        np.testing.assert_allclose([m.n, m.intercept, *m.coefficients], [len(own), intercept, *b], atol=1e-9)
    out = Q.apply_ridges(df, Q.ridges(df, [], ["a", "b"], "y", 0.0), [], ["a", "b"], "p").collect()
    whole = np.array([x[1:] for x in rows])
    intercept, b = reference(whole[:, :2], whole[:, 2], 0.0)
    assert all(abs(x.p - (intercept + b @ [x.a, x.b])) < 1e-9 for x in out) and set(out[0].asDict()) == {"cell", "a", "b", "y", "p"}


def test_singular_and_constant_features_are_solved():
    z = np.column_stack([np.ones(20), np.ones(20), np.arange(20.0), 2 * np.arange(20.0), np.arange(20.0) + 1])
    n, intercept, b = Q.solve(z.T @ z, 0.0, standardise=True)
    assert n == 20 and np.isfinite(b).all() and abs(intercept + b @ [1, 4, 8] - 5) < 1e-6
