"""Heads over rows x actions against pyspark.ml on the unfolded rows, and the rounds of the query."""

import inspect
import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from windrow.operators import decisions as D
from windrow.operators import interval_heads as H
from windrow.operators import models as M
from windrow.plans import learning
from windrow.session import checkpoint


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    data = [(i, r.random(), r.random()) for i in range(90)]
    return checkpoint(spark.createDataFrame(data, "id long, b double, z double").repartition(3, "id").withColumn("y", F.round(0.1 + 0.8 * F.col("b") * (0.5 + F.col("z") / 2), 3)))


def test_heads_equal_pyspark_on_unfolded_rows(rows, monkeypatch):
    monkeypatch.setattr(H, "TILE", 16)
    monkeypatch.setattr(H, "RENEW", 2)
    names, rounds = ["b", "z"], 4
    cuts, place, trees, rates = H.fit(rows, names, "y", D.ACTION_GRID, maxIter=rounds)
    asked = rows.orderBy("id").toPandas()
    bins = np.stack([np.searchsorted(c, asked[n]).astype(np.uint8) for c, n in zip(cuts, names)])
    found = np.zeros((3, len(asked), len(cuts[-1]) + 1))
    H.add_trees(bins, found, trees, rates)
    gap = F.abs(F.col("action") - F.col("y"))
    wide = checkpoint(M.assemble(M.expand_actions(rows, D.ACTION_GRID).withColumns({"y6": (gap <= 0.06).cast("double"), "y8": (gap <= 0.08).cast("double"), "e": gap}), [*names, "action"]))
    for h, label in enumerate(("y6", "y8", "e")):
        own = {"featuresCol": M.VECTOR, "labelCol": label, "maxIter": rounds, "maxDepth": 4, "stepSize": 0.1, "seed": 42}
        model = GBTRegressor(lossType="squared", **own) if label == "e" else GBTClassifier(**own)
        value = F.col("prediction") if label == "e" else F.element_at(vector_to_array("rawPrediction"), 2)
        known = model.fit(wide).transform(wide).select("id", "action", value.alias("v")).orderBy("id", "action").toPandas()["v"].to_numpy().reshape(-1, len(D.ACTION_GRID))
        assert np.allclose(found[h][:, place], known, atol=1e-9), label


def test_interval_query_runs_all_rounds(rows, monkeypatch):
    assert M.INTERVAL_ROUNDS == 140 and not hasattr(learning, "INTERVAL_ROUNDS")
    assert "maxIter" not in inspect.getsource(learning.interval_probability_policy)
    seen, fit = [], H.fit
    monkeypatch.setattr(H, "fit", lambda *a, **k: seen.append(k["maxIter"]) or fit(*a, **{**k, "maxIter": 2}))
    rows.select(D.corridor_action(["b", "z"], F.lit(1.0))).collect()  # a function the session knows cannot travel with the kernel
    out = M.interval_policy(rows, rows.unionByName(rows), ["b", "z"], "y", "b", D.ACTION_GRID)
    assert out.count() == 180 and out.columns == [*rows.columns, "action", "utility"] and seen == [140]


def test_interval_heads_refuse_missing_numbers(rows):
    with pytest.raises(ValueError, match="finite"):
        M.interval_policy(rows.withColumn("z", F.lit(None).cast("double")), rows, ["b", "z"], "y", "b", D.ACTION_GRID, maxIter=1)
