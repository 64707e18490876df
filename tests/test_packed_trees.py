"""Trees grown on packed rows against those of pyspark.ml."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.operators import models as M
from windrow.operators import packed_trees as P
from windrow.session import checkpoint

NAMES = ["x", "z", "few", "same"]


@pytest.fixture(scope="module")
def rows(spark):
    """More rows than thresholds are sampled from, a feature of many zeros, one of few values and one of a single value."""
    r = random.Random(3)
    data = [(i, r.random(), r.random() if i % 3 else 0.0, float(r.randrange(4)), 1.0, 0.5 + r.random()) for i in range(24_000)]
    out = spark.createDataFrame(data, "id long, x double, z double, few double, same double, w double").repartition(5, "id")
    return checkpoint(out.withColumn("y", F.sin(6 * F.col("x")) + F.col("z") * F.col("few") + F.col("w") / 9))


@pytest.mark.parametrize("weight, loss, share", [(None, "absolute", 0.85), ("w", "squared", 0.85)])
def test_packed_trees_are_those_of_pyspark(rows, monkeypatch, weight, loss, share):
    train = rows.where("id % 4 <> 0")
    fit = lambda: M.boosted(train, NAMES, "y", weight, loss, maxIter=5, subsamplingRate=share)
    known = fit()
    monkeypatch.setattr(M, "PACKED_ROWS", 0)
    monkeypatch.setattr(M, "GBTRegressor", None)  # fails if the rows are not packed
    monkeypatch.setattr(P, "BLOCK", 2_000)
    monkeypatch.setattr(P, "RENEW", 2)
    monkeypatch.setattr(P, "TILE", 700)
    monkeypatch.setattr(P, "DIRECT", 2)
    found = fit()
    assert found.totalNumNodes == known.totalNumNodes
    assert np.allclose(found.featureImportances.toArray(), known.featureImportances.toArray(), atol=1e-9)
    both = M.predict(known, M.predict(found, rows, NAMES, "a"), NAMES, "b")
    assert both.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-9


@pytest.mark.parametrize("value", [None, float("inf")])
def test_packed_trees_refuse_missing_numbers(rows, monkeypatch, value):
    monkeypatch.setattr(M, "PACKED_ROWS", 0)
    with pytest.raises(ValueError, match="finite"):
        M.boosted(rows.withColumn("x", F.when(F.col("id") == 5, F.lit(value)).otherwise(F.col("x"))), NAMES, "y", maxIter=2)
