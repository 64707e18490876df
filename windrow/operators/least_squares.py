"""Ridge regressions of any number of keys (sites, groups, lead bins, folds) in one pass over the rows.

A kernel adds the products of the rows' values, one small matrix per key, for its whole task; these matrices are summed and solved per key on
the executors.  Because they add up, overlapping memberships (a global control beside lead bins, expanding folds, all folds but one) are
sums of the matrices of disjoint cells and never multiply rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from windrow.functions.exprs import clip, total
from windrow.operators.lookups import attach

#: numbers a task holds in matrices of its keys before it hands them on, and in products of rows at once
HELD, PRODUCTS = 4_000_000, 2_000_000


def grams(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, weight: str | None = None) -> DataFrame:
    """(keys, gram): sums of w z zT over a key's rows, z = (1, features, target), as flat arrays; several rows per key, to be added.

    Rows with a null or not finite feature, target or weight take no part.
    """
    keys, numbers = list(keys), [*features, target, *([weight] if weight else [])]
    fields = [T.StructField(f.name, f.dataType) for f in df.select(*keys).schema.fields]
    schema = T.StructType([*fields, T.StructField("gram", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)
    m = len(features) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def handed() -> pa.RecordBatch:
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*held), arrow)] + [pa.array([g.ravel().tolist() for g in held.values()], pa.list_(pa.float64()))]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in batches:
            values = np.column_stack([np.asarray(batch.column(len(keys) + i).cast(pa.float64()).to_numpy(zero_copy_only=False), float) for i in range(len(numbers))]) if batch.num_rows else np.zeros((0, len(numbers)))
            good = np.isfinite(values).all(axis=1)
            if not good.any():
                continue
            values = values[good]
            w = values[:, -1] if weight else np.ones(len(values))
            z = np.column_stack([np.ones(len(values)), values[:, :m - 1]])
            codes = pa.table([batch.column(i) for i in range(len(keys))], names=keys).to_pandas()[good].reset_index(drop=True) if keys else None
            group = codes.groupby(keys, sort=False, dropna=False).ngroup().to_numpy() if keys else np.zeros(len(z), int)
            order = np.argsort(group, kind="stable")
            z, w, group = z[order], w[order], group[order]
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            names = [tuple(v.as_py() for v in row) for row in zip(*[batch.column(i).filter(pa.array(good)).take(pa.array(order[first])) for i in range(len(keys))])] if keys else [()]
            for name, start, stop in zip(names, first, [*first[1:], len(z)]):
                into = held.setdefault(name, np.zeros((m, m)))
                for a in range(start, stop, max(1, PRODUCTS // m)):
                    part = z[a:min(stop, a + max(1, PRODUCTS // m))]
                    into += (part * w[a:a + len(part), None]).T @ part
            if len(held) * m * m > HELD:
                yield handed()
        if held:
            yield handed()

    return df.select(*keys, *[F.col(c).cast("double").alias(f"_n{i}") for i, c in enumerate(numbers)]).mapInArrow(run, schema)


def solve(gram: np.ndarray, alpha: float, standardise: bool = False) -> tuple[float, float, np.ndarray]:
    """(rows or weight, intercept, coefficients) of the ridge with penalty ``alpha`` on centred (and, if asked, standardised) features."""
    n, k = gram[0, 0], len(gram) - 2
    mean = gram[0, 1:] / n
    centred = gram[1:, 1:] - n * np.outer(mean, mean)
    scale = np.ones(k)
    if standardise:
        spread = np.sqrt(np.maximum(np.diag(centred)[:k], 0.0) / n)
        scale = np.where(spread > 1e-12 * np.maximum(1.0, np.abs(mean[:k])), spread, 1.0)
    left = centred[:k, :k] / np.outer(scale, scale) + alpha * np.eye(k)
    try:
        b = np.linalg.solve(left, centred[:k, k] / scale)
    except np.linalg.LinAlgError:
        b = np.linalg.lstsq(left, centred[:k, k] / scale, rcond=None)[0]
    b = b / scale
    return float(n), float(mean[k] - mean[:k] @ b), b


def fitted(parts: DataFrame, keys: Sequence[str], alpha: float, standardise: bool = False, minimum: float = 1) -> DataFrame:
    """(keys, n, intercept, coefficients): matrices of ``parts`` added and solved per key on the executors; keys below ``minimum`` rows are left out.

    A key has at most a few matrices per task of :func:`grams`, however many rows it has.
    """
    keys = list(keys)
    fields = [T.StructField(f.name, f.dataType) for f in parts.select(*keys).schema.fields]
    schema = T.StructType([*fields, *T.StructType.fromDDL("n double, intercept double, coefficients array<double>").fields])
    arrow = to_arrow_schema(schema)

    def run(table):
        gram = sum(np.asarray(v.values, float) for v in table.column("gram"))
        m = round(len(gram) ** 0.5)
        gram = gram.reshape(m, m)
        if gram[0, 0] < minimum:
            return arrow.empty_table()
        n, intercept, b = solve(gram, alpha, standardise)
        values = [*[table.column(k)[0].as_py() for k in keys], n, intercept, b.tolist()]
        return pa.table([pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow)

    return parts.select(*keys, "gram").groupBy(*keys).applyInArrow(run, schema)


def ridges(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, alpha: float, weight: str | None = None, standardise: bool = False, minimum: float = 1) -> DataFrame:
    """One ridge per key; no keys: one ridge of all rows, under the key column ``one`` = 1."""
    rows = df if keys else df.withColumn("one", F.lit(1))
    keys = list(keys) or ["one"]
    return fitted(grams(rows, keys, features, target, weight), keys, alpha, standardise, minimum)


def members(parts: DataFrame, cell: str, memberships: dict[object, Sequence[object]], name: str) -> DataFrame:
    """Matrices of cells (values of ``cell``) as matrices of the sets they belong to: ``memberships`` maps a set to its cells."""
    table = parts.sparkSession.createDataFrame([(s, c) for s, cells in memberships.items() for c in cells], T.StructType([
        T.StructField(name, T.StringType() if any(isinstance(s, str) for s in memberships) else T.LongType()), T.StructField(cell, parts.schema[cell].dataType)]))
    return parts.join(F.broadcast(table), cell).drop(cell)


def line(features: Sequence[str], intercept: str = "intercept", coefficients: str = "coefficients") -> Column:
    """Value of a solved line at a row's features; null if a feature is."""
    return F.col(intercept) + total([F.element_at(coefficients, i + 1) * F.col(f) for i, f in enumerate(features)])


def apply_ridges(df: DataFrame, models: DataFrame, keys: Sequence[str], features: Sequence[str], name: str, bounds: tuple[float, float] | None = None) -> DataFrame:
    """Predictions by each row's own key (null where the key has no model); the models are joined by their checked size."""
    rows = df if keys else df.withColumn("one", F.lit(1))
    own = rows.columns
    out = attach(rows, models.select(*(keys or ["one"]), F.col("intercept").alias("_i"), F.col("coefficients").alias("_c")), list(keys) or ["one"])
    value = line(features, "_i", "_c")
    return out.withColumn(name, clip(value, *bounds) if bounds else value).select(*[c for c in own if c not in ("one", name) or (c == "one" and keys)], name)
