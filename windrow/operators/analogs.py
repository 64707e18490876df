"""Analog retrieval: run embeddings, nearest strictly earlier runs, distance-weighted trajectories."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.functions.exprs import clip
from windrow.functions.timekeys import RUN_HOURS, YEAR_DAYS, run_position
from windrow.operators.runs import run_arrays, run_statistics

# fixed values
SUMMARY = ("__run_mean", "__run_std", "__run_min", "__run_max", "__run_q10", "__run_q50", "__run_q90", "__run_linear_slope", "__run_fft1_real",
           "__run_fft1_imag", "__run_peak_position")
ZERO_DISTANCE, DISTANCE_FLOOR = 1e-12, 1e-6
BLOCK_ROWS = 2048
#: cells of queries x library rows a matrix product holds
PRODUCT_CELLS = 1_000_000


def calendar_terms(day: str) -> list[Column]:
    angle = 2.0 * np.pi * (F.dayofyear(day) - 1.0) / YEAR_DAYS
    return [F.sin(angle), F.cos(angle), F.sin(2.0 * angle), F.cos(2.0 * angle)]


def summary_embedding(df: DataFrame, channels: Sequence[str], keys: Sequence[str], day: str = "run_key", ts: str = "forecast_ts") -> DataFrame:
    """Eleven shape statistics per channel and the season of complete runs."""
    stats = {n: e for c in channels for n, e in run_statistics(c, c, run_position(ts)).items()}
    runs = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[e.alias(n) for n, e in stats.items()]).where(F.col("_n") == RUN_HOURS)
    return runs.select(*keys, F.array(*[F.col(f"{c}{s}") for c in channels for s in SUMMARY], *calendar_terms(day)).alias("embedding"))


def trajectory_embedding(df: DataFrame, channels: Sequence[str], keys: Sequence[str], day: str = "run_key", ts: str = "forecast_ts") -> DataFrame:
    """Channel trajectories one after the other and the season."""
    arrays = run_arrays(df, channels, keys, ts).where(F.size(ts) == RUN_HOURS)
    return arrays.select(*keys, F.concat(*[F.col(c) for c in channels], F.array(*calendar_terms(day))).alias("embedding"))


def scale_embedding(library: DataFrame, *frames: DataFrame, size: int) -> list[DataFrame]:
    """Standardise with the library's mean and population spread; a constant dimension keeps its centred zero."""
    parts = [F.struct(F.avg(F.element_at("embedding", i + 1)).alias("m"), F.stddev_pop(F.element_at("embedding", i + 1)).alias("s")) for i in range(size)]
    stats = library.agg(F.array(*parts).alias("a")).scalar()
    out = []
    for df in (library, *frames):
        scaled = F.zip_with("embedding", F.col("_a"), lambda x, p: (x - p["m"]) / F.when(p["s"] > 0, p["s"]).otherwise(1.0))
        out.append(df.withColumn("_a", stats).withColumn("embedding", scaled).drop("_a"))
    return out


def reduce_embedding(library: DataFrame, *frames: DataFrame, k: int) -> list[DataFrame]:
    """Principal components learned on the library."""
    vector = lambda df: df.withColumn("_v", array_to_vector("embedding"))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vector(library))
    return [model.transform(vector(df)).withColumn("embedding", vector_to_array("_p")).drop("_v", "_p") for df in (library, *frames)]


def _nearest(m: np.ndarray, ids: np.ndarray, qm: np.ndarray, qs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, library row, distance): the ``k`` nearest of the library rows whose number is below the query's, equal distances in library order.

    A matrix product gives every squared distance up to its rounding; only rows that may be among the k nearest by that bound are measured
    by their differences, so the result is that of measuring all.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    norm, wide = (m * m).sum(axis=1), m.shape[1]
    for i in range(0, len(qs), max(1, PRODUCT_CELLS // len(m))):
        part = slice(i, i + max(1, PRODUCT_CELLS // len(m)))
        q = qm[part]
        own = (q * q).sum(axis=1)
        rough = q @ m.T
        rough *= -2.0
        rough += norm
        rough += own[:, None]
        rough[ids[None, :] >= qs[part, None]] = np.inf
        # rounding of the product and the sums, and of distances that are equal to twelve places
        slack = 8 * (wide + 4) * np.finfo(float).eps * (own + norm.max(initial=0.0)) + 1e-11 * (1.0 + np.sqrt(own + norm.max(initial=0.0)))
        edge = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(m) > k else np.full(len(q), np.inf)
        row, at = np.nonzero((rough <= (edge + 2.0 * slack)[:, None]) & (rough < np.inf) if np.isfinite(slack).all() else ids[None, :] < qs[part, None])
        d = np.empty(len(row))
        for j in range(0, len(row), PRODUCT_CELLS // wide + 1):
            some = slice(j, j + PRODUCT_CELLS // wide + 1)
            d[some] = np.sqrt(((q[row[some]] - m[at[some]]) ** 2).sum(axis=1))
        order = np.lexsort((at, np.round(d, 12), row))
        order = order[np.isfinite(d[order])]
        row, at, d = row[order], at[order], d[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        found.append((row[keep] + i, at[keep], d[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def past_neighbours(library: DataFrame, queries: DataFrame, k: int, run: str = "run", member: str | None = None, block: int = BLOCK_ROWS,
                    vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(run, neighbour, distance, rank): the k nearest library runs strictly before the query run.

    ``run`` orders the runs; where several runs share a number, such as the grid cells of a day, ``member`` (an integer) tells
    them apart, and member and neighbour_member stand in the result too.  Ties go to the earlier run, then the smaller member.
    Runs are cut into blocks of ``block`` consecutive numbers, and these by member into slots of about ``block_rows`` rows.  A task
    meets one library slot with one query slot and returns at most k rows per query, so neither pairs nor whole libraries are
    rows or sent to every task; blocks that lie in the future are never paired.
    """
    own = F.lit(0).cast("bigint") if member is None else F.col(member).cast("bigint")
    shape = lambda df, b: df.select(F.col(run).cast("bigint").alias("_run"), own.alias("_member"), F.col(vector).cast("array<double>").alias("_v")).withColumn(b, F.floor(F.col("_run") / block))
    lib, ask = shape(library, "lb"), shape(queries, "qb")
    low = lib.agg(F.min("lb").alias("a"), F.max("lb").alias("b"), F.count(F.lit(1)).alias("n")).first()
    span = ask.agg(F.min("qb").alias("a"), F.max("qb").alias("b"), F.count(F.lit(1)).alias("n")).first()
    if span["a"] is None or low["a"] is None:
        raise ValueError("library or queries are empty")
    slots = [max(1, math.ceil(s["n"] / (s["b"] - s["a"] + 1) / block_rows)) if member else 1 for s in (low, span)]
    slot = lambda n: F.pmod(F.xxhash64("_member"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lib = lib.where(F.col("lb") <= span["b"]).withColumn("qb", F.explode(F.sequence(F.greatest(F.col("lb"), F.lit(span["a"])), F.lit(span["b"]))))
    lib = lib.withColumn("ls", slot(slots[0])).withColumn("qs", every(slots[1]))
    ask = ask.where(F.col("qb") >= low["a"]).withColumn("lb", F.explode(F.sequence(F.lit(low["a"]), F.least(F.col("qb"), F.lit(low["b"])))))
    ask = ask.withColumn("qs", slot(slots[1])).withColumn("ls", every(slots[0]))
    names = ["run", "member", "neighbour", "neighbour_member"]
    schema = T.StructType([*[T.StructField(n, T.LongType()) for n in names], T.StructField("distance", T.DoubleType())])

    def nearest(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not (len(left) and len(right)):
            return pd.DataFrame({n: [] for n in schema.names})
        left = left.sort_values(["_run", "_member"])
        ids, members, m = left["_run"].to_numpy(), left["_member"].to_numpy(), np.stack(left["_v"].to_numpy())
        qs, qmember, qm = right["_run"].to_numpy(), right["_member"].to_numpy(), np.stack(right["_v"].to_numpy())
        row, at, d = _nearest(m, ids, qm, qs, k)
        return pd.DataFrame({"run": qs[row], "member": qmember[row], "neighbour": ids[at], "neighbour_member": members[at], "distance": d})

    keys = ["lb", "ls", "qb", "qs"]
    found = lib.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInPandas(nearest, schema)
    w = Window.partitionBy("run", "member").orderBy(F.round("distance", 12), "neighbour", "neighbour_member")  # k rows per library slot
    out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out if member else out.drop("member", "neighbour_member")


def neighbour_weights(near: DataFrame) -> DataFrame:
    """Inverse-distance weights that sum to one; runs at distance zero share all the weight."""
    w = Window.partitionBy(*[c for c in ("run", "member") if c in near.columns])
    zeros = F.sum((F.col("distance") <= ZERO_DISTANCE).cast("int")).over(w)
    inverse = 1.0 / F.greatest(F.col("distance"), F.lit(DISTANCE_FLOOR))
    return near.withColumn("weight", F.when(zeros > 0, F.when(F.col("distance") <= ZERO_DISTANCE, 1.0 / zeros).otherwise(0.0)).otherwise(inverse / F.sum(inverse).over(w)))


def analog_trajectories(weighted: DataFrame, trajectories: DataFrame, run: str = "run", hour: str = "hour", cf: str = "cf", name: str = "analog_cf", member: str | None = None) -> DataFrame:
    """Weighted mean trajectory per query run (and member) and hour."""
    keys = {"neighbour": run} | ({"neighbour_member": member} if member else {})
    curves = trajectories.select(*[F.col(c).cast("bigint").alias(n) for n, c in keys.items()], hour, clip(cf, 0.0, 1.02).alias("_cf"))
    rows = weighted.join(curves, list(keys))
    asked = ["run", "member"] if member else ["run"]
    return rows.groupBy(*asked, hour).agg(clip(F.sum(F.col("weight") * F.col("_cf")), 0.0, 1.02).alias(name), F.count(F.lit(1)).alias("neighbours"))
