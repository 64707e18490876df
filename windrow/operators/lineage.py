"""Comparing candidate tables with each other: increments, identities, effective rank, content clusters."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.exprs import ColumnLike, col, sum_when
from windrow.functions.timekeys import run_position
from windrow.operators.association import gram, pearson, with_ranks

# fixed values
LEAD_SLOTS = ("L01_06", "L07_12", "L13_18", "L19_24")
SERIAL_DECIMALS = 6


def increment_similarity(df: DataFrame, base: str, candidates: Sequence[str]) -> DataFrame:
    """(left, right) correlation, identity, overlap and sign agreement of the increments over the base.

    Candidates stand side by side, so all pairs are aggregates of one pass and rows are not multiplied.
    """
    inc = {c: F.col(c) - F.col(base) for c in candidates}
    pairs = list(itertools.combinations(candidates, 2))
    aggs: list[Column] = []
    for i, (a, b) in enumerate(pairs):
        x, y = inc[a], inc[b]
        both = (x != 0) & (y != 0)
        aggs += [F.corr(x, y).alias(f"c{i}"), F.bool_and(x == y).alias(f"e{i}"), sum_when(both).alias(f"o{i}"), sum_when((x != 0) | (y != 0)).alias(f"u{i}"),
                 sum_when(both & (F.signum(x) == F.signum(y))).alias(f"s{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(
        F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"c{i}").alias("increment_corr"), F.col(f"e{i}").alias("increment_exact"), F.col(f"o{i}").alias("overlap"),
        F.when(F.col(f"u{i}") > 0, F.col(f"o{i}") / F.col(f"u{i}")).otherwise(1.0).alias("jaccard"),
        F.when(F.col(f"o{i}") > 0, F.col(f"s{i}") / F.col(f"o{i}")).otherwise(1.0).alias("sign_agreement")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows))


def pair_metrics(df: DataFrame, parent: str, child: str) -> DataFrame:
    """Affine fit, correlations, errors and changed share between two versions of the same forecast."""
    x, y = F.col(parent), F.col(child)
    d = y - x
    first = df.agg(F.regr_slope(y, x).alias("affine_a"), F.regr_intercept(y, x).alias("affine_b"), F.corr(x, y).alias("pearson"), F.sqrt(F.avg(d * d)).alias("rmse"),
                   F.avg(F.abs(d)).alias("mae"), F.max(F.abs(d)).alias("max_abs_delta"), sum_when(d != 0).alias("changed_rows"), F.avg((d != 0).cast("double")).alias("changed_fraction"))
    line = df.join(F.broadcast(first.select("affine_a", "affine_b"))).agg(F.max(F.abs(y - (F.col("affine_a") * x + F.col("affine_b")))).alias("affine_max_abs_residual"))
    ranked = with_ranks(df.select(parent, child).withColumn("_k", F.lit(1)), ["_k"], [parent, child])
    a, b = F.col(f"{parent}__rank") - (F.col(f"{parent}__n") + 1) / 2.0, F.col(f"{child}__rank") - (F.col(f"{child}__n") + 1) / 2.0
    rho = ranked.agg(pearson(F.count(F.lit(1)).cast("double"), F.sum(a), F.sum(b), F.sum(a * a), F.sum(b * b), F.sum(a * b)).alias("spearman"))
    return first.join(F.broadcast(line)).join(F.broadcast(rho))


def lead_slot(ts: ColumnLike) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in LEAD_SLOTS]), (F.floor(run_position(ts) / 6) + 1).cast("int"))


def changed_slices(df: DataFrame, reference: str, candidate: str, group: str = "grp", ts: str = "ts") -> DataFrame:
    """(kind, slice, changed): changed cells per group, and hours with any change per month and lead slot."""
    changed = F.coalesce(F.col(reference) != F.col(candidate), F.col(reference).isNull() != F.col(candidate).isNull())
    rows = df.select(group, ts, changed.cast("int").alias("_c"))
    by_group = rows.groupBy(F.col(group).alias("slice")).agg(F.sum("_c").alias("changed")).withColumn("kind", F.lit("group"))
    hours = rows.groupBy(ts).agg(F.max("_c").alias("_c"))
    month = hours.groupBy(F.date_format(ts, "yyyy-MM").alias("slice")).agg(F.sum("_c").cast("bigint").alias("changed")).withColumn("kind", F.lit("month"))
    lead = hours.groupBy(lead_slot(ts).alias("slice")).agg(F.sum("_c").cast("bigint").alias("changed")).withColumn("kind", F.lit("lead"))
    return by_group.unionByName(month).unionByName(lead)


def scalar_identity(df: DataFrame, parent: ColumnLike, child: ColumnLike, scale: float, keys: Sequence[str] = (), decimals: int = SERIAL_DECIMALS) -> DataFrame:
    """Can every child be scale x parent once both were written with fixed decimals?"""
    unit = 10.0 ** -decimals
    c = col(child)
    bound = 0.5 * unit * (1.0 + abs(scale)) + 8.0 * 2.220446049250313e-16 * F.greatest(F.lit(1.0), F.abs(c))
    return df.groupBy(*keys).agg(F.bool_and(F.abs(c - scale * col(parent)) <= bound).alias("identity"), F.count(F.lit(1)).alias("rows"))


def increment_gram(df: DataFrame, base: str | None, candidates: Sequence[str]) -> DataFrame:
    """(a, b, dot) products of the candidates' increments."""
    inc = df.select(*[(F.col(c) - F.col(base) if base else F.col(c)).alias(c) for c in candidates])
    return gram(inc, candidates).select("a", "b", F.col("sab").alias("dot"))


def effective_rank(products: DataFrame, size: int) -> DataFrame:
    """Numerical rank, components for 95 and 99 % and entropy rank from the (size x size) product matrix."""
    def spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((size, size))
        m[pdf["a"], pdf["b"]] = pdf["dot"]
        m[pdf["b"], pdf["a"]] = pdf["dot"]
        eig = np.maximum(np.linalg.eigvalsh(m), 0.0)[::-1]
        if eig.sum() == 0:
            return pd.DataFrame({"candidates": [size], "numerical_rank": [0], "components_95": [0], "components_99": [0], "entropy_rank": [0.0]})
        share = eig / eig.sum()
        cum, pos = np.cumsum(share), share[share > 0]
        return pd.DataFrame({"candidates": [size], "numerical_rank": [int((eig > eig[0] * 1e-12).sum())], "components_95": [int(np.searchsorted(cum, 0.95) + 1)],
                             "components_99": [int(np.searchsorted(cum, 0.99) + 1)], "entropy_rank": [float(np.exp(-(pos * np.log(pos)).sum()))]})

    return products.withColumn("_k", F.lit(1)).groupBy("_k").applyInPandas(
        lambda pdf: spectrum(pdf), "candidates int, numerical_rank int, components_95 int, components_99 int, entropy_rank double")


def content_digest(df: DataFrame, keys: Sequence[str], row: Sequence[ColumnLike]) -> DataFrame:
    """Order-independent fingerprint of a table's rows: two sums of row digests and the row count.  Sums aggregate
    partially, so no table's text is ever put together in one place."""
    digest = F.md5(F.concat_ws("|", *[col(c).cast("string") for c in row]))
    part = lambda start: F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
    out = df.groupBy(*keys).agg(F.sum(part(1)).alias("_a"), F.sum(part(9)).alias("_b"), F.count(F.lit(1)).alias("rows"))
    return out.select(*keys, "rows", F.concat_ws("-", F.col("rows").cast("string"), F.col("_a").cast("string"), F.col("_b").cast("string")).alias("content_hash"))


def content_clusters(nodes: DataFrame, content: str, path: str, score: str, axis: str) -> DataFrame:
    """Files with the same content: count, first file, its axis and the best score."""
    return nodes.groupBy(content).agg(F.count(F.lit(1)).alias("file_count"), F.min(path).alias("representative"), F.min_by(axis, path).alias("axis"), F.max(score).alias("best_score"))


def axis_ledger(nodes: DataFrame, axis: str, content: str, score: str, linked: Column) -> DataFrame:
    return nodes.groupBy(axis).agg(F.count(F.lit(1)).alias("file_count"), F.countDistinct(content).alias("unique_content"), sum_when(linked).alias("linked_count"), F.max(score).alias("best_score"))
