"""Promotion gates over candidate x slice comparison tables (a few rows per candidate)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(deltas: DataFrame, keys: Sequence[str], delta: str = "delta_score", slice_col: str = "slice",
            required: Sequence[str] | None = None) -> DataFrame:
    """Smallest and mean delta per candidate and whether every required slice is there and strictly positive."""
    rows = deltas if required is None else deltas.where(F.col(slice_col).isin(*required))
    out = rows.groupBy(*keys).agg(F.min(delta).alias("minimum_delta"), F.avg(delta).alias("mean_delta"),
                                  F.bool_and(F.coalesce(F.col(delta) > 0, F.lit(False))).alias("_all"),
                                  F.countDistinct(slice_col).alias("slices"))
    enough = F.lit(True) if required is None else F.col("slices") == len(set(required))
    return out.withColumn("passed", F.col("_all") & enough).drop("_all")


def choose(summaries: DataFrame, keys: Sequence[str] = (), prefer: Sequence[Column] = ()) -> DataFrame:
    """Among the candidates that passed: largest minimum, then largest mean, then the given preferences in order."""
    rank = F.struct(F.round("minimum_delta", 12), F.round("mean_delta", 12), *prefer)
    row = F.struct(*[F.col(c) for c in summaries.columns if c not in keys])
    passed = summaries.where("passed")
    return passed.groupBy(*keys).agg(F.max_by(row, rank).alias("b")).where(F.col("b").isNotNull()).select(*keys, "b.*")


def full_period_gate(deltas: DataFrame, keys: Sequence[str], full: str = "full", slice_col: str = "slice") -> DataFrame:
    """Every slice score must rise, and over the full period neither component may fall and one must rise."""
    is_full = F.col(slice_col) == full
    a, b = F.col("delta_one_minus_nmae"), F.col("delta_ficr")
    out = deltas.groupBy(*keys).agg(
        F.bool_and(F.col("delta_score") > 0).alias("all_scores_rise"),
        F.bool_or(is_full & (a >= 0) & (b >= 0) & ((a > 0) | (b > 0))).alias("full_components_hold"))
    return out.withColumn("promoted", F.col("all_scores_rise") & F.col("full_components_hold"))


def floor_gate(deltas: DataFrame, rules: Sequence[tuple[str, str, str, float]], keys: Sequence[str], group: str = "grp",
               slice_col: str = "slice") -> DataFrame:
    """Numeric floors as rules (group or ``*`` for every single group, slice, metric, floor); lists the failed rules.

    A rule whose row is missing counts as failed.
    """
    checks = []
    for scope, part, metric, floor in rules:
        where = (F.col(slice_col) == part) & ((F.col(group) != "mixed") if scope == "*" else (F.col(group) == scope))
        ok = F.coalesce(F.min(F.when(where, F.col(f"delta_{metric}"))) >= floor, F.lit(False))
        checks.append((f"{scope}/{part} {metric}", ok))
    flags = [ok.alias(f"_r{i}") for i, (_, ok) in enumerate(checks)]
    out = deltas.groupBy(*keys).agg(*flags)
    failed = F.array_compact(F.array(*[F.when(~F.col(f"_r{i}"), F.lit(name)) for i, (name, _) in enumerate(checks)]))
    passed = reduce(lambda a, b: a & b, [F.col(f"_r{i}") for i in range(len(checks))])
    return out.select(*keys, passed.alias("eligible"), F.concat_ws(";", failed).alias("failures"))


def lexicographic_objective(deltas: DataFrame, keys: Sequence[str], quarters: Sequence[str] = ("Q3", "Q4"), group: str = "grp",
                            slice_col: str = "slice") -> DataFrame:
    """Objective parts: worst and mean group-quarter settlement delta, worst group-quarter score delta, mixed H2 score delta."""
    cell = (F.col(group) != "mixed") & F.col(slice_col).isin(*quarters)
    return deltas.groupBy(*keys).agg(
        F.min(F.when(cell, F.col("delta_ficr"))).alias("worst_ficr"), F.avg(F.when(cell, F.col("delta_ficr"))).alias("mean_ficr"),
        F.min(F.when(cell, F.col("delta_score"))).alias("worst_score"),
        F.max(F.when((F.col(group) == "mixed") & (F.col(slice_col) == "H2"), F.col("delta_score"))).alias("mixed_h2_score"))


def dual_gate(deltas: DataFrame, baseline: str = "baseline_name", group: str = "grp", family: str = "family", slice_col: str = "slice",
              cells_group: int = 36, cells_mixed: int = 12) -> DataFrame:
    """Candidate against several baselines: all registered group and mixed cells positive and mixed H2 components not
    falling, for every baseline."""
    mixed = F.col(group) == "mixed"
    h2 = mixed & (F.col(family) == "time") & (F.col(slice_col) == "H2")
    out = deltas.groupBy(baseline).agg(
        F.count(F.when(~mixed, 1)).alias("_ng"), F.count(F.when(mixed, 1)).alias("_nm"),
        F.min(F.when(~mixed, F.col("delta_score"))).alias("minimum_group_delta"),
        F.min(F.when(mixed, F.col("delta_score"))).alias("minimum_mixed_delta"),
        F.max(F.when(h2, F.col("delta_one_minus_nmae"))).alias("h2_one_minus_nmae"), F.max(F.when(h2, F.col("delta_ficr"))).alias("h2_ficr"))
    ok = ((F.col("_ng") == cells_group) & (F.col("_nm") == cells_mixed) & (F.col("minimum_group_delta") > 0)
          & (F.col("minimum_mixed_delta") > 0) & (F.col("h2_one_minus_nmae") >= 0) & (F.col("h2_ficr") >= 0))
    out = out.withColumn("passed", F.coalesce(ok, F.lit(False))).drop("_ng", "_nm")
    return out.withColumn("dual_pass", F.bool_and("passed").over(Window.partitionBy(F.lit(1))))  # one row per baseline
