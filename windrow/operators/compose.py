"""Forecast composition: blends, affine and bounded maps, power bins, increments, scaling rules.

Everything here is a row expression over models that stand side by side; only the long-form blend aggregates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.exprs import ColumnLike, clip, col, edge_bin, total
from windrow.functions.timekeys import lead_hours

# fixed values
UPPER = 1.02
LOW_WIND, HIGH_WIND = 6.0, 12.0
FACTOR_BOUNDS = (0.90, 1.05)
FACTOR_STRENGTH = 0.25


def by_group(group: ColumnLike, values: Mapping[str, object], default: object = None) -> Column:
    """Per-group constant as a CASE expression; registered groups are few and literal, so nothing is joined."""
    out = None
    for g, value in values.items():
        lit = value if isinstance(value, Column) else F.lit(value)
        out = F.when(col(group) == g, lit) if out is None else out.when(col(group) == g, lit)
    return out if default is None else out.otherwise(F.lit(default))


def capped(value: ColumnLike, capacity: ColumnLike = "capacity", upper: float = UPPER) -> Column:
    """Physical output range [0, upper x capacity]."""
    return clip(value, 0.0, upper * col(capacity))


def weighted(models: Mapping[str, float]) -> Column:
    """Weighted sum of model columns."""
    return total([F.col(m) * F.lit(float(w)) for m, w in models.items() if w != 0])


def check_simplex(weights: Mapping[str, Mapping[str, float]]) -> None:
    names = None
    for group, row in weights.items():
        if names is not None and list(row) != names:
            raise ValueError(f"model names of {group} differ")
        names = list(row)
        if any(w < 0 for w in row.values()) or abs(sum(row.values()) - 1.0) > 1e-10:
            raise ValueError(f"weights of {group} are not a simplex")


def blend(df: DataFrame, weights: Mapping[str, Mapping[str, float]], name: str = "blend", group: str = "grp") -> DataFrame:
    """Simplex blend of model columns with weights per group."""
    check_simplex(weights)
    return df.withColumn(name, by_group(group, {g: weighted(w) for g, w in weights.items()}))


def blend_long(df: DataFrame, weights: Mapping[str, Mapping[str, float]], keys: Sequence[str], model: str = "model",
               value: str = "kwh", name: str = "blend", group: str = "grp") -> DataFrame:
    """The same on long rows (model, key): weights come from a CASE, the sum aggregates partially.  A key without all
    its models fails the job."""
    check_simplex(weights)
    count = len(next(iter(weights.values())))
    weight = by_group(group, {g: by_group(model, w) for g, w in weights.items()})
    out = df.groupBy(*keys).agg(F.sum(weight * F.col(value)).alias("_b"), F.count(weight).alias("_n"))
    checked = F.when(F.col("_n") == count, F.col("_b")).otherwise(F.raise_error(F.lit("a model is missing for a key")))
    return out.select(*keys, checked.alias(name))


def affine(value: ColumnLike, scale: ColumnLike, bias: ColumnLike) -> Column:
    return col(scale) * col(value) + col(bias)


def bounded(value: ColumnLike, capacity: ColumnLike, scale: ColumnLike, bias_fraction: ColumnLike, lower: ColumnLike,
            upper: ColumnLike) -> Column:
    cap = col(capacity)
    return clip(col(scale) * col(value) + col(bias_fraction) * cap, col(lower) * cap, col(upper) * cap)


def power_bin_delta(cf: ColumnLike, edges: Sequence[float], deltas: Sequence[float]) -> Column:
    """Delta of the power bin: inner edges, right side."""
    if len(deltas) != len(edges) - 1:
        raise ValueError("one delta per bin")
    return F.element_at(F.array(*[F.lit(float(d)) for d in deltas]), edge_bin(cf, edges[1:-1]) + 1)


@dataclass(frozen=True)
class GroupRecipe:
    """Locked chain of one group."""

    weights: Mapping[str, float]
    scale: float = 1.0
    bias: float = 0.0
    lower: float = 0.0
    upper: float = UPPER
    bin_edges: Sequence[float] | None = None
    bin_deltas: Sequence[float] = field(default_factory=tuple)

    def apply(self, capacity: ColumnLike) -> Column:
        cap = col(capacity)
        low, high = F.lit(self.lower) * cap, F.lit(self.upper) * cap
        out = clip(F.lit(self.scale) * weighted(self.weights) + F.lit(self.bias), low, high)
        if self.bin_edges is None:
            return out
        return clip(out + power_bin_delta(out / cap, self.bin_edges, self.bin_deltas), low, high)


def assemble(df: DataFrame, recipes: Mapping[str, GroupRecipe], name: str = "final", group: str = "grp",
             capacity: str = "capacity") -> DataFrame:
    """blend -> affine -> clip -> power bins -> clip in one projection."""
    check_simplex({g: r.weights for g, r in recipes.items()})
    return df.withColumn(name, by_group(group, {g: r.apply(capacity) for g, r in recipes.items()}))


def convex(base: ColumnLike, other: ColumnLike, weight: ColumnLike | float, upper: ColumnLike) -> Column:
    """Bounded step from base toward other; units are the caller's (kWh with upper 1.02 x capacity, or CF with 1.02)."""
    w = F.lit(float(weight)) if isinstance(weight, (int, float)) else col(weight)
    return clip(col(base) + w * (col(other) - col(base)), 0.0, col(upper))


def delta_transfer(target: ColumnLike, reference: ColumnLike, adjusted: ColumnLike, group: ColumnLike, selected: Sequence[str],
                   capacity: ColumnLike = "capacity") -> Column:
    """Add an upstream change to the selected groups; the others keep their bits."""
    moved = capped(col(target) + (col(adjusted) - col(reference)), capacity)
    return F.when(col(group).isin(*selected), moved).otherwise(col(target))


def paired_increment(baseline: ColumnLike, control_cf: ColumnLike, extended_cf: ColumnLike, weight: float,
                     capacity: ColumnLike = "capacity") -> Column:
    step = clip(extended_cf, 0.0, UPPER) - clip(control_cf, 0.0, UPPER)
    return capped(col(baseline) + weight * col(capacity) * step, capacity)


def consensus_increment(baseline: ColumnLike, increments: Sequence[ColumnLike], weight: float, group: ColumnLike,
                        unchanged: Sequence[str], scale: float = 1.0, capacity: ColumnLike = "capacity") -> tuple[Column, Column]:
    """(scaled baseline, candidate): mean provider increment added except in the groups that stay identical."""
    base = capped(scale * col(baseline), capacity)
    mean = total([col(c) for c in increments]) / float(len(increments))
    moved = capped(base + weight * col(capacity) * mean, capacity)
    return base, F.when(col(group).isin(*unchanged), base).otherwise(moved)


def scaled(value: ColumnLike, factor: float, capacity: ColumnLike = "capacity", group: ColumnLike | None = None,
           only: str | None = None) -> Column:
    """Scale every row, or one group and leave the other groups' bits alone."""
    moved = capped(col(value) * factor, capacity)
    return moved if only is None else F.when(col(group) == only, moved).otherwise(col(value))


def separability_residuals(scores: Mapping[str, Column], base: Column, global_scaled: Column) -> Column:
    """Global delta minus the sum of the one-group deltas."""
    return (global_scaled - base) - total([s - base for s in scores.values()])


def conditional_scale(value: ColumnLike, condition: Column, factor: float) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), factor * col(value)).otherwise(col(value))


def low_output(value: ColumnLike, capacity: ColumnLike, threshold: float = 0.25) -> Column:
    return col(value) / col(capacity) <= threshold


def long_lead(ts: ColumnLike, first: int = 24) -> Column:
    return lead_hours(ts) >= first


def regime_blend(baseline: ColumnLike, physical: ColumnLike, wind: ColumnLike, weight: float, capacity: ColumnLike = "capacity") -> Column:
    """Move toward the physical forecast only in low (<= 6) or high (>= 12 m/s) wind."""
    gate = F.when((col(wind) <= LOW_WIND) | (col(wind) >= HIGH_WIND), 1.0).otherwise(0.0)
    return capped(col(baseline) + weight * gate * (col(physical) - col(baseline)), capacity)


def extrapolate(baseline: ColumnLike, family: ColumnLike, alpha: float, capacity: ColumnLike = "capacity") -> Column:
    return capped(col(baseline) + alpha * (col(family) - col(baseline)), capacity)


def daily_factor(ratio: ColumnLike) -> Column:
    return 1.0 + FACTOR_STRENGTH * (clip(ratio, *FACTOR_BOUNDS) - 1.0)


def action_shrink(baseline: ColumnLike, delta_cf: ColumnLike, shrink: float, capacity: ColumnLike = "capacity") -> Column:
    """Baseline plus a shrunk capacity-factor action."""
    return clip(col(baseline) / col(capacity) + shrink * col(delta_cf), 0.0, UPPER) * col(capacity)


def action_transfer(baseline: ColumnLike, action_cf: ColumnLike, weight: float = 0.10, capacity: ColumnLike = "capacity") -> Column:
    """Part of the way to an absolute action."""
    cf = (1.0 - weight) * (col(baseline) / col(capacity)) + weight * col(action_cf)
    return clip(cf, 0.0, UPPER) * col(capacity)


def interquartile_centre(models: Sequence[ColumnLike]) -> Column:
    """Mean of the linearly interpolated quartiles of the row's models."""
    ordered = F.array_sort(F.array(*[col(m) for m in models]))
    n = len(models)

    def q(p: float) -> Column:
        at = p * (n - 1)
        lo = int(at)
        a, b = F.element_at(ordered, lo + 1), F.element_at(ordered, min(lo + 2, n))
        return a + (b - a) * (at - lo)

    return 0.5 * (q(0.25) + q(0.75))


def sample_weight(actual: ColumnLike, capacity: ColumnLike, base: float, strength: float) -> Column:
    """Energy-linear training weight."""
    return base + strength * clip(col(actual) / col(capacity), 0.0, 1.5)


def fill_template(template: DataFrame, predictions: DataFrame, groups: Sequence[str], ts: str = "ts", group: str = "grp",
                  value: str = "kwh", row_id: str = "forecast_id") -> DataFrame:
    """Template rows in id order with one column per group; a template hour without all groups fails the job."""
    wide = predictions.groupBy(ts).agg(*[F.max(F.when(F.col(group) == g, F.col(value))).alias(g) for g in groups])
    joined = template.select(row_id, ts).join(wide, ts, "left")
    known = F.lit(True)
    for g in groups:
        known = known & F.col(g).isNotNull()
    first = F.when(known, F.col(groups[0])).otherwise(F.raise_error(F.lit("template hour without a prediction")))
    return joined.select(row_id, ts, first.alias(groups[0]), *groups[1:]).orderBy(row_id)
