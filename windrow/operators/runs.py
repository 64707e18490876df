"""Operators inside one forecast run: neighbours, run shape, smoothing, interpolation, DCT, recency.

A run has 24 hours, so windows partitioned by (group, run) and arrays collected per run are bounded by that.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions.exprs import ColumnLike, clip, col
from windrow.functions.timekeys import RUN_HOURS, hours_between, run_position
from windrow.operators.lookups import attach
from windrow.operators.settlement import require


def run_window(keys: Sequence[str], ts: str = "forecast_ts") -> Window:
    return Window.partitionBy(*keys).orderBy(ts)


def neighbours(df: DataFrame, columns: Sequence[str], offsets: Sequence[int], keys: Sequence[str], ts: str = "forecast_ts",
               curvature: bool = True) -> DataFrame:
    """Lag, lead, centred gradient and curvature inside the run; a missing neighbour is the current value."""
    w = run_window(keys, ts)
    out = {}
    for c in columns:
        for k in offsets:
            lag = F.coalesce(F.lag(c, k).over(w), F.col(c))
            lead = F.coalesce(F.lead(c, k).over(w), F.col(c))
            out[f"{c}__run_lag_{k}h"], out[f"{c}__run_lead_{k}h"] = lag, lead
            out[f"{c}__run_gradient_{k}h"] = (lead - lag) / (2.0 * k)
            if curvature:
                out[f"{c}__run_curvature_{k}h"] = (lead - 2.0 * F.col(c) + lag) / float(k * k)
    return df.withColumns(out)


def run_sequence(df: DataFrame, columns: Sequence[str], offsets: Sequence[int], keys: Sequence[str],
                 ts: str = "forecast_ts") -> DataFrame:
    """Run mean, sample std, extremes, range and deviation; lag/lead filled with the run's first/last value; ramp per
    hour that really lies between the two points."""
    ordered = run_window(keys, ts)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = {}
    t_first, t_last = F.first(ts).over(whole), F.last(ts).over(whole)
    for c in columns:
        mean, low, high = F.avg(c).over(whole), F.min(c).over(whole), F.max(c).over(whole)
        out[f"{c}__run_mean"] = mean
        out[f"{c}__run_std"] = F.coalesce(F.stddev_samp(c).over(whole), F.lit(0.0))
        out[f"{c}__run_min"], out[f"{c}__run_max"], out[f"{c}__run_range"] = low, high, high - low
        out[f"{c}__current_minus_run_mean"] = F.col(c) - mean
        for k in offsets:
            lag = F.coalesce(F.lag(c, k).over(ordered), F.first(c).over(whole))
            lead = F.coalesce(F.lead(c, k).over(ordered), F.last(c).over(whole))
            t_lag = F.coalesce(F.lag(ts, k).over(ordered), t_first)
            t_lead = F.coalesce(F.lead(ts, k).over(ordered), t_last)
            out[f"{c}__run_lag_{k}h"], out[f"{c}__run_lead_{k}h"] = lag, lead
            out[f"{c}__run_ramp_{k}h"] = (lead - lag) / F.greatest(hours_between(t_lead, t_lag), F.lit(1.0))
    return df.withColumns(out)


def smooth(df: DataFrame, column: str, strength: ColumnLike | float, keys: Sequence[str], ts: str = "ts",
           name: str = "smoothed", expected_hours: int = RUN_HOURS) -> DataFrame:
    """(1 - s) x + s/2 (previous + next) with run edges repeated.  A run that is not complete fails the job."""
    w = run_window(keys, ts)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = F.lit(float(strength)) if isinstance(strength, (int, float)) else col(strength)
    before = F.coalesce(F.lag(column).over(w), F.col(column))
    after = F.coalesce(F.lead(column).over(w), F.col(column))
    complete = (F.count(F.lit(1)).over(whole) == expected_hours) & (
        hours_between(F.max(ts).over(whole), F.min(ts).over(whole)) == expected_hours - 1
    )
    value = (1.0 - s) * F.col(column) + 0.5 * s * (before + after)
    return df.withColumn(name, require(complete, "forecast run is not 24 contiguous hours", value))


QUANTILES = {"q10": 0.10, "q25": 0.25, "q50": 0.50, "q75": 0.75, "q90": 0.90}


def run_arrays(df: DataFrame, columns: Sequence[str], keys: Sequence[str], ts: str = "forecast_ts") -> DataFrame:
    """One row per run with time-ordered arrays (the run matrix), one shuffle."""
    packed = F.sort_array(F.collect_list(F.struct(F.col(ts), *[F.col(c) for c in columns])))
    rows = df.groupBy(*keys).agg(packed.alias("_run"))
    return rows.select(*keys, F.col(f"_run.{ts}").alias(ts), *[F.col(f"_run.{c}").alias(c) for c in columns])


def run_statistics(name: str, value: ColumnLike, position: ColumnLike, hours: int = RUN_HOURS) -> dict[str, Column]:
    """Seventeen aggregates of one run's trajectory; ``position`` is the zero-based hour.

    All are native aggregates over the 24 rows of a run: moments, extremes, five quantiles, first positions of peak and
    trough, linear slope and two harmonics.
    """
    x, h, n = col(value), col(position), float(hours)
    centre = (n - 1.0) / 2.0
    spread = sum((i - centre) ** 2 for i in range(hours))
    q = F.percentile(x, F.array(*[F.lit(p) for p in QUANTILES.values()]))
    out = {
        f"{name}__run_mean": F.avg(x), f"{name}__run_std": F.stddev_pop(x), f"{name}__run_min": F.min(x), f"{name}__run_max": F.max(x),
        f"{name}__run_range": F.max(x) - F.min(x), **{f"{name}__run_{k}": F.element_at(q, i + 1) for i, k in enumerate(QUANTILES)},
        f"{name}__run_peak_position": F.min(F.struct((-x).alias("v"), h.alias("h")))["h"] / (n - 1.0),
        f"{name}__run_trough_position": F.min(F.struct(x.alias("v"), h.alias("h")))["h"] / (n - 1.0),
        f"{name}__run_linear_slope": F.sum(x * (h - centre)) / spread,
    }
    for k in (1, 2):
        angle = 2.0 * math.pi * k * h / n
        out[f"{name}__run_fft{k}_real"] = F.sum(x * F.cos(angle)) / n
        out[f"{name}__run_fft{k}_imag"] = -F.sum(x * F.sin(angle)) / n
    return out


def hour_features(name: str, values: ColumnLike, position: ColumnLike, hours: int = RUN_HOURS) -> dict[str, Column]:
    """Eight features of one hour from the run array and the run's mean and spread."""
    x, h = col(values), col(position)
    mean, std = F.col(f"{name}__run_mean"), F.col(f"{name}__run_std")
    current = F.element_at(x, (h + 1).cast("int"))
    previous = F.element_at(x, F.greatest(h, F.lit(1)).cast("int"))
    following = F.element_at(x, F.least(h + 2, F.lit(hours)).cast("int"))
    below = F.filter(x, lambda v, i: (v < current) | ((v == current) & (i < h)))
    return {
        f"{name}__current": current, f"{name}__current_minus_mean": current - mean,
        f"{name}__current_zscore": (current - mean) / F.greatest(std, F.lit(1e-6)), f"{name}__within_run_rank": F.size(below) / (hours - 1.0),
        f"{name}__same_run_previous": previous, f"{name}__same_run_next": following, f"{name}__same_run_gradient": 0.5 * (following - previous),
        f"{name}__same_run_curvature": following - 2.0 * current + previous,
    }


def run_table(df: DataFrame, columns: Sequence[str], keys: Sequence[str], ts: str = "forecast_ts") -> DataFrame:
    """One row per run: its statistics and its time-ordered arrays, one shuffle.  An incomplete run fails the job."""
    position = run_position(ts)
    packed = F.sort_array(F.collect_list(F.struct(F.col(ts), *[F.col(c) for c in columns])))
    stats = {n: e for c in columns for n, e in run_statistics(c, c, position).items()}
    rows = df.groupBy(*keys).agg(packed.alias("_run"), *[e.alias(n) for n, e in stats.items()])
    times = F.col(f"_run.{ts}")
    whole = (F.size("_run") == RUN_HOURS) & (hours_between(F.element_at(times, -1), F.element_at(times, 1)) == RUN_HOURS - 1)
    return rows.select(*keys, require(whole, "forecast run is not 24 contiguous hours", times).alias(ts), *[F.col(f"_run.{c}").alias(c) for c in columns], *stats)


def run_shape(df: DataFrame, columns: Sequence[str], keys: Sequence[str], ts: str = "forecast_ts") -> DataFrame:
    """All 25 shape features of the given columns per hour: one shuffle to form the runs, none to unfold them again."""
    wide = run_table(df, columns, keys, ts)
    per_run = [c for c in wide.columns if c not in (*keys, *columns, ts)]
    unfolded = wide.select(*keys, *columns, *per_run, F.posexplode(ts).alias("position", "_ts"))
    hourly = {n: e for c in columns for n, e in hour_features(c, c, "position").items()}
    return unfolded.select(*keys, F.col("_ts").alias(ts), "position", *per_run, *[e.alias(n) for n, e in hourly.items()])


def horizon_terms(position: ColumnLike, hours: int = RUN_HOURS) -> dict[str, Column]:
    h = col(position).cast("double")
    angle = 2.0 * math.pi * h / hours
    return {
        "horizon__position_fraction": h / (hours - 1.0),
        "horizon__sin_1": F.sin(angle), "horizon__cos_1": F.cos(angle),
        "horizon__sin_2": F.sin(2.0 * angle), "horizon__cos_2": F.cos(2.0 * angle),
    }


def run_sequence_table(df: DataFrame, baseline_cf: str, wind: str, others: Sequence[str], keys: Sequence[str],
                       ts: str = "forecast_ts") -> DataFrame:
    """Shape features of baseline and weather, horizon terms and five baseline/wind interactions."""
    out = run_shape(df, [baseline_cf, wind, *others], keys, ts).withColumns(horizon_terms("position"))
    b, w = F.col(f"{baseline_cf}__current_minus_mean"), F.col(f"{wind}__current_minus_mean")
    return out.withColumns({
        "interaction__baseline_center_x_horizon_sin1": b * F.col("horizon__sin_1"),
        "interaction__baseline_center_x_horizon_cos1": b * F.col("horizon__cos_1"),
        "interaction__baseline_x_wind": F.col(f"{baseline_cf}__current") * F.col(f"{wind}__current"),
        "interaction__baseline_center_x_wind_center": b * w,
        "interaction__baseline_rank_x_wind_rank":
            F.col(f"{baseline_cf}__within_run_rank") * F.col(f"{wind}__within_run_rank"),
    })


def dct_coefficients(df: DataFrame, column: str, keys: Sequence[str], position: ColumnLike, count: int = 8,
                     hours: int = RUN_HOURS) -> DataFrame:
    """First orthonormal DCT-II coefficients of each run's trajectory as additive sums (no run array needed)."""
    p = col(position).cast("double") + 0.5
    aggs = []
    for k in range(count):
        scale = math.sqrt((1.0 if k == 0 else 2.0) / hours)
        aggs.append(F.sum(F.col(column) * F.cos(math.pi * k / hours * p) * scale).alias(f"{column}__dct_{k}"))
    return df.groupBy(*keys).agg(*aggs)


def interpolate_anchors(df: DataFrame, values: Sequence[str], keys: Sequence[str], position: str, targets: Column) -> DataFrame:
    """Linear interpolation of anchors to the target positions inside one day.

    Every anchor meets its successor in the same (small) partition and is unfolded over the positions up to that
    successor, so anchor values are kept bit for bit and no join back is needed.  Positions outside the anchors hold the
    end value.
    """
    w = Window.partitionBy(*keys).orderBy(position)
    step = df.select(
        *keys, F.col(position).alias("_p0"), F.lead(position).over(w).alias("_p1"), F.row_number().over(w).alias("_i"),
        *[F.col(v).alias(f"{v}_0") for v in values], *[F.lead(v).over(w).alias(f"{v}_1") for v in values],
    )
    wanted = F.filter(targets, lambda t: (
        ((t >= F.col("_p0")) | (F.col("_i") == 1)) & (F.col("_p1").isNull() | (t < F.col("_p1")))
    ))
    rows = step.withColumn(position, F.explode(wanted))
    at = (F.col(position) - F.col("_p0")) / (F.col("_p1") - F.col("_p0"))
    inside = F.col("_p1").isNotNull() & (F.col(position) > F.col("_p0"))
    return rows.select(
        *keys, position,
        *[F.when(inside, F.col(f"{v}_0") + at * (F.col(f"{v}_1") - F.col(f"{v}_0"))).otherwise(F.col(f"{v}_0")).alias(v)
          for v in values],
    )


def recency_weights(df: DataFrame, ts: str, end: Column, half_life_days: float, keys: Sequence[str] = ()) -> DataFrame:
    """2^(-age / half-life) scaled to mean one; a row later than ``end`` fails the job."""
    age = hours_between(end, ts) / 24.0
    raw = require(age >= -1e-12, "training rows after the training end", F.pow(F.lit(2.0), -F.greatest(age, F.lit(0.0)) / half_life_days))
    weighted = df.withColumn("_raw", raw)
    if keys:
        means = weighted.groupBy(*keys).agg(F.avg("_raw").alias("_mean"))
        return attach(weighted, means, keys).withColumn("weight", F.col("_raw") / F.col("_mean")).drop("_raw", "_mean")
    mean = weighted.agg(F.avg("_raw")).scalar()
    return weighted.withColumn("weight", F.col("_raw") / mean).drop("_raw")


def consecutive_equal_fraction(value: str, keys: Sequence[str], ts: str) -> Column:
    """1.0 where the value equals the one before, null on the first row; average it to get the fraction."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(ts))
    return F.when(before.isNotNull(), (F.col(value) == before).cast("double"))


def bounded_correction(baseline_cf: ColumnLike, raw: ColumnLike, maximum: float, shrinkage: float) -> Column:
    """Baseline plus a clipped and shrunk residual, as a capacity factor in [0, 1.02]."""
    return clip(col(baseline_cf) + shrinkage * clip(raw, -maximum, maximum), 0.0, 1.02)
