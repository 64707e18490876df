"""Ten-minute turbine telemetry to hourly groups, power curves, states and availability."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions.exprs import ColumnLike, clip, col, finite, sum_when
from windrow.functions.ranks import exact_quantiles
from windrow.functions.wind import circular_difference, circular_mean
from windrow.operators.lookups import attach

# fixed values
INTERVALS_PER_HOUR = 6
SPIKE_BOUNDS = (-30.0, 630.0)
CUT_IN, CUT_OUT = 3.0, 25.0
MAX_WIND = 75.0
ONLINE_POWER = 1.0
CAPACITY_FACTOR_CAP = 1.10
STATES = ("NORMAL", "PARTIAL_DERATE", "CURTAILMENT_LIKE", "OUTAGE_LIKE", "LOW_RESOURCE", "SENSOR_OR_DATA_ANOMALY", "UNKNOWN")
CURVE_ANCHORS = ((0.0, 0.0), (3.0, 0.0), (12.0, 1.0), (20.0, 1.0), (24.99, 1.0))
CONFIDENCE_FLOOR = 0.5


def mask_spikes(value: ColumnLike, low: ColumnLike | float = SPIKE_BOUNDS[0], high: ColumnLike | float = SPIKE_BOUNDS[1]) -> tuple[Column, Column]:
    """(cleaned value, spike flag): a finite reading outside the physical bounds becomes missing, not clipped."""
    c = col(value)
    bound = lambda b: F.lit(float(b)) if isinstance(b, (int, float)) else col(b)
    spike = finite(c) & ((c < bound(low)) | (c > bound(high)))
    return F.when(finite(c) & ~spike, c), spike


def hourly_groups(df: DataFrame, specs: DataFrame, keys: Sequence[str] = ("hour_end", "grp"), slot: str = "slot",
                  max_wind: float = MAX_WIND, online_power: float = ONLINE_POWER, cut_in: float = CUT_IN,
                  cut_out: float = CUT_OUT) -> DataFrame:
    """One row per (hour, group) with energy, wind, direction, validity, availability and gap-scaled energy.

    ``specs`` holds per group: low, high (power bounds), expected (readings per hour) and group_capacity.  A group is a
    farm, so an hour of it holds a registered number of readings and the two exact percentiles stay small.
    """
    rows = attach(df, specs, ["grp"], "inner")
    power, spike = mask_spikes("power", "low", "high")
    ws_ok = finite("ws") & F.col("ws").between(0.0, max_wind)
    rows = rows.select(
        *keys, slot, "expected", "group_capacity", power.alias("p"), spike.alias("spike"),
        F.when(ws_ok, F.col("ws")).alias("s"), (finite("ws") & ~ws_ok).alias("bad_ws"),
        F.when(finite("wd"), F.pmod(F.col("wd"), F.lit(360.0))).alias("d"),
    )
    adequate = F.coalesce(F.col("p").isNotNull() & F.col("s").between(cut_in, cut_out), F.lit(False))
    angle = F.radians("d")
    out = rows.groupBy(*keys).agg(
        F.first("expected").alias("_e"), F.first("group_capacity").alias("_c"),
        F.sum("p").alias("obs_power"), F.avg("p").alias("obs_power_mean"), F.stddev_pop("p").alias("obs_power_std"),
        F.avg("s").alias("obs_ws_mean"), F.stddev_pop("s").alias("obs_ws_std"), F.min("s").alias("obs_ws_min"),
        F.max("s").alias("obs_ws_max"), F.percentile("s", F.lit(0.10)).alias("obs_ws_p10"),
        F.percentile("s", F.lit(0.90)).alias("obs_ws_p90"), F.avg(F.sin(angle)).alias("obs_wd_sin"),
        F.avg(F.cos(angle)).alias("obs_wd_cos"), F.countDistinct(slot).alias("obs_n_intervals"),
        F.count("p").alias("obs_n_power_valid"), F.count("s").alias("obs_n_ws_valid"), F.count("d").alias("obs_n_wd_valid"),
        sum_when(F.col("s").isNotNull() & F.col("d").isNotNull()).alias("obs_n_wind_pair_valid"),
        sum_when(adequate).alias("obs_n_adequate_wind"), sum_when(adequate & (F.col("p") > online_power)).alias("obs_n_online"),
        sum_when(adequate & (F.col("p") <= 0.0)).alias("_zero"), sum_when(F.col("spike")).alias("obs_power_spike_count"),
        sum_when(F.col("bad_ws")).alias("obs_invalid_ws_count"),
    )

    def share(name: str, over: ColumnLike) -> Column:
        return clip(F.col(name) / col(over), 0.0, 1.0)

    wet = F.nullif(F.col("obs_n_adequate_wind"), F.lit(0))
    return out.withColumns({
        "obs_wd_resultant": F.hypot("obs_wd_sin", "obs_wd_cos"),
        "obs_wd_mean_deg": circular_mean("obs_wd_sin", "obs_wd_cos"),
        "obs_record_fraction": clip(F.col("obs_n_intervals") / float(INTERVALS_PER_HOUR), 0.0, 1.0),
        "obs_power_valid_fraction": share("obs_n_power_valid", "_e"), "obs_ws_valid_fraction": share("obs_n_ws_valid", "_e"),
        "obs_wd_valid_fraction": share("obs_n_wd_valid", "_e"), "obs_wind_valid_fraction": share("obs_n_wind_pair_valid", "_e"),
        "obs_power_spike_fraction": share("obs_power_spike_count", "_e"),
        "obs_turbine_availability": share("obs_n_online", wet), "obs_zero_power_fraction": share("_zero", wet),
        "obs_power_scaled": F.col("obs_power_mean") * F.col("_e"),
        "obs_capacity_factor": clip(F.col("obs_power_mean") * F.col("_e") / F.col("_c"), 0.0, CAPACITY_FACTOR_CAP),
    }).drop("_e", "_c", "_zero")


def strict_turbine_energy(df: DataFrame, keys: Sequence[str], value: str = "power", required: int = INTERVALS_PER_HOUR) -> DataFrame:
    """Energy of a turbine hour, only when exactly the required number of readings is valid."""
    n = F.count(value)
    return df.groupBy(*keys).agg(n.alias("n_valid"), F.when(n == required, F.sum(value)).alias("energy"))


def fleet_mean(df: DataFrame, keys: Sequence[str], value: str, minimum: int) -> DataFrame:
    """Mean over all valid readings of the hour, null below the minimum count."""
    n = F.count(value)
    return df.groupBy(*keys).agg(n.alias("n_valid"), F.when(n >= minimum, F.sum(value) / n).alias("fleet_mean"))


def peer_rows(df: DataFrame, keys: Sequence[str], member: str, fields: Sequence[str]) -> DataFrame:
    """One row per timestamp of a group with its members as an ordered array: a farm's turbines at one moment."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(member, *fields))).alias("m"))


def _median(values: Column) -> Column:
    ordered = F.array_sort(values)
    n = F.size(values)
    low = F.try_element_at(ordered, F.floor((n + 1) / 2).cast("int"))
    return F.when(n > 0, (low + F.try_element_at(ordered, (F.floor(n / 2) + 1).cast("int"))) / 2.0)


def _sorted_values(members: str, value: str) -> Column:
    return F.array_sort(F.filter(F.transform(members, lambda y: y[value]), lambda y: y.isNotNull()))


def _median_without(ordered: str, own: Column) -> Column:
    """Median of a sorted array with one occurrence of ``own`` left out (none if it is null), read from its two middle places."""
    place = F.coalesce(F.array_position(ordered, own), F.lit(0)).cast("int")
    n = F.size(ordered) - F.when(place > 0, 1).otherwise(0)
    at = lambda k: F.try_element_at(ordered, (k + F.when((place > 0) & (k >= place), 1).otherwise(0)).cast("int"))
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2.0)


def leave_one_out_median(df: DataFrame, keys: Sequence[str], member: str, value: str, name: str = "peer_median") -> DataFrame:
    """Median of the other members at the same timestamp; peers without a value are ignored."""
    rows = peer_rows(df, keys, member, [value]).withColumn("_sorted", _sorted_values("m", value))
    with_peers = F.transform("m", lambda x: F.struct(x[member].alias(member), x[value].alias(value), _median_without("_sorted", x[value]).alias(name)))
    return rows.select(*keys, F.inline(with_peers))


def proxy_states(df: DataFrame, keys: Sequence[str], member: str, power: str, wind: str, potential: str) -> DataFrame:
    """Ordered state rules per reading from the reading, its peers and the group at the same timestamp."""
    p, w, c = F.col(power), F.col(wind), F.col(potential)
    valid = F.coalesce(finite(p) & finite(w) & finite(c) & p.between(0.0, 1.05) & w.between(0.0, 40.0), F.lit(False))
    ok = valid & w.between(3.0, 20.0) & (c >= 0.10)
    rows = df.withColumns({"_valid": valid, "_ok": F.coalesce(ok, F.lit(False))})
    rows = rows.withColumn("ratio", F.when(F.col("_ok"), p / c))
    extra = [k for k in (power, wind, potential, "_valid", "_ok", "ratio")]
    packed = peer_rows(rows, keys, member, extra)
    ratios = F.transform(F.filter("m", lambda x: x["ratio"].isNotNull()), lambda x: x["ratio"])
    packed = packed.withColumns({
        "_group_median": _median(ratios), "_sorted": _sorted_values("m", "ratio"), "_n_ok": F.size(ratios),
        "_low": F.when(F.size(ratios) > 0, F.size(F.filter(ratios, lambda r: r < 0.70)) / F.size(ratios)).otherwise(0.0),
    })
    one = F.transform("m", lambda x: F.struct(
        x[member].alias(member), *[x[e].alias(e) for e in extra],
        _median_without("_sorted", x["ratio"]).alias("peer")))
    flat = packed.select(*keys, "_group_median", "_n_ok", "_low", F.inline(one))
    r, supported = F.col("ratio"), F.col("_ok") & (F.col("_n_ok") >= 3)
    yes = lambda cond: F.coalesce(cond, F.lit(False))
    state = (
        F.when(~F.col("_valid"), "SENSOR_OR_DATA_ANOMALY")
        .when(yes((w < 3.0) | (c < 0.10)), "LOW_RESOURCE")
        .when(yes(supported & (r <= 0.10) & (F.col("peer") >= 0.75)), "OUTAGE_LIKE")
        .when(yes(supported & (F.col("_group_median") <= 0.60) & (F.col("_low") >= 2.0 / 3.0) & (r < 0.75)), "CURTAILMENT_LIKE")
        .when(yes(supported & (r >= 0.80) & (F.col("peer") >= 0.75)), "NORMAL")
        .when(yes(supported & (r > 0.10) & (r < 0.80)), "PARTIAL_DERATE")
        .otherwise("UNKNOWN")
    )
    return flat.withColumn("state", state).drop("_group_median", "_n_ok", "_low", "_valid", "_ok")


def entropy(counts: Sequence[ColumnLike]) -> Column:
    """Natural-log entropy of counts; null if there are none."""
    cols = [col(c) for c in counts]
    total = sum(cols[1:], cols[0]).cast("double")
    parts = [F.when(c > 0, -(c / total) * F.log(c / total)).otherwise(0.0) for c in cols]
    return F.when(total > 0, sum(parts[1:], parts[0]))


def jensen_shannon(pairs: Sequence[tuple[ColumnLike, ColumnLike]]) -> Column:
    """Divergence of two distributions given side by side; terms with zero mass are skipped, a distribution without any
    mass gives null."""
    a, b = [col(x).cast("double") for x, _ in pairs], [col(y).cast("double") for _, y in pairs]
    ta, tb = F.nullif(sum(a[1:], a[0]), F.lit(0.0)), F.nullif(sum(b[1:], b[0]), F.lit(0.0))
    out = F.lit(0.0)
    for x, y in zip(a, b):
        p, q = x / ta, y / tb
        mid = 0.5 * (p + q)
        out = out + 0.5 * F.when(p > 0, p * F.log(p / mid)).otherwise(0.0) + 0.5 * F.when(q > 0, q * F.log(q / mid)).otherwise(0.0)
    return F.when(ta.isNotNull() & tb.isNotNull(), out)


def hourly_states(states: DataFrame, keys: Sequence[str], expected_cells: ColumnLike, power: str, wind: str, potential: str) -> DataFrame:
    """State shares, availability, delivered and potential capacity factor, entropy and the normal-hour flag."""
    p, w, c = F.col(power), F.col(wind), F.col(potential)
    ok = F.coalesce(p.between(0.0, 1.05) & w.between(3.0, 20.0) & (c >= 0.10), F.lit(False))
    out = states.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), sum_when(ok).alias("resource_eligible_cells"), sum_when(ok, p).alias("_p"),
        sum_when(ok, c).alias("_c"), sum_when(F.coalesce(p.between(0.0, 1.05), F.lit(False)), p).alias("_all_p"),
        F.coalesce(F.sum(c), F.lit(0.0)).alias("_all_c"), sum_when((F.col("state") == "UNKNOWN") & ok).alias("_unk"),
        *[sum_when(F.col("state") == s).alias(f"_k_{s}") for s in STATES],
    )
    expected = expected_cells if isinstance(expected_cells, Column) else F.col(expected_cells)
    out = out.withColumns({
        "availability_factor": F.when(F.col("_c") > 0, clip(F.col("_p") / F.col("_c"), 0.0, 1.0)),
        "delivered_cf": F.col("_all_p") / expected, "potential_cf": F.col("_all_c") / expected,
        "state_entropy": entropy([f"_k_{s}" for s in STATES]),
        "unknown_resource_fraction": F.col("_unk") / F.greatest(F.col("resource_eligible_cells"), F.lit(1)),
        **{f"{s.lower()}_fraction": F.col(f"_k_{s}") / F.col("_n") for s in STATES},
    })
    normal = F.coalesce((F.col("availability_factor") >= 0.85) & (F.col("normal_fraction") >= 0.75), F.lit(False))
    return out.withColumn("normal_hour", normal).drop("_n", "_p", "_c", "_all_p", "_all_c", "_unk", *[f"_k_{s}" for s in STATES])


def confidence_weights(df: DataFrame, availability: str, normal: str, unknown: str, entropy_col: str) -> DataFrame:
    """Mean-one weight floor + (1 - floor) a n (1 - u)(1 - e); a missing part gives confidence zero."""
    cap = lambda c: clip(c, 0.0, 1.0)
    parts = (availability, normal, unknown, entropy_col)
    known = finite(parts[0])
    for c in parts[1:]:
        known = known & finite(c)
    value = cap(availability) * cap(normal) * (1.0 - cap(unknown)) * (1.0 - cap(F.col(entropy_col) / math.log(len(STATES))))
    rows = df.withColumn("confidence", F.when(known, value).otherwise(0.0))
    rows = rows.withColumn("raw_weight", CONFIDENCE_FLOOR + (1.0 - CONFIDENCE_FLOOR) * F.col("confidence"))
    return rows.withColumn("weight", F.col("raw_weight") / rows.agg(F.avg("raw_weight")).scalar())


def turbine_bias(df: DataFrame, keys: Sequence[str], turbine: str, value: str, circular: bool = False) -> DataFrame:
    """Median difference of a turbine's reading to the mean of all turbines of its group at the same time."""
    rows = df.where(F.col(value).isNotNull())
    if circular:
        angle = F.radians(value)
        # opposite directions cancel to rounding noise; rounding makes their mean well defined
        mean = circular_mean(F.round(F.avg(F.sin(angle)), 12), F.round(F.avg(F.cos(angle)), 12))
        means = rows.groupBy(*keys).agg(F.round(mean, 9).alias("_mean"))
        gap = circular_difference(value, "_mean")
    else:
        means = rows.groupBy(*keys).agg(F.avg(value).alias("_mean"))
        gap = F.col(value) - F.col("_mean")
    gaps = rows.join(means, list(keys)).select(turbine, F.round(gap, 12).alias("_gap"))
    return exact_quantiles(gaps, [turbine], "_gap", [0.5]).select(turbine, F.col("q")[0].alias("bias"))


def binned_curve(df: DataFrame, turbine: str, wind: str, power: str, width: float, quantile: float, minimum: int) -> DataFrame:
    """(turbine, bin): median wind, power quantile and count of the bins with enough rows."""
    rows = df.where(F.col(wind).isNotNull() & F.col(power).isNotNull()).withColumn("bin", F.floor(F.col(wind) / width))
    keys = [turbine, "bin"]
    x = exact_quantiles(rows, keys, wind, [0.5]).select(*keys, F.col("n"), F.col("q")[0].alias("x")).where(F.col("n") >= minimum)
    y = exact_quantiles(rows, keys, power, [quantile]).select(*keys, F.col("q")[0].alias("y"))
    return x.join(y, keys)


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted non-decreasing least-squares fit."""
    level, mass, size = [], [], []
    for v, w in zip(values, weights):
        level.append(v), mass.append(w), size.append(1)
        while len(level) > 1 and level[-2] > level[-1]:
            total = mass[-2] + mass[-1]
            level[-2:] = [(level[-2] * mass[-2] + level[-1] * mass[-1]) / total]
            mass[-2:], size[-2:] = [total], [size[-2] + size[-1]]
    return np.repeat(level, size)


def isotonic_curve(binned: DataFrame, turbine: str, anchors: Sequence[tuple[float, float]] = CURVE_ANCHORS,
                   anchor_weight: float = 20.0, low: float = 0.0, high: float = 1.02) -> DataFrame:
    """Monotone curve knots (turbine, x, y) through the binned points and the physical anchors.

    A curve has at most as many points as wind bins, so one turbine's points fit a task; turbines run in parallel.
    """
    ax, ay = np.array([a for a, _ in anchors]), np.array([b for _, b in anchors])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        points = pd.DataFrame({
            "x": np.concatenate([ax, pdf["x"]]), "y": np.concatenate([ay, pdf["y"]]),
            "w": np.concatenate([np.full(len(ax), anchor_weight), pdf["n"].to_numpy(float)])})
        points["wy"] = points["w"] * points["y"]
        merged = points.groupby("x", sort=True)[["w", "wy"]].sum()
        fitted = pool_adjacent((merged["wy"] / merged["w"]).to_numpy(), merged["w"].to_numpy())
        return pd.DataFrame({turbine: pdf[turbine].iloc[0], "x": merged.index.to_numpy(), "y": np.clip(fitted, low, high)})

    kind = binned.schema[turbine].dataType.simpleString()
    return binned.groupBy(turbine).applyInPandas(fit, f"{turbine} {kind}, x double, y double")


def curve_segments(knots: DataFrame, turbine: str, step: float) -> DataFrame:
    """Segments between knots, listed under every lattice cell they touch, so that a lookup is an equi join."""
    w = Window.partitionBy(turbine).orderBy("x")  # one curve
    seg = knots.select(turbine, F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"))
    seg = seg.where(F.col("x1").isNotNull())
    return seg.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("x0") / step), F.floor(F.col("x1") / step))))


def curve_lookup(df: DataFrame, knots: DataFrame, turbine: str, wind: str, name: str, step: float = 0.5) -> DataFrame:
    """Linear interpolation on each turbine's curve, end values outside; null wind stays null."""
    ends = knots.groupBy(turbine).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    rows = attach(df, ends, [turbine])
    at = F.least(F.greatest(F.col(wind), F.col("_lo")), F.col("_hi"))
    rows = rows.withColumn("_at", F.when(F.col(wind).isNotNull(), at)).withColumn("_cell", F.floor(F.col("_at") / step))
    seg = curve_segments(knots, turbine, step).withColumn("_last", F.col("x1") == F.max("x1").over(Window.partitionBy(turbine)))
    cells = seg.groupBy(turbine, "_cell").agg(F.sort_array(F.collect_list(F.struct("x0", "x1", "y0", "y1", "_last"))).alias("_seg"))
    met = attach(rows, cells, [turbine, "_cell"])
    hit = F.try_element_at(F.filter("_seg", lambda s: (F.col("_at") >= s["x0"]) & ((F.col("_at") < s["x1"]) | (s["_last"] & (F.col("_at") == s["x1"])))), F.lit(1))
    value = hit["y0"] + (F.col("_at") - hit["x0"]) / (hit["x1"] - hit["x0"]) * (hit["y1"] - hit["y0"])
    return met.withColumn(name, value).drop("_lo", "_hi", "_at", "_cell", "_seg")


def physical_fleet(hours: DataFrame, turbines: DataFrame, knots: DataFrame, keys: Sequence[str], wind: str, farm: str = "grp",
                   turbine: str = "turbine") -> DataFrame:
    """Fleet energy from one predicted fleet wind: turbine bias, curve, cut-in and cut-out, summed over the farm."""
    rows = attach(hours, turbines.select(farm, turbine, "bias", "rated"), [farm], "inner")
    rows = rows.withColumn("_eff", F.col(wind) + F.col("bias")).withColumn("_at", clip("_eff", 0.0, 24.99))
    rows = curve_lookup(rows, knots, turbine, "_at", "_cf")
    cf = F.when((F.col("_eff") < CUT_IN) | (F.col("_eff") >= CUT_OUT), 0.0).otherwise(clip("_cf", 0.0, 1.02))
    out = rows.groupBy(*keys).agg(F.sum(cf * F.col("rated")).alias("_kwh"), F.sum("rated").alias("_cap"))
    return out.select(*keys, clip("_kwh", 0.0, 1.02 * F.col("_cap")).alias("physical_kwh"))


def availability_cells(df: DataFrame, turbine: str, month: ColumnLike, direction: str, ratio: str, shrink: float = 120.0,
                       sectors: int = 8) -> DataFrame:
    """Mean ratio per turbine, month and direction sector, shrunk to the turbine's mean by n / (n + shrink).  The turbine
    mean comes from the cell totals, so the rows are read once."""
    sector = (F.floor(F.pmod(F.col(direction), F.lit(360.0)) / (360.0 / sectors))).cast("int")
    cells = df.where(F.col(ratio).isNotNull() & F.col(direction).isNotNull()).groupBy(
        turbine, col(month).alias("month"), sector.alias("sector")).agg(F.sum(ratio).alias("_s"), F.count(F.lit(1)).alias("n"))
    whole = cells.groupBy(turbine).agg((F.sum("_s") / F.sum("n")).alias("availability_global"))
    out = attach(cells, whole, [turbine])
    weight = F.col("n") / (F.col("n") + shrink)
    return out.withColumn("availability", weight * F.col("_s") / F.col("n") + (1.0 - weight) * F.col("availability_global")).drop("_s")


def channel_audit(df: DataFrame, channels: dict[str, tuple[float, float] | None], keys: Sequence[str] = ()) -> DataFrame:
    """Rows, finite, missing, extremes and out-of-range counts per channel of a long or wide telemetry table, one pass."""
    items = F.array(*[
        F.struct(F.lit(name).alias("channel"), F.col(name).cast("double").alias("value"),
                 (F.lit(False) if span is None else finite(name) & ~F.col(name).between(*span)).alias("outside"))
        for name, span in channels.items()])
    long = df.select(*keys, F.inline(items))
    return long.groupBy(*keys, "channel").agg(
        F.count(F.lit(1)).alias("rows"), sum_when(finite("value")).alias("finite_rows"), sum_when(~finite("value")).alias("missing_rows"),
        F.min(F.when(finite("value"), F.col("value"))).alias("minimum"), F.max(F.when(finite("value"), F.col("value"))).alias("maximum"),
        sum_when(F.col("outside")).alias("out_of_range"))


def reliability_gate(hourly: DataFrame, group: str, window: str, train: str, valid: str, min_hours: int = 500,
                     max_unknown: float = 0.15, max_divergence: float = 0.15) -> DataFrame:
    """Per group: resource hours and unknown share of both windows, divergence of their state shares, and the gate."""
    shares = [f"{s.lower()}_fraction" for s in STATES]
    per = hourly.groupBy(group).agg(*[
        e for name, w in (("train", train), ("valid", valid)) for e in (
            sum_when((F.col(window) == w) & F.col("availability_factor").isNotNull()).alias(f"{name}_resource_hours"),
            F.avg(F.when(F.col(window) == w, F.col("unknown_resource_fraction"))).alias(f"{name}_unknown"),
            *[F.avg(F.when(F.col(window) == w, F.col(s))).alias(f"_{name}_{s}") for s in shares])])
    out = per.withColumn("state_divergence", jensen_shannon([(f"_train_{s}", f"_valid_{s}") for s in shares]))
    ok = F.lit(True)
    for name in ("train", "valid"):
        ok = ok & (F.col(f"{name}_resource_hours") >= min_hours) & (F.col(f"{name}_unknown") <= max_unknown)
    return out.withColumn("gate", F.coalesce(ok & (F.col("state_divergence") <= max_divergence), F.lit(False))).drop(
        *[f"_{n}_{s}" for n in ("train", "valid") for s in shares])


def median_lookup(train: DataFrame, apply: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Training median of the row's cell, or the overall training median where the cell was never seen."""
    cell = exact_quantiles(train, keys, value, [0.5]).select(*keys, F.element_at("q", 1).alias("_cell"))
    whole = exact_quantiles(train.withColumn("_one", F.lit(1)), ["_one"], value, [0.5]).select(F.element_at("q", 1)).scalar()
    return attach(apply, cell, keys).withColumn(name, F.coalesce("_cell", whole)).drop("_cell")
