"""Column profiles, period drift, shift statistics, stability tests and regression diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions.exprs import clip, finite, sum_when
from windrow.functions.ranks import exact_quantiles, quantile_grid
from windrow.operators.gaps import long_form, training_medians
from windrow.operators.lookups import attach
from windrow.operators.runs import consecutive_equal_fraction
from windrow.operators.telemetry import curve_lookup

# fixed values
PROFILE_QUANTILES = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)
SHIFT_POINTS = 257
MIN_POOLED_STD = 1e-12
IQR_RATIO = (0.1, 10.0)
PSI_LIMIT, PSI_SMOOTHING = 0.5, 0.5
VARIANCE_GUARD = 1e-12
NRMSE_FLOOR = 1e-9
HEDGE_BOUNDS, HEDGE_STRENGTH = (0.90, 1.10), 0.5
CELL_R2, CELL_NRMSE, CELL_WEAK_NRMSE, CELL_MIN_ROWS = 0.995, 0.02, 0.01, 48
TOP_ROWS = 12


def annual_profile(df: DataFrame, channels: Sequence[str], keys: Sequence[str], ts: str) -> DataFrame:
    """Per channel and key (grid, year): rows, missing, distinct, moments, nine quantiles, repeated-value share, constant.

    A group is one grid cell in one year, at most 8,784 hours, so its window and exact quantiles are bounded.
    """
    rows = long_form(df, [*keys, ts], channels)
    rows = rows.withColumn("_same", consecutive_equal_fraction("value", [*keys, "variable"], ts))
    good = F.when(finite("value"), F.col("value"))
    out = rows.groupBy("variable", *keys).agg(
        F.count(F.lit(1)).alias("rows"), sum_when(~finite("value")).alias("missing_count"), F.countDistinct(good).alias("finite_unique"),
        F.avg(good).alias("mean"), F.stddev_pop(good).alias("std"),
        F.percentile(good, F.array(*[F.lit(q) for q in PROFILE_QUANTILES])).alias("_q"),
        # a comparison with a missing neighbour is not equal, so it counts in the denominator only
        (F.sum(F.coalesce("_same", F.lit(0.0))) / F.nullif(F.count(F.lit(1)) - 1, F.lit(0))).alias("consecutive_equal_fraction"),
        (F.min(good) == F.max(good)).alias("constant"),
    )
    return out.select(
        "variable", *keys, "rows", "missing_count", (F.col("missing_count") / F.col("rows")).alias("missing_fraction"), "finite_unique", "mean", "std",
        *[F.element_at("_q", i + 1).alias(f"q{int(q * 100):02d}") for i, q in enumerate(PROFILE_QUANTILES)],
        "consecutive_equal_fraction", F.coalesce("constant", F.lit(False)).alias("constant"))


def pair_drift(df: DataFrame, channels: Sequence[str], keys: Sequence[str], is_reference: Column, month: Column, day: Column,
               horizon: Column) -> DataFrame:
    """Reference against application period per channel and grid: standardised mean shift, spread ratio, quantile L1, and
    absolute z over the calendar cells both periods have.

    Both sides are conditional aggregates of one pass, so calendar cells meet without a join.  A group is one grid cell
    over the registered years.
    """
    tagged = df.withColumns({"_ref": is_reference, "_m": month, "_d": day, "_h": horizon})
    rows = long_form(tagged, [*keys, "_ref", "_m", "_d", "_h"], channels)
    by = ["variable", *keys]
    good = F.when(finite("value"), F.col("value"))
    ref, app = F.when(F.col("_ref"), good), F.when(~F.col("_ref"), good)
    grid = F.array(*[F.lit(0.01 + 0.98 * i / 98) for i in range(99)])
    whole = rows.groupBy(*by).agg(
        sum_when(F.col("_ref")).alias("reference_rows"), sum_when(~F.col("_ref")).alias("application_rows"),
        F.avg(ref).alias("_mr"), F.avg(app).alias("_ma"), F.stddev_pop(ref).alias("_sr"), F.stddev_pop(app).alias("_sa"),
        F.percentile(ref, grid).alias("_qr"), F.percentile(app, grid).alias("_qa"),
        F.avg(F.when(~F.col("_ref"), F.col("value").isNull().cast("double"))).alias("_na"),
        F.avg(F.when(F.col("_ref"), F.col("value").isNull().cast("double"))).alias("_nr"))
    whole = whole.withColumn("scale", F.when(F.col("_sr") > 0, F.col("_sr")).otherwise(1.0))
    seasonal = rows.groupBy(*by, "_m", "_h").agg(F.avg(ref).alias("r"), F.avg(app).alias("a")).where(F.col("r").isNotNull() & F.col("a").isNotNull())
    seasonal = seasonal.groupBy(*by).agg(F.avg(F.abs(F.col("a") - F.col("r"))).alias("_sz"), F.max(F.abs(F.col("a") - F.col("r"))).alias("_sx"))
    daily = rows.groupBy(*by, "_m", "_d", "_h").agg(F.percentile(ref, F.lit(0.5)).alias("r"), F.percentile(app, F.lit(0.5)).alias("a"))
    daily = daily.where(F.col("r").isNotNull() & F.col("a").isNotNull()).groupBy(*by).agg(
        F.percentile(F.abs(F.col("a") - F.col("r")), F.array(F.lit(0.5), F.lit(0.95))).alias("_dz"), F.count(F.lit(1)).alias("daily_matched_cells"))
    out = whole.join(seasonal, by, "left").join(daily, by, "left")
    gap = F.aggregate(F.zip_with("_qr", "_qa", lambda r, a: F.abs(a - r)), F.lit(0.0), lambda acc, g: acc + g) / 99.0
    s = F.col("scale")
    return out.select(
        *by, "reference_rows", "application_rows", ((F.col("_ma") - F.col("_mr")) / s).alias("mean_shift"), (F.col("_sa") / s).alias("std_ratio"),
        (F.col("_na") - F.col("_nr")).alias("missing_delta"), (gap / s).alias("quantile_l1"), (F.col("_sz") / s).alias("seasonal_abs_z_mean"),
        (F.col("_sx") / s).alias("seasonal_abs_z_max"), (F.element_at("_dz", 1) / s).alias("daily_abs_z_median"),
        (F.element_at("_dz", 2) / s).alias("daily_abs_z_p95"), F.coalesce("daily_matched_cells", F.lit(0)).alias("daily_matched_cells"))


def control_ratios(drift: DataFrame, controls: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Seasonal and daily drift over the largest historical drift of the same channel and grid."""
    out = drift
    for i, c in enumerate(controls):
        out = out.join(c.select(*keys, F.col("seasonal_abs_z_mean").alias(f"_s{i}"), F.col("daily_abs_z_p95").alias(f"_d{i}")), list(keys))
    floor = F.lit(1e-12)
    return out.withColumns({
        "seasonal_control_ratio": F.col("seasonal_abs_z_mean") / F.greatest(floor, *[F.col(f"_s{i}") for i in range(len(controls))]),
        "daily_control_ratio": F.col("daily_abs_z_p95") / F.greatest(floor, *[F.col(f"_d{i}") for i in range(len(controls))]),
    }).drop(*[f"_{t}{i}" for i in range(len(controls)) for t in "sd"])


def drift_flag() -> Column:
    """Registered drift rules over the columns of :func:`pair_drift` and :func:`control_ratios`."""
    moved = (F.col("quantile_l1") > 1e-9) | (F.abs("mean_shift") > 1e-9)
    return (
        (F.abs("missing_delta") > 0.001) | (F.abs("mean_shift") > 0.75) | (moved & (F.col("std_ratio") < 0.50)) | (moved & (F.col("std_ratio") > 2.0))
        | ((F.col("seasonal_abs_z_mean") > 0.35) & (F.col("seasonal_control_ratio") > 3.0))
        | ((F.col("daily_abs_z_p95") > 3.5) & (F.col("daily_control_ratio") > 2.0)))


def top_per_metric(df: DataFrame, metrics: Sequence[str], order: Sequence[str], n: int = TOP_ROWS) -> DataFrame:
    """The n largest rows of every metric; a rank filter is cut per partition before the shuffle."""
    rows = df.select(*order, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.abs(F.col(m)).alias("value")) for m in metrics])))
    w = Window.partitionBy("metric").orderBy(F.round("value", 12).desc(), *order)
    return rows.where(F.col("value").isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def run_alignment(df: DataFrame, ts: str = "forecast_ts", issued: str = "issued_ts", grid: str = "grid_id") -> DataFrame:
    """One report row: sizes, completeness, issuance uniqueness, leads and run sizes, from aggregates per hour and run."""
    lead = F.timestamp_diff("HOUR", F.col(issued), F.col(ts))
    cells = df.groupBy(ts, issued, grid).agg(F.count(F.lit(1)).alias("n"))
    hours = cells.groupBy(ts).agg(F.countDistinct(grid).alias("grids"), F.countDistinct(issued).alias("issues"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("dup"))
    a = hours.agg(F.count(F.lit(1)).alias("forecast_hours"), F.min(ts).alias("start"), F.max(ts).alias("end"), F.sum("dup").alias("duplicate_rows"),
                  F.min("grids").alias("grid_count_min"), F.max("grids").alias("grid_count_max"), F.max("issues").alias("issues_per_hour_max"))
    runs = cells.select(ts, issued).distinct().groupBy(issued).agg(
        F.count(F.lit(1)).alias("size"), F.min(lead).alias("first"), F.max(lead).alias("last"))
    b = runs.agg(F.count(F.lit(1)).alias("runs"), F.min("size").alias("run_size_min"), F.max("size").alias("run_size_max"), F.min("first").alias("lead_min"),
                 F.max("last").alias("lead_max"), F.bool_and((F.col("size") == 24) & (F.col("first") == 12) & (F.col("last") == 35)).alias("all_runs_exact"))
    return a.join(F.broadcast(b))


def duplicate_vectors(df: DataFrame, channels: Sequence[str], ts: str = "forecast_ts") -> DataFrame:
    """Rows whose whole channel vector repeats inside one hour; counted on the vector itself, so it is exact."""
    packed = df.groupBy(ts, *channels).agg(F.count(F.lit(1)).alias("n"))
    per_hour = packed.groupBy(ts).agg(F.count(F.lit(1)).alias("unique"), F.sum("n").alias("rows"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated"))
    return per_hour.agg(F.sum("repeated").alias("repeated_rows"), (F.sum("repeated") / F.sum("rows")).alias("repeated_fraction"),
                        F.min("unique").alias("unique_min"), F.max("unique").alias("unique_max"))


def missing_events(df: DataFrame, channels: Sequence[str], ts: str = "forecast_ts") -> DataFrame:
    """Per affected hour: grid rows with any gap and the gaps per channel."""
    gaps = [F.col(c).isNull() for c in channels]
    anything = gaps[0]
    for g in gaps[1:]:
        anything = anything | g
    out = df.groupBy(ts).agg(sum_when(anything).alias("grid_rows_affected"), *[sum_when(g).alias(f"{c}_missing") for c, g in zip(channels, gaps)])
    return out.where(F.col("grid_rows_affected") > 0)


def wasserstein_shift(source: DataFrame, application: DataFrame, features: Sequence[str], points: int = SHIFT_POINTS) -> DataFrame:
    """Standardised distance of quantile functions per feature: trapezoid over equally spaced probabilities divided by the
    pooled population spread.  Degenerate features stay in the table but are not ranked."""
    rows = long_form(source, [], features).withColumn("side", F.lit("s")).unionByName(long_form(application, [], features).withColumn("side", F.lit("a")))
    rows = rows.where(F.col("value").isNotNull())
    spread = rows.groupBy("variable").agg(
        F.stddev_pop("value").alias("pooled_std"), sum_when(F.col("side") == "s").alias("source_rows"), sum_when(F.col("side") == "a").alias("application_rows"))
    grid = quantile_grid(rows, ["variable", "side"], "value", points)
    gaps = grid.groupBy("variable", "i").agg(F.abs(F.max(F.when(F.col("side") == "s", F.col("q"))) - F.max(F.when(F.col("side") == "a", F.col("q")))).alias("gap"))
    weight = F.when(F.col("i").isin(0, points - 1), 0.5).otherwise(1.0) / (points - 1)
    area = gaps.groupBy("variable").agg(F.sum(F.col("gap") * weight).alias("numerator"))
    out = spread.join(area, "variable")
    ok = F.col("pooled_std") > MIN_POOLED_STD
    position = F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(f), F.lit(i))])
    return out.select(F.col("variable").alias("feature"), F.element_at(position, F.col("variable")).alias("position"), "source_rows", "application_rows", "pooled_std",
                      F.when(ok, F.col("numerator")).otherwise(0.0).alias("wasserstein_numerator"),
                      F.when(ok, F.col("numerator") / F.col("pooled_std")).alias("shift_score"), ok.alias("rankable"))


def least_shifted(shift: DataFrame, keep_fraction: float) -> DataFrame:
    """The least shifted share of rankable features (at least one) in their original order."""
    ranked = shift.where("rankable")
    keep = F.greatest(F.floor(F.lit(float(keep_fraction)) * ranked.agg(F.count(F.lit(1))).scalar()), F.lit(1))
    w = Window.orderBy(F.round("shift_score", 12), "position")  # one row per feature of a registered schema
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).orderBy("position")


def stability_index(df: DataFrame, keys: Sequence[str], value: str, is_reference: Column) -> DataFrame:
    """Population stability index on the distinct deciles of the reference with half a count added to every bin."""
    rows = df.where(finite(value)).withColumn("_ref", is_reference)
    deciles = exact_quantiles(rows.where("_ref"), keys, value, [i / 10.0 for i in range(1, 10)]).select(*keys, F.array_sort(F.array_distinct("q")).alias("_e"))
    binned = attach(rows, deciles, keys, "inner").withColumn("_b", F.size(F.filter("_e", lambda e: e <= F.col(value))))
    counts = binned.groupBy(*keys, "_b").agg(F.first(F.size("_e") + 1).alias("_k"), sum_when(F.col("_ref")).alias("_r"), sum_when(~F.col("_ref")).alias("_c"))
    sizes = counts.groupBy(*keys).agg(F.sum("_r").alias("_nr"), F.sum("_c").alias("_nc"), F.max("_k").alias("bins"), F.count(F.lit(1)).alias("_seen"))
    terms = attach(counts, sizes, keys, "inner")

    def term(r: Column, c: Column) -> Column:
        k = F.col("bins")
        p = (r + PSI_SMOOTHING) / (F.col("_nr") + PSI_SMOOTHING * k)
        q = (c + PSI_SMOOTHING) / (F.col("_nc") + PSI_SMOOTHING * k)
        return (q - p) * F.log(q / p)

    filled = terms.groupBy(*keys).agg(F.sum(term(F.col("_r"), F.col("_c"))).alias("_psi"), *[F.max(c).alias(c) for c in ("bins", "_seen", "_nr", "_nc")])
    psi = F.col("_psi") + (F.col("bins") - F.col("_seen")) * term(F.lit(0), F.lit(0))
    return filled.select(*keys, "bins", F.col("_nr").alias("reference_rows"), F.col("_nc").alias("comparison_rows"), psi.alias("psi"), (psi < PSI_LIMIT).alias("passes"))


def iqr_stability(df: DataFrame, keys: Sequence[str], value: str, period: str, first: object, second: object) -> DataFrame:
    """Interquartile range of two periods per key, their ratio, why it may be unusable, and the gate."""
    q = exact_quantiles(df.where(finite(value)), [*keys, period], value, [0.25, 0.75])
    width = F.element_at("q", 2) - F.element_at("q", 1)
    out = q.groupBy(*keys).agg(F.max(F.when(F.col(period) == F.lit(first), width)).alias("iqr_first"), F.max(F.when(F.col(period) == F.lit(second), width)).alias("iqr_second"))
    a, b = F.col("iqr_first") <= VARIANCE_GUARD, F.col("iqr_second") <= VARIANCE_GUARD
    ratio = F.when(~(a | b), F.col("iqr_second") / F.col("iqr_first"))
    reason = F.when(a & b, "both periods constant").when(a, "first period constant").when(b, "second period constant")
    return out.withColumns({"ratio": ratio, "reason": reason}).withColumn(
        "passes", F.coalesce((F.col("ratio") > IQR_RATIO[0]) & (F.col("ratio") < IQR_RATIO[1]), F.lit(False)))


def nrmse_denominators(df: DataFrame, keys: Sequence[str], actual: str) -> DataFrame:
    """Pooled 5 to 95 % range with a floor."""
    q = exact_quantiles(df.where(finite(actual)), keys, actual, [0.05, 0.95])
    return q.select(*keys, F.greatest(F.element_at("q", 2) - F.element_at("q", 1), F.lit(NRMSE_FLOOR)).alias("denominator"))


def regression_metrics(df: DataFrame, keys: Sequence[str], actual: str, prediction: str, denominator: str) -> DataFrame:
    """R2, RMSE and NRMSE with the reason where a cell cannot be judged.

    Fewer than three distinct values means that no value lies between the extremes, which needs no distinct count.
    """
    y, e = F.col(actual), F.col(actual) - F.col(prediction)
    lo_hi = df.groupBy(*keys).agg(F.min(actual).alias("_lo"), F.max(actual).alias("_hi"), F.avg(actual).alias("_mean"))
    rows = attach(df, lo_hi, keys, "inner")
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.sum((y - F.col("_mean")) * (y - F.col("_mean"))).alias("sst"), F.sum(e * e).alias("sse"),
        F.first(denominator).alias("_den"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"),
        F.max(((y != F.col("_lo")) & (y != F.col("_hi"))).cast("int")).alias("_between"))
    few = (F.col("_lo") == F.col("_hi")) | (F.col("_between") == 0)
    reason = F.when(few, "fewer than 3 distinct values").when(F.col("sst") <= VARIANCE_GUARD, "no variance")
    ok = reason.isNull()
    return out.select(*keys, "rows", reason.alias("invalid_reason"), "sst", F.when(ok, F.sqrt(F.col("sse") / F.col("rows"))).alias("rmse"),
                      F.when(ok, 1.0 - F.col("sse") / F.col("sst")).alias("r2"), F.when(ok, F.sqrt(F.col("sse") / F.col("rows")) / F.col("_den")).alias("nrmse"))


def affine_fit(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Closed-form slope and intercept per key; a constant predictor gives slope zero and the mean."""
    sxx = F.regr_sxx(F.col(y), F.col(x))
    slope = F.when(F.coalesce(F.col("_sxx"), F.lit(0.0)) <= VARIANCE_GUARD, 0.0).otherwise(F.col("_sxy") / F.col("_sxx"))
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("train_rows"), sxx.alias("_sxx"), F.regr_sxy(F.col(y), F.col(x)).alias("_sxy"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    out = out.withColumn("slope", slope).withColumn("constant_predictor", F.coalesce(F.col("_sxx"), F.lit(0.0)) <= VARIANCE_GUARD)
    return out.withColumn("intercept", F.when(F.col("constant_predictor"), F.col("_my")).otherwise(F.col("_my") - F.col("slope") * F.col("_mx"))).drop("_sxx", "_sxy", "_mx", "_my")


def affine_crossfit(df: DataFrame, keys: Sequence[str], fold: str, folds: Sequence[int], x: str, y: str) -> DataFrame:
    """Out-of-fold affine prediction: each fold's line comes from the moments of the other folds, which are the totals
    minus the fold's own, so the rows are aggregated once for all folds."""
    a, b = F.col(x), F.col(y)
    parts = df.groupBy(*keys, fold).agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"))
    whole = parts.groupBy(*keys).agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "sx", "sy", "sxx", "sxy")])
    rest = parts.join(whole, list(keys)) if keys else parts.join(F.broadcast(whole))
    m = {c: F.col(f"t_{c}") - F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy")}
    m["n"] = F.nullif(m["n"], F.lit(0))  # a key with one fold has nothing to learn from
    vxx = m["sxx"] - m["sx"] * m["sx"] / m["n"]
    slope = F.when(vxx <= VARIANCE_GUARD, 0.0).otherwise((m["sxy"] - m["sx"] * m["sy"] / m["n"]) / F.nullif(vxx, F.lit(0.0)))
    lines = rest.select(*keys, fold, slope.alias("_slope"), (m["sx"] / m["n"]).alias("_mx"), (m["sy"] / m["n"]).alias("_my"))
    rows = attach(df, lines, [*keys, fold], "inner")
    return rows.withColumn("oof", F.col("_my") + F.col("_slope") * (a - F.col("_mx"))).drop("_slope", "_mx", "_my")


def cell_strength(metrics: DataFrame) -> DataFrame:
    """Not redundant where R2 stays below its cutoff or NRMSE above it; small cells are not judged."""
    judged = (F.col("rows") >= CELL_MIN_ROWS) & F.col("invalid_reason").isNull()
    return metrics.withColumns({
        "judged": judged, "strict": F.coalesce(judged & ((F.col("r2") < CELL_R2) | (F.col("nrmse") > CELL_NRMSE)), F.lit(False)),
        "weak": F.coalesce(judged & (F.col("nrmse") > CELL_WEAK_NRMSE), F.lit(False))})


def stability_gate(cells: DataFrame, keys: Sequence[str], kind: str = "kind", allowed: dict[str, int] | None = None) -> DataFrame:
    """All cells of every kind must be strict, except that ``allowed`` kinds may miss that many cells if those are weak."""
    per = cells.groupBy(*keys, kind).agg(
        F.count(F.lit(1)).alias("cells"), sum_when(F.col("strict")).alias("strict_cells"), sum_when(~F.col("strict") & F.col("weak")).alias("weak_only"))
    spare = F.lit(0)
    for name, n in (allowed or {}).items():
        spare = F.when(F.col(kind) == name, n).otherwise(spare)
    miss = F.col("cells") - F.col("strict_cells")
    per = per.withColumn("pass", (miss <= spare) & (F.col("weak_only") == miss))
    return per.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(~F.col("pass"), F.col(kind)))).alias("failed_kinds"), F.bool_and("pass").alias("stable"))


def quantile_map(reference: DataFrame, application: DataFrame, value: str, name: str = "mapped", points: int = 101, step: float = 0.25) -> DataFrame:
    """Map the application marginal onto the reference marginal.

    Repeated application quantiles share their mean probability; the knots become a curve and values are looked up on it
    by an equi join, so the table of values is never compared with the knots one by one.
    """
    tag = ["_one"]
    knots_a = quantile_grid(application.withColumn("_one", F.lit(1)), tag, value, points)
    knots_r = quantile_grid(reference.withColumn("_one", F.lit(1)), tag, value, points).select(*tag, "i", F.col("q").alias("r"))
    shared = knots_a.groupBy(*tag, F.col("q").alias("x")).agg(F.avg("p").alias("_p"))
    at = F.col("_p") * (points - 1)
    low = F.least(F.floor(at + 1e-9), F.lit(points - 1))
    high = F.least(low + 1, F.lit(points - 1))
    a = shared.withColumns({"_lo": low, "_hi": high, "_f": F.greatest(at - low, F.lit(0.0))})
    lo = knots_r.select(*tag, F.col("i").alias("_lo"), F.col("r").alias("_rl"))
    hi = knots_r.select(*tag, F.col("i").alias("_hi"), F.col("r").alias("_rh"))
    curve = a.join(lo, [*tag, "_lo"]).join(hi, [*tag, "_hi"]).select(*tag, "x", (F.col("_rl") + F.col("_f") * (F.col("_rh") - F.col("_rl"))).alias("y"))
    ends = knots_r.groupBy("_one").agg(F.min("r").alias("_r0"), F.max("r").alias("_r1"))
    span = knots_a.groupBy("_one").agg(F.min("q").alias("_a0"), F.max("q").alias("_a1"))
    rows = curve_lookup(application.withColumn("_one", F.lit(1)), curve, "_one", value, "_y", step)
    rows = rows.join(F.broadcast(ends), "_one").join(F.broadcast(span), "_one")
    mapped = F.when(F.col(value) < F.col("_a0"), F.col("_r0")).when(F.col(value) > F.col("_a1"), F.col("_r1")).otherwise(F.coalesce("_y", F.col("_r0")))
    return rows.withColumn(name, mapped).drop("_one", "_y", "_r0", "_r1", "_a0", "_a1")


def shift_hedge(train: DataFrame, application: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Divide application covariates by the root of their bounded median ratio to training."""
    both = long_form(train, [], columns).withColumn("side", F.lit("t")).unionByName(long_form(application, [], columns).withColumn("side", F.lit("a")))
    med = exact_quantiles(both.where(finite("value")), ["variable", "side"], "value", [0.5])
    wide = med.groupBy("variable").agg(F.max(F.when(F.col("side") == "t", F.element_at("q", 1))).alias("reference"), F.max(F.when(F.col("side") == "a", F.element_at("q", 1))).alias("observed"))
    ratio = clip(F.col("observed") / F.col("reference"), *HEDGE_BOUNDS)
    divisors = wide.select(F.map_from_entries(F.collect_list(F.struct("variable", F.pow(ratio, F.lit(HEDGE_STRENGTH))))).alias("m")).scalar()  # one entry per column
    return application.withColumns({c: F.col(c) / F.element_at(divisors, F.lit(c)) for c in columns})


def coverage(df: DataFrame, keys: Sequence[str], columns: Sequence[str], ts: str, expected: Column | None = None) -> DataFrame:
    """Per column: expected, present and missing rows and the first and last hour with a value."""
    rows = long_form(df, [*keys, ts], columns)
    n = F.count(F.lit(1)) if expected is None else F.first(expected)
    have = finite("value")
    return rows.groupBy(*keys, "variable").agg(
        n.alias("expected_rows"), sum_when(have).alias("non_null_rows"), F.min(F.when(have, F.col(ts))).alias("first_non_null"), F.max(F.when(have, F.col(ts))).alias("last_non_null"),
    ).withColumn("missing_rows", F.col("expected_rows") - F.col("non_null_rows")).withColumn("missing_fraction", F.col("missing_rows") / F.col("expected_rows"))


def median_fill_values(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact training medians, one number per registered column; a column without any value is an error."""
    rows = training_medians(train.withColumns({c: F.when(finite(c), F.col(c)) for c in columns}), columns).limit(len(columns) + 1).collect()
    found = {r["variable"]: r["median"] for r in rows}
    empty = [c for c in columns if found.get(c) is None]
    if empty:
        raise ValueError(f"columns without any training value: {empty}")
    return found
