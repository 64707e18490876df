"""Row utilities, score-aware targets, smooth losses and row-wise best candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.exprs import ColumnLike, clip, col
from windrow.operators.lookups import attach
from windrow.operators.settlement import eligible, eligible_rows, error_rate, unit_price

# fixed values of the smooth settlement loss
SMOOTH_THRESHOLDS = (0.06, 0.08)
SMOOTH_WEIGHTS = (1.0, 3.0)
SMOOTH_MAE = 0.5
SMOOTH_TEMPERATURE = 0.005
SMOOTH_EPSILON = 0.0025
SMOOTH_CURVATURE = (0.001, 200.0)
SMOOTH_SIGMOID_CLIP = 40.0

UPPER_FRACTION = 1.02
FIXED_ACTION_FACTORS = (0.98, 0.95)


def with_mean_actual(df: DataFrame, keys: Sequence[str] = ("grp",)) -> DataFrame:
    """Add ``n_group`` and ``mean_actual`` over each group's scored rows (partial aggregation, then a checked lookup)."""
    means = df.where(eligible("actual", "capacity")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_group"), F.avg("actual").alias("mean_actual")
    )
    return attach(df, means, keys)


def row_utility(forecast: ColumnLike, actual: ColumnLike = "actual", capacity: ColumnLike = "capacity",
                mean_actual: ColumnLike = "mean_actual") -> Column:
    """Utility whose mean over a group's scored rows is the group score; null on rows that are not scored."""
    rate = error_rate(forecast, actual, capacity)
    value = 0.5 * (1.0 - rate) + 0.5 * (col(actual) / col(mean_actual)) * (unit_price(rate) / 4.0)
    return F.when(eligible(actual, capacity), value)


def action_utility_deltas(df: DataFrame, baseline: str = "base", factors: Sequence[float] = FIXED_ACTION_FACTORS) -> DataFrame:
    """Scored rows x fixed scale actions with the exact change in row utility against the clipped baseline."""
    rows = with_mean_actual(df).where(eligible("actual", "capacity"))
    y, cap = F.col("actual") / F.col("capacity"), F.col("capacity")
    rows = rows.withColumn("y", y).withColumn("b", clip(F.col(baseline) / cap, 0.0, UPPER_FRACTION))
    rows = rows.withColumn("factor", F.explode(F.array(*[F.lit(f) for f in factors])))
    a = clip(F.col("factor") * F.col("b"), 0.0, UPPER_FRACTION)
    mean_cf = F.col("mean_actual") / cap
    rows = rows.withColumn("e0", F.abs(F.col("b") - F.col("y"))).withColumn("e1", F.abs(a - F.col("y")))
    gain = 0.5 * (F.col("e0") - F.col("e1")) + 0.5 * (F.col("y") / mean_cf) * (
        unit_price("e1") - unit_price("e0")
    ) / 4.0
    return rows.withColumn("utility_delta", gain).drop("y", "b", "e0", "e1", "n_group", "mean_actual")


def score_aware_targets(df: DataFrame, baseline: str = "base", step: float = 0.01) -> DataFrame:
    """Ten targets around a fixed baseline; all but ``eligible`` are null on rows that are not scored."""
    rows = with_mean_actual(df)
    cap, ok = F.col("capacity"), eligible("actual", "capacity")
    residual = (F.col("actual") - F.col(baseline)) / cap
    rate = F.abs(residual)
    plus, minus = F.col(baseline) + step * cap, F.col(baseline) - step * cap
    u0, up, um = row_utility(baseline), row_utility(plus), row_utility(minus)
    targets = {
        "actual_cf": F.col("actual") / cap,
        "signed_residual_cf": residual,
        "absolute_error_cf": rate,
        "within_6": (rate <= 0.06).cast("double"),
        "within_8": (rate <= 0.08).cast("double"),
        "margin_6": 0.06 - rate,
        "margin_8": 0.08 - rate,
        "plus_vs_minus_utility": up - um,
        "best_one_percent_utility_gain": F.greatest(up, um) - u0,
    }
    out = rows.withColumn("eligible", ok.cast("double"))
    return out.select("*", *[F.when(ok, c).alias(n) for n, c in targets.items()]).drop("n_group", "mean_actual")


def smooth_settlement_loss(prediction: ColumnLike, actual: ColumnLike, mean_actual: ColumnLike) -> tuple[Column, Column, Column]:
    """Differentiable settlement loss: value, exact slope, and bounded positive curvature (inputs in capacity factors)."""
    error = col(prediction) - col(actual)
    radius = F.sqrt(error * error + SMOOTH_EPSILON ** 2)
    scale = col(actual) / (8.0 * col(mean_actual))
    value, slope, bend = SMOOTH_MAE * radius, F.lit(SMOOTH_MAE), F.lit(0.0)
    for edge, weight in zip(SMOOTH_THRESHOLDS, SMOOTH_WEIGHTS):
        z = clip((edge - radius) / SMOOTH_TEMPERATURE, -SMOOTH_SIGMOID_CLIP, SMOOTH_SIGMOID_CLIP)
        p = 1.0 / (1.0 + F.exp(-z))
        hump = p * (1.0 - p)
        value = value - scale * weight * p
        slope = slope + scale * weight * hump / SMOOTH_TEMPERATURE
        bend = bend - scale * weight * hump * (1.0 - 2.0 * p) / SMOOTH_TEMPERATURE ** 2
    direction = error / radius
    second = slope * SMOOTH_EPSILON ** 2 / (radius * radius * radius) + bend * direction * direction
    return value, slope * direction, clip(F.abs(second), *SMOOTH_CURVATURE)


def pseudo_huber(residual: ColumnLike, delta: float = 0.04) -> Column:
    scaled = col(residual) / delta
    return delta * delta * (F.sqrt(1.0 + scaled * scaled) - 1.0)


def rowwise_best(df: DataFrame, candidates: Sequence[str], baseline: str) -> DataFrame:
    """Label oracle: per scored row the candidate with the largest exact score contribution, first in order on ties;
    rows that are not scored keep the baseline.  Candidates sit side by side in one row, so no shuffle is needed."""
    rows = with_mean_actual(df)
    ok = eligible("actual", "capacity")
    share = 1.0 / F.col("n_group")

    def contribution(name: str) -> Column:
        rate = error_rate(name, "actual", "capacity")
        return -0.5 * rate * share + 0.5 * F.col("actual") * unit_price(rate) / (4.0 * F.col("n_group") * F.col("mean_actual"))

    options = F.array(*[
        F.struct(contribution(c).alias("gain"), F.lit(-i).alias("order"), F.lit(c).alias("name"), F.col(c).alias("kwh"))
        for i, c in enumerate(candidates)
    ])
    best = F.array_max(options)
    return rows.select(
        "*",
        F.when(ok, best["name"]).otherwise(F.lit(baseline)).alias("selected"),
        F.when(ok, best["kwh"]).otherwise(F.col(baseline)).alias("oracle"),
    ).drop("n_group", "mean_actual")


def scored(df: DataFrame, forecast: str) -> DataFrame:
    return eligible_rows(df, forecast)
