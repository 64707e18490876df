"""Threshold settlement metric and everything derived from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.exprs import ColumnLike, col, finite, sum_when

# fixed values of the settlement rule
MIN_ACTUAL_FRACTION = 0.10
FULL_PAYMENT_ERROR = 0.06
PARTIAL_PAYMENT_ERROR = 0.08
FULL_PRICE = 4.0
PARTIAL_PRICE = 3.0
GROUP_CAPACITY_KWH = {"g1": 21_600.0, "g2": 21_600.0, "g3": 21_000.0}


def error_rate(forecast: ColumnLike, actual: ColumnLike, capacity: ColumnLike) -> Column:
    return F.abs(col(forecast) - col(actual)) / col(capacity)


def unit_price(rate: ColumnLike) -> Column:
    """4 up to 6 %, 3 up to 8 %, else 0; both edges inclusive."""
    return (
        F.when(col(rate) <= FULL_PAYMENT_ERROR, FULL_PRICE).when(col(rate) <= PARTIAL_PAYMENT_ERROR, PARTIAL_PRICE)
        .otherwise(0.0)
    )


def eligible(actual: ColumnLike, capacity: ColumnLike) -> Column:
    return finite(actual) & (col(actual) >= col(capacity) * MIN_ACTUAL_FRACTION)


def error_band(rate: ColumnLike) -> Column:
    return (
        F.when(col(rate) <= FULL_PAYMENT_ERROR, "within_6").when(col(rate) <= PARTIAL_PAYMENT_ERROR, "within_8")
        .otherwise("over_8")
    )


def require(condition: Column, message: str, value: Column) -> Column:
    """``value`` where the condition holds; the job fails with ``message`` where it does not."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def eligible_rows(
    df: DataFrame, forecast: str, actual: str = "actual", capacity: str = "capacity", *, checked: bool = True
) -> DataFrame:
    """Scored rows with ``rate``; a missing forecast on a scored row is an error, not a dropped row."""
    rate = error_rate(forecast, actual, capacity)
    if checked:
        rate = require(finite(forecast), "non-finite forecast on a scored row", rate)
    return df.where(eligible(actual, capacity)).withColumn("rate", rate)


#: additive totals from which every metric follows
TOTALS = ("n", "energy", "error", "earned")


def metric_totals(weighted_by: str = "actual") -> list[Column]:
    """Additive parts: safe to aggregate partially, to add over days, slices or bootstrap blocks."""
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(weighted_by).alias("energy"),
        F.sum("rate").alias("error"),
        F.sum(F.col(weighted_by) * unit_price("rate")).alias("earned"),
    ]


def metric_ratios() -> list[Column]:
    nmae = F.col("error") / F.col("n")
    return [
        nmae.alias("nmae"),
        (1.0 - nmae).alias("one_minus_nmae"),
        (F.col("earned") / (F.col("energy") * FULL_PRICE)).alias("ficr"),
    ]


def group_metrics(df: DataFrame, keys: Sequence[str], forecast: str, actual: str = "actual",
                  capacity: str = "capacity") -> DataFrame:
    """Eligible count, energy, NMAE, energy-weighted settlement share and the three error bands per group."""
    rows = eligible_rows(df, forecast, actual, capacity)
    energy = F.col(actual)
    bands = {name: error_band("rate") == name for name in ("within_6", "within_8", "over_8")}
    out = rows.groupBy(*keys).agg(
        *metric_totals(actual),
        *[sum_when(cond).alias(f"{name}_count") for name, cond in bands.items()],
        *[sum_when(cond, energy).alias(f"{name}_energy") for name, cond in bands.items()],
    )
    return out.select(
        *keys, F.col("n").alias("n_evaluated"), F.col("energy").alias("actual_energy"), *metric_ratios(),
        F.col("earned").alias("earned_settlement"), (F.col("energy") * FULL_PRICE).alias("max_settlement"),
        *[F.col(f"{name}_count") for name in bands],
        *[(F.col(f"{name}_energy") / F.col("energy")).alias(f"{name}_energy_share") for name in bands],
    )


def macro_score(group_scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean over groups: total = half (1 - NMAE) plus half settlement share."""
    macro = group_scores.groupBy(*keys).agg(
        (1.0 - F.avg("nmae")).alias("one_minus_nmae"), F.avg("ficr").alias("ficr")
    )
    return macro.withColumn("total_score", 0.5 * F.col("one_minus_nmae") + 0.5 * F.col("ficr"))


def boundary_energy_census(df: DataFrame, keys: Sequence[str], forecast: str) -> DataFrame:
    """Count, energy and energy share per error band; the share uses totals joined back, not a window over rows."""
    rows = eligible_rows(df, forecast).withColumn("band", error_band("rate"))
    bands = rows.groupBy(*keys, "band").agg(F.count(F.lit(1)).alias("n"), F.sum("actual").alias("energy"))
    totals = bands.groupBy(*keys).agg(F.sum("energy").alias("all_energy"))
    joined = bands.join(totals, list(keys)) if keys else bands.withColumn("all_energy", totals.select("all_energy").scalar())
    return joined.select(*keys, "band", "n", "energy", (F.col("energy") / F.col("all_energy")).alias("energy_share"))


#: distributed sums add in varying order, so the two formulations may differ in the last bits
PARITY_TOLERANCE = 1e-12


def parity_report(df: DataFrame, forecast: str, group: str = "grp") -> DataFrame:
    """Score the same rows by a second, independent formulation and compare the three macro numbers."""
    first = macro_score(group_metrics(df, [group], forecast))
    gap = F.abs(F.col(forecast) - F.col("actual")) / F.col("capacity")
    kept = df.where(finite("actual") & finite(forecast) & (F.col("actual") >= F.col("capacity") * MIN_ACTUAL_FRACTION))
    weight = F.when(gap > PARTIAL_PAYMENT_ERROR, 0.0).when(gap > FULL_PAYMENT_ERROR, 0.75).otherwise(1.0)
    per_group = kept.groupBy(group).agg(
        (1.0 - F.avg(gap)).alias("om"), (F.sum(F.col("actual") * weight) / F.sum("actual")).alias("fi")
    )
    second = per_group.agg(F.avg("om").alias("om"), F.avg("fi").alias("fi"))
    both = first.join(F.broadcast(second))  # one row each
    pairs = [("total_score", 0.5 * (F.col("om") + F.col("fi"))), ("one_minus_nmae", F.col("om")), ("ficr", F.col("fi"))]
    rows = F.array(*[
        F.struct(F.lit(n).alias("metric"), c.alias("independent"), F.col(n).alias("official"),
                 (F.abs(c - F.col(n)) <= PARITY_TOLERANCE).alias("within_tolerance")) for n, c in pairs
    ])
    return both.select(F.explode(rows).alias("r")).select("r.*")
