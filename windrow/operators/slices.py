"""Period slices, wind regimes and candidate-versus-baseline comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.exprs import ColumnLike, col, finite
from windrow.functions.timekeys import run_key
from windrow.operators.settlement import eligible, eligible_rows, error_rate, require, unit_price

# fixed values: wind regimes in m/s
REGIME_LOW = 4.0
REGIME_HIGH = 8.0

VARIANTS = ("baseline", "candidate")


def regime(speed: ColumnLike) -> Column:
    return F.when(col(speed) < REGIME_LOW, "low").when(col(speed) < REGIME_HIGH, "mid").when(col(speed) >= REGIME_HIGH, "high")


def quarter_number(ts: ColumnLike) -> Column:
    """Quarter of the operating day, so that 00:00 closes the previous day's quarter."""
    return F.quarter(run_key(ts))


def year_slices(quarter: ColumnLike) -> Column:
    """full, its half and its quarter, as an array of names."""
    q = col(quarter)
    return F.array(
        F.lit("full"), F.when(q <= 2, "H1").otherwise("H2"), F.concat(F.lit("Q"), q.cast("string"))
    )


def paired_totals(df: DataFrame, keys: Sequence[str | Column], baseline: str, candidate: str) -> DataFrame:
    """Additive metric parts of both variants in one pass: columns ``<variant>_error`` and ``<variant>_earned``."""
    rows = eligible_rows(df, baseline).withColumnRenamed("rate", "rate_b")
    rows = eligible_rows(rows, candidate).withColumnRenamed("rate", "rate_c")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("actual").alias("energy"),
        F.sum("rate_b").alias("baseline_error"),
        F.sum(F.col("actual") * unit_price("rate_b")).alias("baseline_earned"),
        F.sum("rate_c").alias("candidate_error"),
        F.sum(F.col("actual") * unit_price("rate_c")).alias("candidate_earned"),
    )


PAIRED = ("n", "energy", "baseline_error", "baseline_earned", "candidate_error", "candidate_earned")


def add_totals(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Roll additive parts up to coarser keys."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in PAIRED])


def paired_scores(totals: DataFrame) -> DataFrame:
    """Score, 1 - NMAE and settlement share of both variants from additive parts."""
    out = totals
    for v in VARIANTS:
        out = out.withColumn(f"{v}_one_minus_nmae", 1.0 - F.col(f"{v}_error") / F.col("n"))
        out = out.withColumn(f"{v}_ficr", F.col(f"{v}_earned") / (4.0 * F.col("energy")))
        out = out.withColumn(f"{v}_score", 0.5 * F.col(f"{v}_one_minus_nmae") + 0.5 * F.col(f"{v}_ficr"))
    return out


METRICS = ("score", "one_minus_nmae", "ficr")


def deltas(scores: DataFrame) -> DataFrame:
    for m in METRICS:
        scores = scores.withColumn(f"delta_{m}", F.col(f"candidate_{m}") - F.col(f"baseline_{m}"))
    return scores


def macro_of_groups(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equal-weight mean over groups of every variant's metrics."""
    return scores.groupBy(*keys).agg(
        F.sum("n").alias("n"), *[F.avg(f"{v}_{m}").alias(f"{v}_{m}") for v in VARIANTS for m in METRICS]
    )


def compare_year_slices(df: DataFrame, baseline: str, candidate: str, group: str = "grp", ts: str = "ts", by_year: bool = True) -> DataFrame:
    """Per slice and group, for every year or over all years: both variants and the deltas.  Rows are reduced to quarter
    totals before the slices are expanded, so overlapping slices never multiply the input."""
    year = [F.year(run_key(ts)).alias("year")] if by_year else []
    quarters = paired_totals(df, [group, *year, quarter_number(ts).alias("quarter")], baseline, candidate)
    sliced = quarters.withColumn("slice", F.explode(year_slices("quarter")))
    return deltas(paired_scores(add_totals(sliced, [group, *(["year"] if by_year else []), "slice"])))


def compare_segments(
    df: DataFrame, baseline: str, candidate: str, segments: Mapping[str, tuple[str, str]], group: str = "grp", ts: str = "ts"
) -> DataFrame:
    """As above on named closed intervals that may overlap.  Daily totals are formed first; only those are expanded."""
    daily = paired_totals(df, [group, ts], baseline, candidate)
    names = F.array(*[
        F.when(F.col(ts).between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz")), F.lit(name))
        for name, (a, b) in segments.items()
    ])
    expanded = daily.withColumn("segment", F.explode(F.array_compact(names)))
    return deltas(paired_scores(add_totals(expanded, [group, "segment"])))


def compare_time_and_regime(df: DataFrame, baseline: str, candidate: str, driver: Column) -> DataFrame:
    """Time slices and wind regimes per group, plus the equal-weight ``mixed`` rows.

    ``driver`` is an aggregate over the rows of one (group, ts).  The regime of the mixed rows comes from the mean driver
    over groups, that of the group rows from the group's own driver.  Drivers are rounded so that the order of addition
    cannot move one across a regime edge.
    """
    ok = eligible("actual", "capacity")

    def rate(forecast: str) -> Column:
        known = require(finite(forecast), "non-finite forecast on a scored row", error_rate(forecast, "actual", "capacity"))
        return F.when(ok, known)

    rows = df.withColumns({"rate_b": rate(baseline), "rate_c": rate(candidate), "_y": F.when(ok, F.col("actual"))})
    # the driver covers all rows of a cell, the totals the scored ones; one pass forms both
    cells = rows.groupBy("grp", "ts").agg(
        F.round(driver, 9).alias("driver"), F.count("_y").alias("n"), F.sum("_y").alias("energy"),
        F.sum("rate_b").alias("baseline_error"), F.sum(F.col("_y") * unit_price("rate_b")).alias("baseline_earned"),
        F.sum("rate_c").alias("candidate_error"), F.sum(F.col("_y") * unit_price("rate_c")).alias("candidate_earned"),
    ).where(F.col("n") > 0)
    mixed_driver = cells.groupBy("ts").agg(F.round(F.avg("driver"), 9).alias("mixed_driver"))
    cells = cells.join(mixed_driver, "ts")
    labels = F.array(
        *[F.struct(F.lit("time").alias("family"), s.alias("slice"), F.lit(True).alias("own"), F.lit(True).alias("mixed"))
          for s in (F.lit("full"), F.when(quarter_number("ts") <= 2, "H1").otherwise("H2"),
                    F.concat(F.lit("Q"), quarter_number("ts").cast("string")))],
        F.struct(F.lit("regime").alias("family"), regime("driver").alias("slice"), F.lit(True).alias("own"),
                 F.lit(False).alias("mixed")),
        F.struct(F.lit("regime").alias("family"), regime("mixed_driver").alias("slice"), F.lit(False).alias("own"),
                 F.lit(True).alias("mixed")),
    )
    expanded = cells.select("grp", *PAIRED, F.explode(labels).alias("l")).select(
        "grp", *PAIRED, "l.family", "l.slice", "l.own", "l.mixed"
    )
    parts = paired_scores(add_totals(expanded, ["grp", "family", "slice", "own", "mixed"]))
    keep = ["n", *[f"{v}_{m}" for v in VARIANTS for m in METRICS]]
    own = parts.where("own").select("grp", "family", "slice", *keep)
    mixed = macro_of_groups(parts.where("mixed"), ["family", "slice"]).select(
        F.lit("mixed").alias("grp"), "family", "slice", *keep
    )
    return deltas(own.unionByName(mixed))
