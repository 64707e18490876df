"""Site and turbine dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions.exprs import sum_when
from windrow.functions.geo import parse_dms


def forward_fill(df: DataFrame, order: str, value: str, bucket: int = 100_000) -> DataFrame:
    """Carry the last known value down the row order.

    Rows are filled inside buckets of consecutive positions; what a bucket starts with comes from the last value of the
    buckets before it, a table with one row per bucket.
    """
    rows = df.withColumn("_b", F.floor(F.col(order) / bucket))
    inside = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.where(F.col(value).isNotNull()).groupBy("_b").agg(F.max_by(value, order).alias("_end"))
    every = rows.select("_b").distinct().join(ends, "_b", "left")
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    starts = every.select("_b", F.last("_end", ignorenulls=True).over(before).alias("_start"))
    filled = rows.withColumn("_in", F.last(value, ignorenulls=True).over(inside)).join(starts, "_b")
    return filled.withColumn(value, F.coalesce("_in", "_start")).drop("_b", "_in", "_start")


def turbine_rows(info: DataFrame, order: str, group: str, coordinate: str, hub: str, rotor: str, capacity: str) -> DataFrame:
    """Rows with a coordinate; the group label stands only on the first row of its block and is carried down."""
    rows = forward_fill(info, order, group).where(F.col(coordinate).isNotNull())
    lat, lon = parse_dms(coordinate)
    return rows.select(
        F.col(group).cast("bigint").alias(group), F.col(order), lat.alias("lat"), lon.alias("lon"),
        F.col(hub).try_cast("double").alias("hub_height_m"), F.col(rotor).try_cast("double").alias("rotor_diameter_m"),
        F.col(capacity).try_cast("double").alias("capacity_mw"))


def group_sites(turbines: DataFrame, group: str) -> DataFrame:
    """Centroid, mean hub and rotor, and summed capacity per group."""
    return turbines.groupBy(group).agg(
        F.count(F.lit(1)).alias("turbines"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
        F.avg("hub_height_m").alias("hub_height_m"), F.avg("rotor_diameter_m").alias("rotor_diameter_m"),
        (F.sum("capacity_mw") * 1000.0).alias("capacity_kwh"))


def turbine_checks(turbines: DataFrame, expected: DataFrame, group: str, keys: Sequence[str], required: Sequence[str],
                   tolerance: float = 1e-6) -> DataFrame:
    """(rule, n): duplicate turbines, incomplete rows, groups without turbines, groups whose capacities do not add up."""
    nulls = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in (group, *keys, *required)])
    dup = turbines.groupBy(*keys).count().agg(sum_when(F.col("count") > 1).alias("n")).select(F.lit("duplicate_turbine").alias("rule"), "n")
    gaps = turbines.agg(sum_when(nulls).alias("n")).select(F.lit("incomplete").alias("rule"), "n")
    totals = turbines.groupBy(group).agg((F.sum("capacity_mw") * 1000.0).alias("_kwh"))
    both = expected.join(totals, group, "left")
    rules = both.agg(
        sum_when(F.col("_kwh").isNotNull() & (F.abs(F.col("_kwh") - F.col("capacity_kwh")) > tolerance)).alias("capacity_mismatch"),
        sum_when(F.col("_kwh").isNull()).alias("uncovered_group"),
    ).select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in ("capacity_mismatch", "uncovered_group")])))
    return dup.unionByName(gaps).unionByName(rules)
