"""Running totals, ranks and exact quantiles that never put a whole group into one task.

A window partitioned by group alone sorts every row of the group in a single task, and the built-in exact
``percentile`` keeps every distinct value of a group in one hash map.  Here the distinct values are counted first
(partial aggregation takes out the duplicates), range partitioned by (keys, value) so that a hot group is spread over
many partitions, and written to the checkpoint folder together with the number of their partition.  The running total
is the total of the earlier partitions (a small table) plus the running total inside the partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.session import checkpoint

_PART = "__part"

# fixed values: coefficients of algorithm AS 241, PPND16
AS241 = {
    "a": (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
          4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    "b": (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4,
          3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
    "c": (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
          1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    "d": (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1,
          1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
    "e": (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
          2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    "f": (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4,
          1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
}


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: dict[str, Column], *, descending: bool = False
) -> DataFrame:
    """Add ``<name>`` (total of the row's group up to and including its order value), ``<name>_all`` and
    ``<name>_here`` for every entry of ``totals``; one output row per (keys, order)."""
    keys, order = list(keys), list(order)
    compact = df.groupBy(*keys, *order).agg(*[expr.alias(f"{name}_here") for name, expr in totals.items()])
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    placed = checkpoint(
        compact.repartitionByRange(*[F.col(k) for k in keys], *[way(c) for c in order])
        .withColumn(_PART, F.spark_partition_id())
    )
    # one row per (group, partition): at most the number of shuffle partitions rows per group
    per_part = placed.groupBy(*keys, _PART).agg(*[F.sum(f"{n}_here").alias(f"{n}_part") for n in totals])
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = per_part.select(
        *keys,
        _PART,
        *[F.coalesce(F.sum(f"{n}_part").over(earlier), F.lit(0)).alias(f"{n}_before") for n in totals],
        *[F.sum(f"{n}_part").over(whole).alias(f"{n}_all") for n in totals],
    )
    inside = (
        Window.partitionBy(*keys, _PART)
        .orderBy(*[way(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = placed.join(offsets, [*keys, _PART])
    return joined.select(
        *keys,
        *order,
        *[(F.col(f"{n}_before") + F.sum(f"{n}_here").over(inside)).alias(n) for n in totals],
        *[F.col(f"{n}_all") for n in totals],
        *[F.col(f"{n}_here") for n in totals],
    )


def value_positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group with ``first``/``last`` zero-based sorted positions and the group size ``n_all``."""
    ranked = running_totals(df.where(F.col(value).isNotNull()), keys, [value], {"n": F.count(F.lit(1))})
    return ranked.select(
        *keys, value, "n_all", F.col("n_here").alias("ties"),
        (F.col("n") - F.col("n_here")).alias("first"), (F.col("n") - 1).alias("last"),
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, rank: str) -> DataFrame:
    """(keys, value) -> average rank, one-based, ties sharing the mean of their ranks."""
    return value_positions(df, keys, value).select(
        *keys, value, ((F.col("first") + F.col("last")) / 2.0 + 1.0).alias(rank), "n_all", "ties"
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], name: str = "q") -> DataFrame:
    """One row per group with an array ``name`` of linearly interpolated quantiles and ``n``."""
    pos = value_positions(df, keys, value)
    aggs: list[Column] = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("n_all") - 1)
        for tag, target in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("first") <= target) & (target <= F.col("last"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"__{tag}{i}"))
    picked = pos.groupBy(*keys).agg(F.max("n_all").alias("n"), *aggs)
    out = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        out.append(lo + (hi - lo) * (at - F.floor(at)))
    return picked.select(*keys, "n", F.array(*out).alias(name))


def quantile_grid(df: DataFrame, keys: Sequence[str], value: str, count: int) -> DataFrame:
    """(keys, i, p, q, n) for ``count`` equally spaced probabilities from 0 to 1.

    Which grid points a distinct value decides follows from its positions by arithmetic, so a value unfolds only into the
    points it hits and wide grids cost no more than narrow ones.
    """
    pos = value_positions(df, keys, value)
    top, last = F.col("n_all") - 1, count - 1
    span = F.greatest(top, F.lit(1)).cast("double")
    # a point between two positions needs both of them, so a value also serves the points up to one position outside it
    low = F.greatest(F.floor((F.col("first") - 1) * float(last) / span), F.lit(0))
    high = F.least(F.ceil((F.col("last") + 1) * float(last) / span), F.lit(last))
    rows = pos.withColumn("i", F.explode(F.when(top > 0, F.sequence(low, high)).otherwise(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint")))))
    at = (F.col("i") / float(last)) * top
    hits = {t: (F.col("first") <= w) & (w <= F.col("last")) for t, w in (("lo", F.floor(at)), ("hi", F.ceil(at)))}
    picked = rows.where(hits["lo"] | hits["hi"]).groupBy(*keys, "i").agg(
        F.max("n_all").alias("n"), *[F.max(F.when(h, F.col(value))).alias(t) for t, h in hits.items()])
    place = (F.col("i") / float(last)) * (F.col("n") - 1)
    return picked.select(*keys, "i", (F.col("i") / float(last)).alias("p"),
                         (F.col("lo") + (F.col("hi") - F.col("lo")) * (place - F.floor(place))).alias("q"), "n")


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution (Wichura's algorithm AS 241, about 16 digits)."""
    def ratio(x: Column, a: Sequence[float], b: Sequence[float]) -> Column:
        def poly(coefficients: Sequence[float]) -> Column:
            out = F.lit(coefficients[-1])
            for c in reversed(coefficients[:-1]):
                out = out * x + F.lit(c)
            return out

        return poly(a) / poly(b)

    q = p - 0.5
    tail = F.sqrt(-F.log(F.least(p, 1.0 - p)))
    middle = q * ratio(0.180625 - q * q, AS241["a"], AS241["b"])
    outer = F.when(tail <= 5.0, ratio(tail - 1.6, AS241["c"], AS241["d"])).otherwise(ratio(tail - 5.0, AS241["e"], AS241["f"]))
    return F.when(F.abs(q) <= 0.425, middle).otherwise(F.when(q < 0, -outer).otherwise(outer))
