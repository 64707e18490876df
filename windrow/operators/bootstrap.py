"""Weekly circular block bootstrap of score deltas, from per-day additive totals."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow.functions.exprs import ColumnLike, col
from windrow.functions.timekeys import run_key
from windrow.operators.lookups import attach, bounded
from windrow.operators.settlement import eligible, error_rate, unit_price
from windrow.session import checkpoint

# fixed values
BLOCK_DAYS = 7
REPLICATES = 10_000
MAX_T_QUANTILE = 0.90
NMAE_SLACK = 0.0002


def draw(fold: ColumnLike, replicate: ColumnLike, block: ColumnLike, n: ColumnLike) -> Column:
    """Repeatable uniform start day: 32 bits of an md5 digest modulo the number of days."""
    digest = F.md5(F.concat_ws("-", col(fold).cast("string"), col(replicate).cast("string"), col(block).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % col(n)


def daily_totals(df: DataFrame, baseline: str, candidates: Sequence[str], fold: Column) -> DataFrame:
    """(fold, grp, day) totals; days without a scored row stay, with zeros, because they are part of the circle."""
    ok = eligible("actual", "capacity")
    aggs = [F.sum(ok.cast("int")).alias("n"), F.sum(F.when(ok, F.col("actual")).otherwise(0.0)).alias("energy")]
    for name in (baseline, *candidates):
        rate = error_rate(name, "actual", "capacity")
        aggs.append(F.sum(F.when(ok, rate).otherwise(0.0)).alias(f"{name}_error"))
        aggs.append(F.sum(F.when(ok, F.col("actual") * unit_price(rate)).otherwise(0.0)).alias(f"{name}_earned"))
    return df.groupBy(fold.alias("fold"), "grp", run_key("ts").alias("day")).agg(*aggs)


def block_bootstrap(daily: DataFrame, baseline: str, candidates: Sequence[str], replicates: int = REPLICATES) -> DataFrame:
    """Macro score delta of every candidate per replicate.

    Blocks of seven days start at drawn days and wrap around the fold; the last block is cut so that a replicate has as
    many days as the fold.  The sum of every possible block is formed once per start day.  While that table is small, as
    days x groups usually are, replicates are products of a start-count matrix with it; otherwise draws join it.  All groups and candidates share the draws.
    """
    spark = daily.sparkSession
    totals = ["n", "energy", *[f"{m}_{t}" for m in (baseline, *candidates) for t in ("error", "earned")]]
    daily = checkpoint(daily)  # groups x days, read three times
    # one row per calendar day and fold: the calendar is the bound of these windows
    calendar = daily.select("fold", "day").distinct().select(
        "fold", "day",
        (F.row_number().over(Window.partitionBy("fold").orderBy("day")) - 1).cast("bigint").alias("pos"),
        F.count(F.lit(1)).over(Window.partitionBy("fold")).alias("days"),
    )
    placed = attach(daily, calendar, ["fold", "day"], "inner")
    tail = F.col("days") - BLOCK_DAYS * (F.ceil(F.col("days") / BLOCK_DAYS) - 1)
    reach = placed.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(BLOCK_DAYS - 1)))).withColumn(
        "start", (F.col("pos") - F.col("offset") + BLOCK_DAYS * F.col("days")) % F.col("days")
    )
    sums = reach.groupBy("fold", "grp", "start").agg(
        *[F.sum(c).alias(f"full_{c}") for c in totals],
        *[F.sum(F.when(F.col("offset") < tail, F.col(c)).otherwise(0)).alias(f"tail_{c}") for c in totals],
    )
    folds = {r["fold"]: r["days"] for r in calendar.groupBy("fold").agg(F.first("days").alias("days")).collect()}
    table = bounded(sums)  # start days x groups: checked, as every task gets it
    if table is not None:
        return _by_counts(spark, table, folds, totals, baseline, candidates, replicates)
    ends = F.create_map(*[x for f, d in folds.items() for x in (F.lit(f), F.lit(d))])
    draws = (
        spark.range(replicates).withColumnRenamed("id", "replicate")
        .withColumn("fold", F.explode(F.map_keys(ends))).withColumn("days", F.element_at(ends, F.col("fold")))
        .withColumn("block", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("days") / BLOCK_DAYS) - 1).cast("int"))))
        .withColumn("start", draw("fold", "replicate", "block", "days"))
        .withColumn("last", F.col("block") == (F.ceil(F.col("days") / BLOCK_DAYS) - 1))
        .select("fold", "replicate", "start", "last")
    )
    per_group = draws.join(sums, ["fold", "start"]).groupBy("replicate", "grp").agg(
        *[F.sum(F.when(F.col("last"), F.col(f"tail_{c}")).otherwise(F.col(f"full_{c}"))).alias(c) for c in totals]
    )

    def score(name: str) -> Column:
        return 0.5 * (1.0 - F.col(f"{name}_error") / F.col("n")) + 0.5 * F.col(f"{name}_earned") / (4.0 * F.col("energy"))

    return per_group.groupBy("replicate").agg(
        *[F.avg(score(c) - score(baseline)).alias(f"delta_{c}") for c in candidates]
    )


def _by_counts(spark: SparkSession, table: DataFrame, folds: Mapping[int, int], totals: Sequence[str], baseline: str, candidates: Sequence[str], replicates: int) -> DataFrame:
    """Replicates from a small table of block sums: a batch's draws become a matrix of how often each start day was drawn, and one product with the
    block sums gives the totals of all its replicates.  Nothing is shuffled and no block is a row."""
    rows = table.toPandas()
    groups = sorted(rows["grp"].unique())
    blocks = {}
    for fold, days in folds.items():
        own = rows[rows["fold"] == fold]
        at = (own["start"].to_numpy(int), own["grp"].map({g: i for i, g in enumerate(groups)}).to_numpy(int))
        for part in ("full", "tail"):
            blocks[fold, part] = np.zeros((days, len(groups), len(totals)))
            blocks[fold, part][at] = own[[f"{part}_{c}" for c in totals]].to_numpy(float)
    names = [f"delta_{c}" for c in candidates]
    place = {c: i for i, c in enumerate(totals)}
    counts = {f: -(-d // BLOCK_DAYS) for f, d in folds.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = batch.num_rows, 0.0
            if not n:
                continue
            for k, (fold, days) in enumerate(folds.items()):
                drawn = batch.column(1 + k).flatten().to_numpy().reshape(n, counts[fold])
                often = np.zeros((n, days))
                np.add.at(often, (np.arange(n)[:, None], drawn[:, :-1]), 1.0)
                full, tail = blocks[fold, "full"], blocks[fold, "tail"]
                total = total + (often @ full.reshape(days, -1)).reshape(n, *full.shape[1:]) + tail[drawn[:, -1]]
            scores = {m: 0.5 * (1.0 - total[:, :, place[f"{m}_error"]] / total[:, :, 0]) + 0.5 * total[:, :, place[f"{m}_earned"]] / (4.0 * total[:, :, 1]) for m in (baseline, *candidates)}
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array((scores[c] - scores[baseline]).mean(axis=1)) for c in candidates]], names=["replicate", *names])

    def drawn_starts(fold: int) -> Column:
        every = F.sequence(F.lit(0), F.lit(counts[fold] - 1))
        return F.transform(every, lambda block: draw(F.lit(fold), F.col("replicate"), block, F.lit(folds[fold])))

    starts = [drawn_starts(f).alias(f"s{k}") for k, f in enumerate(folds)]
    return spark.range(replicates).withColumnRenamed("id", "replicate").select("replicate", *starts).mapInArrow(run, ", ".join(["replicate long", *[f"{n} double" for n in names]]))


def simultaneous_bounds(replicates: DataFrame, observed: DataFrame, candidates: Sequence[str],
                        quantile: float = MAX_T_QUANTILE) -> DataFrame:
    """Lower bounds valid for all candidates together: observed delta minus the quantile of the largest centred delta.
    ``observed`` has one row of ``delta_<candidate>``; the replicates are a fixed number of rows."""
    obs = observed.select(*[F.col(f"delta_{c}").alias(f"obs_{c}") for c in candidates])
    centred = replicates.join(F.broadcast(obs))
    largest = F.array_max(F.array(*[F.col(f"delta_{c}") - F.col(f"obs_{c}") for c in candidates]))
    critical = centred.agg(F.percentile(largest, F.lit(quantile)).alias("critical"))
    wide = critical.join(F.broadcast(obs))
    return wide.select(
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("candidate"), F.col(f"obs_{c}").alias("raw_delta"),
                     (F.col(f"obs_{c}") - F.col("critical")).alias("simultaneous_lcb")) for c in candidates
        ])).alias("r")
    ).select("r.*")


def risk_adjusted(df: DataFrame) -> DataFrame:
    """Penalised score from columns baseline_score, raw_delta, simultaneous_lcb, minimum_cell_delta, delta_ficr and
    delta_one_minus_nmae."""
    zero = F.lit(0.0)
    penalty = (
        F.greatest(zero, -F.col("minimum_cell_delta"))
        + 0.5 * F.greatest(zero, -F.col("delta_ficr"))
        + 0.5 * F.greatest(zero, -(F.col("delta_one_minus_nmae") + NMAE_SLACK))
    )
    return (
        df.withColumn("instability_penalty", penalty)
        .withColumn("risk_adjusted_increment", F.col("simultaneous_lcb") - F.col("instability_penalty"))
        .withColumn("local_virtual_score", F.col("baseline_score") + F.col("risk_adjusted_increment"))
    )
