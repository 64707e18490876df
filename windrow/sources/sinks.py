"""Sinks, read-back verification and the experiment log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.operators.checks import differing_rows, prediction_contract

# fixed values
EXPERIMENT_STATUS = ("planned", "running", "completed", "failed")
EXPERIMENT_SCHEMA = (
    "schema_version int, experiment_id string, created_utc timestamp_ltz, status string, validation map<string,string>, model map<string,string>, "
    "dev_metrics map<string,double>, leaderboard_metrics map<string,double>, artifacts map<string,string>, notes string"
)


def write_feature_cache(df: DataFrame, path: str, split: str = "split", group: str = "grp", ts: str = "ts") -> None:
    """One Parquet folder per split and group.

    Rows are range partitioned by (split, group, time): a folder is not written as many small files, and a large one is cut by
    time over as many tasks as its share of the rows asks for.
    """
    df.repartitionByRange(split, group, ts).sortWithinPartitions(split, group, ts).write.mode("errorifexists").partitionBy(split, group).option("compression", "zstd").parquet(path)


def cache_summary(df: DataFrame, split: str = "split", group: str = "grp", ts: str = "ts") -> DataFrame:
    features = [c for c in df.columns if c not in (split, group, ts)]
    return df.groupBy(split, group).agg(F.count(F.lit(1)).alias("rows"), F.lit(len(features)).alias("features"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str, order: str) -> None:
    """CSV parts that read in template order: range partitioned by the id, sorted inside, one header per part."""
    df.repartitionByRange(order).sortWithinPartitions(order).write.mode("errorifexists").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def verify_written(spark: SparkSession, path: str, expected: DataFrame, fmt: str = "parquet") -> DataFrame:
    """Rows that differ between a written result and what was meant to be written; empty when the write is good."""
    reader = spark.read.schema(expected.schema)
    got = reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path) if fmt == "json" else spark.read.parquet(path)
    return differing_rows(expected, got.select(*expected.columns))


def output_contract(spark: SparkSession, path: str, template: DataFrame, columns: Sequence[str], values: Sequence[str], row_id: str = "forecast_id") -> DataFrame:
    """Check a written CSV against its template: columns, row count, unique ids, finite and non-negative values, same keys."""
    header = spark.read.option("header", True).csv(path).columns
    if list(header) != list(columns):
        raise ValueError(f"unexpected columns {header}")
    kinds = ", ".join(f"`{c}` {'double' if c in values else 'string'}" for c in columns)
    rows = spark.read.schema(kinds).option("header", True).csv(path)
    checks = prediction_contract(rows, [row_id], values)
    keys = [c for c in columns if c not in values]
    other = differing_rows(template.select(*[F.col(k).cast("string").alias(k) for k in keys]), rows.select(*keys)).agg(F.count(F.lit(1)).alias("key_differences"))
    size = template.agg(F.count(F.lit(1)).alias("expected_rows"))
    out = checks.join(F.broadcast(other)).join(F.broadcast(size))
    bad = F.col("duplicate_keys") + F.col("null_keys") + F.col("non_finite") + F.col("negative") + F.col("key_differences")
    return out.withColumn("valid", (bad == 0) & (F.col("rows") == F.col("expected_rows")))


def append_experiments(records: DataFrame, path: str) -> None:
    """Append validated records, one JSON object per line; development and leaderboard metrics stay in separate fields."""
    ok = F.col("status").isin(*EXPERIMENT_STATUS) & (F.trim("experiment_id") != "")
    checked = records.withColumn("status", F.when(ok, F.col("status")).otherwise(F.raise_error(F.lit("invalid experiment record"))))
    checked.write.mode("append").json(path)


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXPERIMENT_SCHEMA).json(path)
