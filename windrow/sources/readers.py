"""Scans: weather, labels, templates, telemetry, feature tables and label tables with a time bound."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.functions.exprs import nan_to_null
from windrow.operators.checks import reject_forbidden

# fixed values: columns of the two gridded sources, in file order
WEATHER_KEYS = ("forecast_ts", "issued_ts", "grid_id", "latitude", "longitude")
REGIONAL_VARIABLES = (
    "heightAboveGround_10_10u", "heightAboveGround_10_10v", "heightAboveGround_50_50MUmax", "heightAboveGround_50_50MUmin",
    "heightAboveGround_50_50MVmax", "heightAboveGround_50_50MVmin", "heightAboveGround_5_XBLWS", "heightAboveGround_5_YBLWS",
    "heightAboveGround_2_t", "heightAboveGround_2_dpt", "heightAboveGround_2_r", "heightAboveGround_2_q", "surface_0_sp", "meanSea_0_prmsl",
    "etc_0_blh", "surface_0_NDNSW", "surface_0_NDNLW", "heightAboveGround_2_SWDIR", "heightAboveGround_2_SWDIF", "etc_0_hcc", "etc_0_mcc",
    "etc_0_lcc", "etc_0_VLCDC", "surface_0_avg_lsprate", "surface_0_lssrate", "surface_0_ncpcp", "surface_0_snol", "surface_0_SNOM",
    "surface_0_lsm", "surface_0_h",
)
GLOBAL_VARIABLES = (
    "heightAboveGround_10_10u", "heightAboveGround_10_10v", "heightAboveGround_80_u", "heightAboveGround_80_v", "heightAboveGround_100_100u",
    "heightAboveGround_100_100v", "heightAboveGround_2_2t", "heightAboveGround_2_2d", "heightAboveGround_2_2r", "heightAboveGround_2_2sh",
    "planetaryBoundaryLayer_0_u", "planetaryBoundaryLayer_0_v", "planetaryBoundaryLayer_0_VRATE", "surface_0_dswrf", "surface_0_dlwrf",
    "surface_0_prate", "surface_0_tp", "surface_0_sp", "meanSea_0_prmsl", "surface_0_gust", "lowCloudLayer_0_lcc", "middleCloudLayer_0_mcc",
    "highCloudLayer_0_hcc", "atmosphere_0_tcc", "isobaricInhPa_850_t", "isobaricInhPa_850_u", "isobaricInhPa_850_v", "isobaricInhPa_850_r",
    "isobaricInhPa_700_t", "isobaricInhPa_700_u", "isobaricInhPa_700_v", "isobaricInhPa_500_gh", "isobaricInhPa_500_t", "isobaricInhPa_500_u",
    "isobaricInhPa_500_v",
)
WEATHER_VARIABLES = {"regional": REGIONAL_VARIABLES, "global": GLOBAL_VARIABLES}


def weather_schema(variables: Sequence[str]) -> T.StructType:
    kinds = {"forecast_ts": T.TimestampNTZType(), "issued_ts": T.TimestampNTZType(), "grid_id": T.ShortType(), "latitude": T.FloatType(), "longitude": T.FloatType()}
    return T.StructType([*[T.StructField(k, kinds[k]) for k in WEATHER_KEYS], *[T.StructField(v, T.FloatType()) for v in variables]])


def clean_header(name: str) -> str:
    """Drop a byte order mark and quotes."""
    return name.lstrip("﻿").strip().strip('"')


def read_csv(spark: SparkSession, path: str, schema: T.StructType, rename: Mapping[str, str] | None = None) -> DataFrame:
    """Registered columns of a CSV with header, whatever their position or a byte order mark before the first name.

    The header decides the position of each column, the schema its type; only registered columns are parsed.
    """
    first = spark.read.text(path).limit(1).first()
    if first is None:
        raise ValueError(f"{path} is empty")
    names = [clean_header(n) for n in first[0].split(",")]
    alias = {v: k for k, v in (rename or {}).items()}
    missing = [f.name for f in schema.fields if alias.get(f.name, f.name) not in names]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    kinds = {alias.get(f.name, f.name): f.dataType for f in schema.fields}
    whole = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
    frame = spark.read.schema(whole).option("header", True).option("enforceSchema", True).csv(path)
    return frame.select(*[F.col(f"`{alias.get(f.name, f.name)}`").alias(f.name) for f in schema.fields])


def read_weather(spark: SparkSession, path: str, source: str, rename: Mapping[str, str] | None = None) -> DataFrame:
    """Gridded weather; target-like columns are refused by name and not-a-number becomes null."""
    variables = WEATHER_VARIABLES[source]
    frame = reject_forbidden(read_csv(spark, path, weather_schema(variables), rename))
    return frame.withColumns({v: nan_to_null(v) for v in variables})


def unpivot_groups(wide: DataFrame, keys: Sequence[str], groups: Sequence[str], value: str = "kwh", name: str = "grp") -> DataFrame:
    return wide.unpivot(list(keys), list(groups), name, value)


def label_checks(wide: DataFrame, ts: str, groups: Sequence[str]) -> DataFrame:
    """Rows, repeated hours, negative and infinite labels of a wide label table."""
    per = wide.groupBy(ts).agg(
        F.count(F.lit(1)).alias("n"), *[F.min(g).alias(g) for g in groups],
        *[F.max((F.isnan(g) | (F.abs(g) == float("inf"))).cast("int")).alias(f"_bad_{g}") for g in groups])
    bad = sum((F.coalesce(F.col(f"_bad_{g}"), F.lit(0)) for g in groups[1:]), F.coalesce(F.col(f"_bad_{groups[0]}"), F.lit(0)))
    low = F.least(*[F.coalesce(F.col(g), F.lit(0.0)) for g in groups])
    return per.agg(F.sum("n").alias("rows"), F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_hours"), F.count(F.when(low < 0, 1)).alias("negative_hours"),
                   F.sum(bad).alias("non_finite"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def template_follows(labels: DataFrame, template: DataFrame, ts: str = "ts", row_id: str = "forecast_id") -> DataFrame:
    """The output template must start after the labels end and hold unique ids and hours."""
    a = labels.agg(F.max(ts).alias("label_end"))
    ids = template.groupBy(row_id).count().agg(F.count(F.when(F.col("count") > 1, 1)).alias("duplicate_ids"))
    b = template.agg(F.min(ts).alias("template_start"), F.count(F.lit(1)).alias("template_rows"))
    return a.join(F.broadcast(b)).join(F.broadcast(ids)).withColumn("follows", F.col("label_end") < F.col("template_start"))


def telemetry_long(wide: DataFrame, ts: str, turbines: Sequence[tuple[str, str, str]], measures: Mapping[str, str]) -> DataFrame:
    """Wide telemetry (one column per turbine and measure) to (ts, grp, turbine, power, ws, wd) rows.

    ``turbines`` lists (group, turbine, column prefix); ``measures`` maps output names to column suffixes.  A row unfolds
    into its turbines in place, so nothing is shuffled.
    """
    rows = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(t).alias("turbine"), *[F.col(f"{prefix}{suffix}").try_cast("double").alias(m) for m, suffix in measures.items()])
                     for g, t, prefix in turbines])
    return wide.select(ts, F.inline(rows))


def read_features(spark: SparkSession, path: str, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """Column-pruned Parquet scan; a predicate given here reaches the scan."""
    frame = spark.read.parquet(path)
    if where is not None:
        frame = frame.where(where)
    return frame.select(*columns)


def read_until(spark: SparkSession, path: str, ts: str, bound: str, partition: str | None = None) -> DataFrame:
    """Rows up to a time bound of a table partitioned by operating year: later years are never listed, and later rows of
    the last year never leave the scan."""
    frame = spark.read.parquet(path)
    limit = F.lit(bound).cast("timestamp_ntz")
    if partition:
        frame = frame.where(F.col(partition) <= int(bound[:4]))
    return frame.where(F.col(ts) <= limit)
