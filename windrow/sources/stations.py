"""Station reports: normalising, quality control, deduplication and the trailing window before a cutoff."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.exprs import ColumnLike, col, sum_when
from windrow.functions.timekeys import CUTOFF_HOUR, day_floor, hour_floor, hours, hours_between
from windrow.functions.wind import components

# fixed values of the report format
REPORT_TYPE = "FM-12"
ACCEPTED_QUALITY = ("0", "1")
LOCAL_ZONE = "Asia/Seoul"
WINDOW_HOURS = 24
MISSING = {"speed": 9999, "direction": 999, "temperature": 9999, "pressure": 99999}


def field(text: ColumnLike, part: int) -> Column:
    """Part of a comma-packed field, empty when absent."""
    return F.coalesce(F.try_element_at(F.split(F.coalesce(col(text), F.lit("")), ","), F.lit(part + 1)), F.lit(""))


def checked_number(value: Column, quality: Column, missing: int, scale: float) -> Column:
    number = F.trim(value).try_cast("double")
    return F.when(quality.isin(*ACCEPTED_QUALITY) & number.isNotNull() & (number != missing), number / scale)


def normalise_reports(raw: DataFrame, station: str = "station", date: str = "date_utc", zone: str = LOCAL_ZONE) -> DataFrame:
    """One report type, local time, unpacked and quality-checked values, wind components, one row per station and time.

    The first report by source code wins; how many were dropped and whether values disagreed stays in the row.
    """
    rows = raw.where(F.col("report_type") == REPORT_TYPE)
    speed = checked_number(field("wnd", 3), field("wnd", 4), MISSING["speed"], 10.0)
    direction = checked_number(field("wnd", 0), field("wnd", 1), MISSING["direction"], 1.0)
    direction = F.when((speed == 0.0) & direction.isNull(), 0.0).otherwise(direction)
    rows = rows.withColumns({
        "wind_speed": speed, "wind_direction": F.when(direction.between(0.0, 360.0), direction),
        "temperature": checked_number(field("tmp", 0), field("tmp", 1), MISSING["temperature"], 10.0),
        "sea_level_pressure": checked_number(field("slp", 0), field("slp", 1), MISSING["pressure"], 10.0),
        "station_pressure": checked_number(field("ma1", 2), field("ma1", 3), MISSING["pressure"], 10.0),
        "wind_type": field("wnd", 2),
    })
    u, v = components("wind_speed", "wind_direction")
    utc = F.col(date).cast("timestamp_ltz")
    rows = rows.withColumns({"wind_u": u, "wind_v": v, "time_local": F.from_utc_timestamp(utc, zone).cast("timestamp_ntz")})
    return first_report(rows, [station, date], "source", ("wind_speed", "temperature", "sea_level_pressure"))


def first_report(rows: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Keep the first row per key in a stable order, with the number of rows and whether any value conflicted.

    An aggregate of structs does this with partial aggregation; a window would sort every key's rows.
    """
    rest = [c for c in rows.columns if c not in keys]
    full = F.struct(F.col(order).alias("_o"), F.struct(*[F.col(c) for c in rest]).alias("_r"))
    differs = [(F.min(v) != F.max(v)) for v in values]
    any_conflict = differs[0]
    for d in differs[1:]:
        any_conflict = F.coalesce(any_conflict, F.lit(False)) | F.coalesce(d, F.lit(False))
    out = rows.groupBy(*keys).agg(F.min_by(full, F.struct(F.col(order), F.xxhash64(*[F.col(c) for c in rest]))).alias("_b"), F.count(F.lit(1)).alias("reports"), any_conflict.alias("conflict"))
    return out.select(*keys, "_b._r.*", "reports", "conflict")


def decision_day(ts: ColumnLike, hour: int = CUTOFF_HOUR) -> Column:
    """The decision day whose window [cutoff - 24 h, cutoff) a report falls into; the cutoff is 14:00 of the day before.

    Windows of a day's length tile the time axis, so the interval join is plain arithmetic.
    """
    return day_floor(col(ts) + hours(24 - hour)) + hours(24)


def cutoff_summary(reports: DataFrame, days: DataFrame, variables: Mapping[str, str], keys: Sequence[str] = ("station",), ts: str = "time_local") -> DataFrame:
    """Per decision day and station: report and hour counts, age of the latest report, and per variable count, moments,
    extremes, latest value and change over the window.  Days without reports stay."""
    rows = reports.withColumn("decision_day", decision_day(ts))
    aggs = [F.count(F.lit(1)).alias("report_count"), F.countDistinct(hour_floor(ts)).alias("hour_count"), F.max(ts).alias("_last")]
    for name, c in variables.items():
        known = F.when(F.col(c).isNotNull(), F.col(ts))
        aggs += [F.count(c).alias(f"{name}_n"), F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std"), F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"),
                 F.max_by(c, known).alias(f"{name}_latest"), F.min_by(c, known).alias(f"_{name}_first")]
    out = days.join(rows.groupBy("decision_day", *keys).agg(*aggs), ["decision_day", *keys], "left")
    cutoff = F.col("decision_day") - hours(24 - CUTOFF_HOUR)
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("report_count", "hour_count", *[f"{n}_n" for n in variables])}
    out = out.withColumns({**counts, "latest_age_h": hours_between(cutoff, "_last"), **{f"{n}_delta": F.col(f"{n}_latest") - F.col(f"_{n}_first") for n in variables}})
    return out.drop("_last", *[f"_{n}_first" for n in variables])


def outer_daily(daily: DataFrame, at_hour: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Daily and fixed-hour observations side by side, keeping keys only one of them has; repeated keys fail the job."""
    def single(df: DataFrame, tag: str) -> DataFrame:
        values = [c for c in df.columns if c not in keys]
        one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in values])
        return one.select(*keys, *values, F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit("repeated key in a one-to-one join"))).alias(tag))

    out = single(daily, "_d").join(single(at_hour, "_h"), list(keys), "full")
    return out.withColumn("origin", F.when(F.col("_d") & F.col("_h"), "both").when(F.col("_d"), "daily").otherwise("hour")).drop("_d", "_h")


def report_census(raw: DataFrame, keys: Sequence[str]) -> DataFrame:
    return raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("raw_rows"), sum_when(F.col("report_type") == REPORT_TYPE).alias("kept_rows"))
