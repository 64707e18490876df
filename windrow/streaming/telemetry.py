"""Hourly telemetry as a stream: the batch aggregation on a one-hour tumbling window.

Readings arrive every ten minutes, so an hour is emitted once the watermark has passed its end.  The additive parts of the
batch operator are kept in state; exact percentiles and the number of distinct intervals need all readings of an hour and
stay with the batch form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.functions.exprs import clip, finite, sum_when
from windrow.functions.wind import circular_mean
from windrow.operators.telemetry import CAPACITY_FACTOR_CAP, CUT_IN, CUT_OUT, MAX_WIND, ONLINE_POWER, mask_spikes

COLUMNS = ("obs_power", "obs_power_mean", "obs_power_std", "obs_ws_mean", "obs_ws_std", "obs_ws_min", "obs_ws_max", "obs_wd_sin", "obs_wd_cos",
           "obs_wd_resultant", "obs_wd_mean_deg", "obs_n_power_valid", "obs_n_ws_valid", "obs_n_wd_valid", "obs_n_adequate_wind", "obs_n_online",
           "obs_power_spike_count", "obs_invalid_ws_count", "obs_turbine_availability", "obs_power_scaled", "obs_capacity_factor")


def hourly_stream(readings: DataFrame, specs: DataFrame, ts: str = "ts", delay: str = "30 minutes") -> DataFrame:
    """(hour_end, grp, ...) from readings (ts, grp, turbine, power, ws, wd) and static group specs (grp, low, high,
    expected, group_capacity)."""
    # event time must carry a zone; the session's zone is UTC, so local times pass through unchanged
    rows = readings.withColumn(ts, F.col(ts).cast("timestamp_ltz")).withWatermark(ts, delay).join(specs, "grp")
    power, spike = mask_spikes("power", "low", "high")
    ws_ok = finite("ws") & F.col("ws").between(0.0, MAX_WIND)
    rows = rows.select(ts, "grp", "expected", "group_capacity", power.alias("p"), spike.alias("spike"), F.when(ws_ok, F.col("ws")).alias("s"), (finite("ws") & ~ws_ok).alias("bad"),
                       F.when(finite("wd"), F.pmod(F.col("wd"), F.lit(360.0))).alias("d"))
    adequate = F.coalesce(F.col("p").isNotNull() & F.col("s").between(CUT_IN, CUT_OUT), F.lit(False))
    angle = F.radians("d")
    out = rows.groupBy(F.window(ts, "1 hour").alias("w"), "grp").agg(
        F.first("expected").alias("_e"), F.first("group_capacity").alias("_c"), F.sum("p").alias("obs_power"), F.avg("p").alias("obs_power_mean"), F.stddev_pop("p").alias("obs_power_std"),
        F.avg("s").alias("obs_ws_mean"), F.stddev_pop("s").alias("obs_ws_std"), F.min("s").alias("obs_ws_min"), F.max("s").alias("obs_ws_max"), F.avg(F.sin(angle)).alias("obs_wd_sin"),
        F.avg(F.cos(angle)).alias("obs_wd_cos"), F.count("p").alias("obs_n_power_valid"), F.count("s").alias("obs_n_ws_valid"), F.count("d").alias("obs_n_wd_valid"),
        sum_when(adequate).alias("obs_n_adequate_wind"), sum_when(adequate & (F.col("p") > ONLINE_POWER)).alias("obs_n_online"), sum_when(F.col("spike")).alias("obs_power_spike_count"),
        sum_when(F.col("bad")).alias("obs_invalid_ws_count"))
    scaled = F.col("obs_power_mean") * F.col("_e")
    out = out.withColumns({
        "obs_wd_resultant": F.hypot("obs_wd_sin", "obs_wd_cos"), "obs_wd_mean_deg": circular_mean("obs_wd_sin", "obs_wd_cos"),
        "obs_turbine_availability": clip(F.col("obs_n_online") / F.nullif(F.col("obs_n_adequate_wind"), F.lit(0)), 0.0, 1.0),
        "obs_power_scaled": scaled, "obs_capacity_factor": clip(scaled / F.col("_c"), 0.0, CAPACITY_FACTOR_CAP)})
    return out.select(F.col("w.end").cast("timestamp_ntz").alias("hour_end"), "grp", *COLUMNS)
