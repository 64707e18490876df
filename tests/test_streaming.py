"""The stream form of the hourly aggregation agrees with the batch form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.operators.telemetry import hourly_groups
from windrow.streaming.telemetry import hourly_stream

SCHEMA = "ts timestamp_ntz, grp string, turbine int, power double, ws double, wd double"


def test_hours_close_with_the_watermark_and_match_the_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, f"f{t % 2}", t, float(rng.uniform(-50, 700)), float(rng.uniform(-5, 90)), float(rng.uniform(-180, 360))) for i in range(30) for t in range(4)]
    df = spark.createDataFrame(rows, "i int, grp string, turbine int, power double, ws double, wd double").select(
        F.timestamp_add("MINUTE", F.col("i") * 10, F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"), "grp", "turbine", "power", "ws", "wd")
    source = str(tmp_path / "in")
    df.coalesce(1).write.parquet(source)
    specs = spark.createDataFrame([("f0", -30.0, 630.0, 12, 7200.0), ("f1", -30.0, 630.0, 12, 7200.0)], "grp string, low double, high double, expected int, group_capacity double")
    stream = hourly_stream(spark.readStream.schema(SCHEMA).parquet(source), specs)
    out = str(tmp_path / "out")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["hour_end"], r["grp"]): r for r in spark.read.parquet(out).collect()}
    batch = hourly_groups(df.select((F.date_trunc("hour", "ts").cast("timestamp_ntz") + F.expr("INTERVAL 1 HOUR")).alias("hour_end"), F.minute("ts").alias("slot"), "grp", "turbine", "power", "ws", "wd"), specs)
    want = {(r["hour_end"], r["grp"]): r for r in batch.collect()}
    # the last reading is 04:50, so with half an hour of delay the hours up to 04:00 are closed
    assert len(got) == 8 and set(got) <= set(want)
    for key, row in got.items():
        for name in ("obs_power", "obs_ws_std", "obs_wd_mean_deg", "obs_n_online", "obs_power_spike_count", "obs_turbine_availability", "obs_capacity_factor"):
            assert row[name] == pytest.approx(want[key][name]), name
