"""Surrogate inputs over the driver tables.

The driver supplies order tables and an event stream; these views give them the shape of gridded forecasts, turbine
telemetry, settled forecasts and sites.  A farm holds six turbines, so there are more farms, not larger ones, as the data
grows.  Every value is an integer total divided once, so Spark and a SQL engine see the
same bits, and every view has a key whose count grows with the data (cells and turbines with users, sites with
suppliers, rows with line items).
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.functions.timekeys import hour_floor, run_key

NTZ = "timestamp_ntz"

VIEW_SQL = {
    "wx_obs": """
SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS forecast_ts, CAST(floor(user_id / 25) AS INTEGER) AS grid_id,
       sum(CAST(round(value * 100) AS BIGINT)) / (count(*) * 1000.0) AS u,
       sum((event_id * 7) % 100) / (count(*) * 10.0) - 5 AS v,
       sum((event_id * 13) % 160) / (count(*) * 10.0) - 6 AS u50,
       sum((event_id * 17) % 180) / (count(*) * 10.0) - 8 AS v50,
       sum((event_id * 3) % 250) / (count(*) * 10.0) AS gust,
       273.15e0 + sum(user_id % 30) / CAST(count(*) AS DOUBLE) AS t2,
       266.15e0 + sum((user_id * 3) % 35) / CAST(count(*) AS DOUBLE) AS d2,
       90000 + sum(event_id % 1000) / CAST(count(*) AS DOUBLE) AS sp
FROM events GROUP BY 1, 2""",
    "wx_cells": """
SELECT grid_id, 37.2e0 + 0.03e0 * (floor(grid_id / 3) % 1000) AS lat,
       128.9e0 + 0.03e0 * (grid_id % 3 + 3 * floor(grid_id / 3000)) AS lon
FROM (SELECT DISTINCT grid_id FROM wx_obs)""",
    "wx": """
SELECT k.forecast_ts, date_trunc('day', k.forecast_ts - INTERVAL 1 HOUR) AS run_key,
       date_trunc('day', k.forecast_ts - INTERVAL 1 HOUR) - INTERVAL 11 HOUR AS issued_ts,
       k.grid_id, k.lat, k.lon, o.u, o.v, o.u50, o.v50, o.gust, o.t2, o.d2, o.sp
FROM (SELECT c.grid_id, c.lat, c.lon,
             unnest(generate_series((SELECT date_trunc('day', min(ts)) + INTERVAL 1 HOUR FROM events),
                                    (SELECT date_trunc('day', max(ts)) + INTERVAL 24 HOUR FROM events),
                                    INTERVAL 1 HOUR)) AS forecast_ts
      FROM wx_cells c) k
LEFT JOIN wx_obs o ON o.forecast_ts = k.forecast_ts AND o.grid_id = k.grid_id""",
    "scada10": """
SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS hour_end, CAST(floor(minute(ts) / 10) AS INTEGER) AS slot,
       CAST(floor(user_id / 10) AS INTEGER) AS turbine,
       concat('f', CAST(CAST(floor(user_id / 60) AS INTEGER) AS VARCHAR)) AS grp,
       sum(CAST(round(value * 100) AS BIGINT)) / (count(*) * 100.0) AS power,
       sum((event_id * 11) % 250) / (count(*) * 10.0) AS ws,
       sum((event_id * 37) % 360) / CAST(count(*) AS DOUBLE) AS wd
FROM events GROUP BY 1, 2, 3, 4""",
    "fcst_raw": """
SELECT concat('g', CAST(l_suppkey % 3 + 1 AS VARCHAR)) AS grp, l_suppkey AS site, l_shipdate AS ts,
       sum(CAST(l_quantity AS BIGINT)) / 1.0 AS actual,
       sum(CAST(l_quantity AS BIGINT) * (100 + 8 * (CAST(round(l_discount * 100) AS BIGINT) - 5))) / 100.0 AS base,
       sum(CAST(l_quantity AS BIGINT) * (100 + 6 * (CAST(round(l_tax * 100) AS BIGINT) - 4))) / 100.0 AS cand,
       sum(CAST(l_quantity AS BIGINT) * (100 + 5 * (CAST(round(l_discount * 100) AS BIGINT)
           - CAST(round(l_tax * 100) AS BIGINT)))) / 100.0 AS third
FROM lineitem GROUP BY 1, 2, 3""",
    "fcst": """
SELECT *, CASE grp WHEN 'g3' THEN 58.0e0 ELSE 60.0e0 END AS capacity FROM fcst_raw""",
    "gday": """
SELECT concat('g', CAST(l_suppkey % 3 + 1 AS VARCHAR)) AS grp, l_shipdate AS ts,
       sum(CAST(l_quantity AS BIGINT)) / CAST(count(*) AS DOUBLE) AS actual,
       sum(CAST(l_quantity AS BIGINT) * (100 + 8 * (CAST(round(l_discount * 100) AS BIGINT) - 5))) / (count(*) * 100.0) AS base,
       sum(CAST(l_quantity AS BIGINT) * (100 + 6 * (CAST(round(l_tax * 100) AS BIGINT) - 4))) / (count(*) * 100.0) AS cand,
       sum(CAST(l_quantity AS BIGINT) * (100 + 5 * (CAST(round(l_discount * 100) AS BIGINT)
           - CAST(round(l_tax * 100) AS BIGINT)))) / (count(*) * 100.0) AS third,
       CASE WHEN l_suppkey % 3 = 2 THEN 58.0e0 ELSE 60.0e0 END AS capacity
FROM lineitem GROUP BY 1, 2, 7""",
    "components": """
SELECT 'base' AS model, grp, site, ts, base AS kwh, actual, capacity FROM fcst
UNION ALL SELECT 'cand', grp, site, ts, cand, actual, capacity FROM fcst
UNION ALL SELECT 'third', grp, site, ts, third, actual, capacity FROM fcst""",
    "sites": """
SELECT s_suppkey AS turbine_id, concat('g', CAST(s_suppkey % 3 + 1 AS VARCHAR)) AS grp,
       concat('f', CAST(CAST(floor(s_suppkey / 6) AS INTEGER) AS VARCHAR)) AS farm, 37.2e0 + 0.01e0 * (s_suppkey % 10) AS lat, 128.9e0 + 0.01e0 * floor(s_suppkey / 10) AS lon,
       3.6e0 + 0.3e0 * (s_nationkey % 3) AS capacity_mw, 117.0e0 AS hub_height_m, 126.0e0 AS rotor_m
FROM supplier""",
    "dem": """
SELECT CAST(o_orderkey % 100 AS BIGINT) AS row_no, CAST(floor(o_orderkey / 100) AS BIGINT) AS col_no,
       37.2e0 + 0.001e0 * (o_orderkey % 100) AS lat, 128.9e0 + 0.001e0 * floor(o_orderkey / 100) AS lon,
       (CAST(round(o_totalprice * 100) AS BIGINT) % 20000) / 100.0 AS z
FROM orders""",
    "prov": """
SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS ts, CAST(floor(user_id / 25) AS INTEGER) AS grid_id,
       sum((event_id * 3) % 200) / (count(*) * 10.0) AS a_ws_d1, sum((event_id * 7) % 210) / (count(*) * 10.0) AS a_ws_d2,
       sum((event_id * 17) % 360) / CAST(count(*) AS DOUBLE) AS a_wd_d1,
       sum((event_id * 19) % 360) / CAST(count(*) AS DOUBLE) AS a_wd_d2,
       sum((event_id * 5) % 190) / (count(*) * 10.0) AS b_ws_d1, sum((event_id * 9) % 220) / (count(*) * 10.0) AS b_ws_d2,
       sum((event_id * 23) % 360) / CAST(count(*) AS DOUBLE) AS b_wd_d1,
       sum((event_id * 29) % 360) / CAST(count(*) AS DOUBLE) AS b_wd_d2,
       sum((event_id * 11) % 230) / (count(*) * 10.0) AS c_ws_d1, sum((event_id * 13) % 240) / (count(*) * 10.0) AS c_ws_d2,
       sum((event_id * 31) % 360) / CAST(count(*) AS DOUBLE) AS c_wd_d1,
       sum((event_id * 37) % 360) / CAST(count(*) AS DOUBLE) AS c_wd_d2
FROM events GROUP BY 1, 2""",
}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it names, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEW_SQL:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEW_SQL[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    body = sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n].strip()})" for n in needed)
    if body.lower().startswith("with recursive "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    return f"WITH {ctes},\n{body[5:]}" if body.lower().startswith("with ") else f"WITH {ctes}\n{body}"


def _avg_mod(key: str, factor: int, modulus: int, scale: float = 1.0) -> Column:
    return F.sum((F.col(key) * factor) % modulus) / (F.count(F.lit(1)) * scale)


class Views:
    """Lazily built Spark twins of ``VIEW_SQL``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast(NTZ))

    @cached_property
    def wx_obs(self) -> DataFrame:
        hours = (hour_floor("ts") + F.expr("INTERVAL 1 HOUR")).alias("forecast_ts")
        return self.events.groupBy(hours, F.floor(F.col("user_id") / 25).cast("int").alias("grid_id")).agg(
            (F.sum(F.round(F.col("value") * 100).cast("long")) / (F.count(F.lit(1)) * 1000.0)).alias("u"),
            (_avg_mod("event_id", 7, 100, 10.0) - 5).alias("v"),
            (_avg_mod("event_id", 13, 160, 10.0) - 6).alias("u50"),
            (_avg_mod("event_id", 17, 180, 10.0) - 8).alias("v50"),
            _avg_mod("event_id", 3, 250, 10.0).alias("gust"),
            (273.15 + _avg_mod("user_id", 1, 30)).alias("t2"),
            (266.15 + _avg_mod("user_id", 3, 35)).alias("d2"),
            (90000 + _avg_mod("event_id", 1, 1000)).alias("sp"),
        )

    @cached_property
    def wx_cells(self) -> DataFrame:
        g = F.col("grid_id")
        return self.events.select(F.floor(F.col("user_id") / 25).cast("int").alias("grid_id")).distinct().select(
            "grid_id",
            (37.2 + 0.03 * (F.floor(g / 3) % 1000)).alias("lat"),
            (128.9 + 0.03 * (g % 3 + 3 * F.floor(g / 3000))).alias("lon"),
        )

    @cached_property
    def wx(self) -> DataFrame:
        day = F.date_trunc("day", "ts").cast(NTZ)
        first = self.events.agg(F.min(day) + F.expr("INTERVAL 1 HOUR")).scalar()
        last = self.events.agg(F.max(day) + F.expr("INTERVAL 24 HOUR")).scalar()
        expected = self.wx_cells.withColumn(
            "forecast_ts", F.explode(F.sequence(first, last, F.expr("INTERVAL 1 HOUR")))
        )
        return expected.join(self.wx_obs, ["forecast_ts", "grid_id"], "left").select(
            "forecast_ts",
            run_key("forecast_ts").alias("run_key"),
            (run_key("forecast_ts") - F.expr("INTERVAL 11 HOUR")).alias("issued_ts"),
            "grid_id", "lat", "lon", "u", "v", "u50", "v50", "gust", "t2", "d2", "sp",
        )

    @cached_property
    def scada10(self) -> DataFrame:
        turbine = F.floor(F.col("user_id") / 10).cast("int")
        return self.events.groupBy(
            (hour_floor("ts") + F.expr("INTERVAL 1 HOUR")).alias("hour_end"),
            F.floor(F.minute("ts") / 10).cast("int").alias("slot"),
            turbine.alias("turbine"),
            F.concat(F.lit("f"), F.floor(F.col("user_id") / 60).cast("int").cast("string")).alias("grp"),
        ).agg(
            (F.sum(F.round(F.col("value") * 100).cast("long")) / (F.count(F.lit(1)) * 100.0)).alias("power"),
            _avg_mod("event_id", 11, 250, 10.0).alias("ws"),
            _avg_mod("event_id", 37, 360).alias("wd"),
        )

    @cached_property
    def fcst_raw(self) -> DataFrame:
        q = F.col("l_quantity").cast("long")
        disc = F.round(F.col("l_discount") * 100).cast("long")
        tax = F.round(F.col("l_tax") * 100).cast("long")
        return self.table("lineitem").groupBy(
            F.concat(F.lit("g"), (F.col("l_suppkey") % 3 + 1).cast("string")).alias("grp"),
            F.col("l_suppkey").alias("site"),
            F.col("l_shipdate").cast(NTZ).alias("ts"),
        ).agg(
            (F.sum(q) / 1.0).alias("actual"),
            (F.sum(q * (100 + 8 * (disc - 5))) / 100.0).alias("base"),
            (F.sum(q * (100 + 6 * (tax - 4))) / 100.0).alias("cand"),
            (F.sum(q * (100 + 5 * (disc - tax))) / 100.0).alias("third"),
        )

    @cached_property
    def fcst(self) -> DataFrame:
        return self.fcst_raw.withColumn("capacity", F.when(F.col("grp") == "g3", 58.0).otherwise(60.0))

    @cached_property
    def gday(self) -> DataFrame:
        """Mean over the line items of a group and day."""
        q = F.col("l_quantity").cast("long")
        disc = F.round(F.col("l_discount") * 100).cast("long")
        tax = F.round(F.col("l_tax") * 100).cast("long")
        n = F.count(F.lit(1))
        return self.table("lineitem").groupBy(
            F.concat(F.lit("g"), (F.col("l_suppkey") % 3 + 1).cast("string")).alias("grp"), F.col("l_shipdate").cast(NTZ).alias("ts"),
        ).agg(
            (F.sum(q) / n).alias("actual"), (F.sum(q * (100 + 8 * (disc - 5))) / (n * 100.0)).alias("base"),
            (F.sum(q * (100 + 6 * (tax - 4))) / (n * 100.0)).alias("cand"), (F.sum(q * (100 + 5 * (disc - tax))) / (n * 100.0)).alias("third"),
        ).withColumn("capacity", F.when(F.col("grp") == "g3", 58.0).otherwise(60.0))

    @cached_property
    def components(self) -> DataFrame:
        return self.fcst.select(
            F.explode(F.array(*[
                F.struct(F.lit(m).alias("model"), F.col(m).alias("kwh")) for m in ("base", "cand", "third")
            ])).alias("m"),
            "grp", "site", "ts", "actual", "capacity",
        ).select("m.model", "grp", "site", "ts", "m.kwh", "actual", "capacity")

    @cached_property
    def sites(self) -> DataFrame:
        s = F.col("s_suppkey")
        return self.table("supplier").select(
            s.alias("turbine_id"),
            F.concat(F.lit("g"), (s % 3 + 1).cast("string")).alias("grp"),
            F.concat(F.lit("f"), F.floor(s / 6).cast("int").cast("string")).alias("farm"),
            (37.2 + 0.01 * (s % 10)).alias("lat"),
            (128.9 + 0.01 * F.floor(s / 10)).alias("lon"),
            (3.6 + 0.3 * (F.col("s_nationkey") % 3)).alias("capacity_mw"),
            F.lit(117.0).alias("hub_height_m"),
            F.lit(126.0).alias("rotor_m"),
        )

    @cached_property
    def dem(self) -> DataFrame:
        """Elevation pixels on a 0.001 degree lattice that grows eastward with the data."""
        o = F.col("o_orderkey")
        return self.table("orders").select(
            (o % 100).alias("row_no"), F.floor(o / 100).alias("col_no"),
            (37.2 + 0.001 * (o % 100)).alias("lat"), (128.9 + 0.001 * F.floor(o / 100)).alias("lon"),
            ((F.round(F.col("o_totalprice") * 100).cast("long") % 20000) / 100.0).alias("z"),
        )

    @cached_property
    def prov(self) -> DataFrame:
        aggs = []
        for name, s1, m1, s2, m2, d1, d2 in (
            ("a", 3, 200, 7, 210, 17, 19), ("b", 5, 190, 9, 220, 23, 29), ("c", 11, 230, 13, 240, 31, 37),
        ):
            aggs += [
                _avg_mod("event_id", s1, m1, 10.0).alias(f"{name}_ws_d1"),
                _avg_mod("event_id", s2, m2, 10.0).alias(f"{name}_ws_d2"),
                _avg_mod("event_id", d1, 360).alias(f"{name}_wd_d1"),
                _avg_mod("event_id", d2, 360).alias(f"{name}_wd_d2"),
            ]
        return self.events.groupBy(
            (hour_floor("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"),
            F.floor(F.col("user_id") / 25).cast("int").alias("grid_id"),
        ).agg(*aggs)
