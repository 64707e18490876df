"""Checks that meet planted faults, and scans, sinks and payloads compared row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.functions.exprs import r6
from windrow.plans.registry import query
from windrow.session import scratch_folder
from windrow.sources import payloads as PL
from windrow.sources import readers as RD
from windrow.sources import sinks as SK

GROUPS = ("g1", "g2", "g3")
#: highest label or forecast of a group per day, the wide form that labels and results have
_WIDE = "SELECT ts, " + ", ".join(f"max({{0}}) FILTER (grp = '{g}') AS {g}" for g in GROUPS) + " FROM fcst GROUP BY 1"
_PLANTED = """SELECT ts, CASE WHEN day(ts) = 9 THEN 'infinity'::DOUBLE ELSE g1 END AS g1, CASE WHEN day(ts) = 5 THEN -g2 ELSE g2 END AS g2, CASE WHEN day(ts) = 7 THEN 'nan'::DOUBLE ELSE g3 END AS g3 FROM w"""


def _wide(v, value: str) -> DataFrame:
    return v.fcst.groupBy("ts").agg(*[F.max(F.when(F.col("grp") == g, F.col(value))).alias(g) for g in GROUPS])


@query("faulty_labels", "S04 S05", f"""
WITH w AS ({_WIDE.format('actual')}), p AS ({_PLANTED}), l AS (SELECT * FROM p WHERE ts < TIMESTAMP '2000-01-01' UNION ALL SELECT * FROM p WHERE ts < TIMESTAMP '2000-01-01' AND day(ts) = 3),
h AS (SELECT ts, count(*) AS n, min(g1) AS g1, min(g2) AS g2, min(g3) AS g3, max((isnan(g1) OR isinf(g1))::INT) AS b1, max((isnan(g2) OR isinf(g2))::INT) AS b2, max((isnan(g3) OR isinf(g3))::INT) AS b3 FROM l GROUP BY 1),
c AS (SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (n > 1) AS duplicate_hours, count(*) FILTER (least(coalesce(g1, 0), coalesce(g2, 0), coalesce(g3, 0)) < 0) AS negative_hours,
      CAST(sum(coalesce(b1, 0) + coalesce(b2, 0) + coalesce(b3, 0)) AS BIGINT) AS non_finite, min(ts) AS first_ts, max(ts) AS last_ts FROM h),
t AS (SELECT ts, strftime(ts, '%Y%m') AS forecast_id FROM w WHERE ts >= TIMESTAMP '1999-12-15')
SELECT c.*, last_ts AS label_end, (SELECT min(ts) FROM t) AS template_start, (SELECT count(*) FROM t) AS template_rows, (SELECT count(*) FROM (SELECT 1 FROM t GROUP BY forecast_id HAVING count(*) > 1)) AS duplicate_ids,
       last_ts < (SELECT min(ts) FROM t) AS follows FROM c""")
def faulty_labels(v) -> DataFrame:
    """Repeated, negative and not finite labels, and a template that starts too early with repeated ids."""
    wide, day = _wide(v, "actual"), F.dayofmonth("ts")
    planted = wide.select("ts", F.when(day == 9, float("inf")).otherwise(F.col("g1")).alias("g1"), F.when(day == 5, -F.col("g2")).otherwise(F.col("g2")).alias("g2"),
                          F.when(day == 7, float("nan")).otherwise(F.col("g3")).alias("g3"))
    labels = planted.where(F.col("ts") < F.lit("2000-01-01").cast("timestamp_ntz"))
    labels = labels.unionByName(labels.where(day == 3))
    template = wide.where(F.col("ts") >= F.lit("1999-12-15").cast("timestamp_ntz")).select("ts", F.date_format("ts", "yyyyMM").alias("forecast_id"))
    return RD.label_checks(labels, "ts", list(GROUPS)).join(F.broadcast(RD.template_follows(labels, template)))


_RESULT = f"""w AS ({_WIDE.format('base')}), e AS (SELECT strftime(ts, '%Y%m%d') AS forecast_id, strftime(ts, '%Y-%m-%d') AS forecast_ts, g1, g2, g3, day(ts) AS d FROM w WHERE g1 + g2 + g3 IS NOT NULL),
g AS (SELECT forecast_id, forecast_ts, CASE WHEN d = 5 THEN -1.0e0 ELSE g1 END AS g1, CASE WHEN d <> 7 THEN g2 END AS g2, g3, d FROM e WHERE d <> 9), o AS (SELECT * FROM g UNION ALL SELECT * FROM g WHERE d = 3)"""


def _written(v) -> tuple[DataFrame, str]:
    """The rows meant to be written, and the folder of a CSV with repeated, negative, empty and missing rows."""
    rows = _wide(v, "base").where("g1 + g2 + g3 IS NOT NULL").select(F.date_format("ts", "yyyyMMdd").alias("forecast_id"), F.date_format("ts", "yyyy-MM-dd").alias("forecast_ts"), *GROUPS)
    day, path = F.substring("forecast_id", 7, 2).cast("int"), scratch_folder(v.spark, "faulty-result")
    got = rows.where(day != 9).withColumns({"g1": F.when(day == 5, -1.0).otherwise(F.col("g1")), "g2": F.when(day != 7, F.col("g2"))})
    SK.write_csv(got.unionByName(got.where(day == 3)), path, "forecast_id")
    return rows, path


@query("faulty_result_contract", "S15 S17", f"""
WITH {_RESULT}, k AS (SELECT forecast_id, count(*) AS n, count(*) FILTER (g2 IS NULL) AS bad, count(*) FILTER (g1 < 0) AS below FROM o GROUP BY 1),
x AS (SELECT count(*) AS n FROM (SELECT * FROM (SELECT forecast_id, forecast_ts FROM e EXCEPT ALL SELECT forecast_id, forecast_ts FROM o) UNION ALL SELECT * FROM (SELECT forecast_id, forecast_ts FROM o EXCEPT ALL SELECT forecast_id, forecast_ts FROM e)))
SELECT CAST(sum(k.n) AS BIGINT) AS rows, count(*) FILTER (k.n > 1) AS duplicate_keys, CAST(count(*) FILTER (forecast_id IS NULL) AS BIGINT) AS null_keys, CAST(sum(bad) AS BIGINT) AS non_finite, CAST(sum(below) AS BIGINT) AS negative,
       (SELECT n FROM x) AS key_differences, (SELECT count(*) FROM e) AS expected_rows, false AS valid FROM k""")
def faulty_result_contract(v) -> DataFrame:
    rows, path = _written(v)
    return SK.output_contract(v.spark, path, rows, ["forecast_id", "forecast_ts", *GROUPS], list(GROUPS))


@query("faulty_result_differences", "S16 S15", f"""
WITH {_RESULT}, a AS (SELECT forecast_id, forecast_ts, g1, g2, g3 FROM e), b AS (SELECT forecast_id, forecast_ts, g1, g2, g3 FROM o)
SELECT forecast_id, 'left' AS side, round(g1 + 1e-9, 6) + 0 AS g1, round(g2 + 1e-9, 6) + 0 AS g2 FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT forecast_id, 'right', round(g1 + 1e-9, 6) + 0, round(g2 + 1e-9, 6) + 0 FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def faulty_result_differences(v) -> DataFrame:
    rows, path = _written(v)
    return SK.verify_written(v.spark, path, rows, "csv").select("forecast_id", "side", r6("g1").alias("g1"), r6("g2").alias("g2"))


@query("feature_cache_rows", "S14 S07 S08 S09", """
SELECT grp, site, ts, round(base + 1e-9, 6) + 0 AS base FROM fcst WHERE ts <= TIMESTAMP '1998-06-30'""")
def feature_cache_rows(v) -> DataFrame:
    path = scratch_folder(v.spark, "cache")
    SK.write_feature_cache(v.fcst.select("grp", F.year("ts").alias("split"), "ts", "site", "actual", "base"), path)
    return RD.read_until(v.spark, path, "ts", "1998-06-30", "split").select("grp", "site", "ts", r6("base").alias("base"))


@query("weather_csv_rows", "S01", """
SELECT forecast_ts, grid_id, round(CAST(CAST(u AS FLOAT) AS DOUBLE) + 1e-7, 4) + 0 AS u, round(CAST(CAST(gust AS FLOAT) AS DOUBLE) + 1e-7, 4) + 0 AS gust FROM wx""")
def weather_csv_rows(v) -> DataFrame:
    """Columns in another order, an unregistered one among them, come back as registered."""
    path = scratch_folder(v.spark, "weather")
    v.wx.select("gust", "grid_id", F.lit("x").alias("unregistered"), "forecast_ts", "u").write.option("header", True).csv(path)
    schema = RD.weather_schema(["u", "gust"])
    back = RD.read_csv(v.spark, path, type(schema)([f for f in schema.fields if f.name in ("forecast_ts", "grid_id", "u", "gust")]))
    return back.select("forecast_ts", F.col("grid_id").cast("int").alias("grid_id"), *[r6(F.col(c).cast("double"), 4).alias(c) for c in ("u", "gust")])


@query("hourly_payload_rows", "S11", "SELECT grid_id, forecast_ts AS time, round(gust + 1e-9, 6) + 0 AS value FROM wx")
def hourly_payload_rows(v) -> DataFrame:
    """One JSON document per grid cell and run, back to one row per hour."""
    hours = F.sort_array(F.collect_list(F.struct(F.date_format("forecast_ts", "yyyy-MM-dd'T'HH:mm").alias("t"), F.col("gust").alias("g"))))
    packed = v.wx.groupBy("grid_id", "run_key").agg(hours.alias("a"))
    docs = packed.select("grid_id", F.to_json(F.struct(F.struct(F.col("a.t").alias("time"), F.col("a.g").alias("gust")).alias("hourly")), {"ignoreNullFields": "false"}).alias("payload"))
    return PL.hourly_payload(docs, "payload", "gust", ["grid_id"]).select("grid_id", "time", r6("value").alias("value"))


@query("experiment_log_rows", "S20", """
SELECT grp || '-' || site AS experiment_id, CASE site % 3 WHEN 0 THEN 'planned' WHEN 1 THEN 'running' ELSE 'completed' END AS status, count(*) AS n, round(sum(base) / count(*) + 1e-9, 6) + 0 AS dev_base,
  CASE WHEN site % 3 = 2 THEN round(sum(cand) / count(*) + 1e-9, 6) + 0 END AS board_cand, CAST(site % 5 AS VARCHAR) AS seed FROM fcst GROUP BY grp, site""")
def experiment_log_rows(v) -> DataFrame:
    """One record per group and site in three appends; development and leaderboard metrics apart."""
    path = scratch_folder(v.spark, "log")
    mean = lambda c: F.sum(c) / F.count(F.lit(1))
    per = v.fcst.groupBy("grp", "site").agg(F.count(F.lit(1)).cast("double").alias("n"), mean("base").alias("b"), mean("cand").alias("c"))
    kind, empty = F.col("site") % 3, F.create_map().cast("map<string,string>")
    board = F.when(kind == 2, F.create_map(F.lit("cand"), F.col("c"))).otherwise(F.create_map().cast("map<string,double>"))
    records = per.select(
        F.lit(1).alias("schema_version"), F.concat_ws("-", "grp", F.col("site").cast("string")).alias("experiment_id"), F.current_timestamp().alias("created_utc"),
        F.when(kind == 0, "planned").when(kind == 1, "running").otherwise("completed").alias("status"), empty.alias("validation"),
        F.create_map(F.lit("seed"), (F.col("site") % 5).cast("string")).alias("model"), F.create_map(F.lit("n"), F.col("n"), F.lit("base"), F.col("b")).alias("dev_metrics"),
        board.alias("leaderboard_metrics"), empty.alias("artifacts"), F.lit("").alias("notes"))
    for g in GROUPS:
        SK.append_experiments(records.where(F.col("experiment_id").startswith(g)), path)
    return SK.read_experiments(v.spark, path).select("experiment_id", "status", F.col("dev_metrics")["n"].cast("bigint").alias("n"), r6(F.col("dev_metrics")["base"]).alias("dev_base"),
                                                     r6(F.col("leaderboard_metrics")["cand"]).alias("board_cand"), F.col("model")["seed"].alias("seed"))
