"""Source, sink and payload queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.functions import timekeys as T
from windrow.functions.exprs import r6
from windrow.plans.registry import query
from windrow.session import scratch_folder
from windrow.sources import manifests as MF
from windrow.sources import payloads as PL
from windrow.sources import readers as RD
from windrow.sources import sinks as SK
from windrow.sources import stations as ST

RAD = repr(math.pi / 180.0) + "e0"

_REPORTS = """rp AS (SELECT 'S' || (user_id % 7) AS station, date_trunc('hour', ts) AS date_utc, event_id AS source, CASE WHEN event_id % 9 = 0 THEN 'FM-15' ELSE 'FM-12' END AS report_type,
  lpad(CAST(CASE WHEN event_id % 13 = 0 THEN 999 ELSE (event_id * 37) % 360 END AS VARCHAR), 3, '0') || ',' || (event_id % 4) || ',N,' || lpad(CAST(CASE WHEN event_id % 17 = 0 THEN 9999 WHEN event_id % 5 = 0 THEN 0 ELSE (event_id * 7) % 250 END AS VARCHAR), 4, '0') || ',1' AS wnd,
  '+' || lpad(CAST((event_id * 3) % 300 AS VARCHAR), 4, '0') || ',' || (event_id % 3) AS tmp, lpad(CAST(CASE WHEN event_id % 11 = 0 THEN 99999 ELSE 10000 + event_id % 300 END AS VARCHAR), 5, '0') || ',1' AS slp,
  CASE WHEN event_id % 8 = 0 THEN NULL ELSE '99999,9,' || lpad(CAST(9900 + event_id % 200 AS VARCHAR), 5, '0') || ',1' END AS ma1 FROM events)"""
_NORM = f"""{_REPORTS},
n0 AS (SELECT *, string_split(wnd, ',') AS w, string_split(tmp, ',') AS t, string_split(slp, ',') AS s, string_split(coalesce(ma1, ''), ',') AS m FROM rp WHERE report_type = 'FM-12'),
n1 AS (SELECT *, CASE WHEN w[5] IN ('0', '1') AND w[4]::DOUBLE <> 9999 THEN w[4]::DOUBLE / 10 END AS ws, CASE WHEN w[2] IN ('0', '1') AND w[1]::DOUBLE <> 999 THEN w[1]::DOUBLE END AS d0,
   CASE WHEN t[2] IN ('0', '1') AND replace(t[1], '+', '')::DOUBLE <> 9999 THEN replace(t[1], '+', '')::DOUBLE / 10 END AS temperature, CASE WHEN s[2] IN ('0', '1') AND s[1]::DOUBLE <> 99999 THEN s[1]::DOUBLE / 10 END AS slpv,
   CASE WHEN m[4] IN ('0', '1') AND m[3]::DOUBLE <> 99999 THEN m[3]::DOUBLE / 10 END AS sp FROM n0),
n2 AS (SELECT *, CASE WHEN ws = 0 AND d0 IS NULL THEN 0 ELSE d0 END AS wd, row_number() OVER (PARTITION BY station, date_utc ORDER BY source) AS rn, count(*) OVER g AS reports,
   coalesce(min(ws) OVER g <> max(ws) OVER g, false) OR coalesce(min(temperature) OVER g <> max(temperature) OVER g, false) OR coalesce(min(slpv) OVER g <> max(slpv) OVER g, false) AS conflict FROM n1 WINDOW g AS (PARTITION BY station, date_utc)),
nr AS (SELECT station, date_utc, date_utc + INTERVAL 9 HOUR AS time_local, ws AS wind_speed, wd AS wind_direction, -ws * sin(wd * {RAD}) AS wind_u, -ws * cos(wd * {RAD}) AS wind_v, temperature, slpv AS sea_level_pressure, sp AS station_pressure, reports, conflict FROM n2 WHERE rn = 1)"""


def _reports(v) -> DataFrame:
    e = F.col("event_id")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return v.events.select(
        F.concat(F.lit("S"), (F.col("user_id") % 7).cast("string")).alias("station"), T.hour_floor("ts").alias("date_utc"), e.alias("source"),
        F.when(e % 9 == 0, "FM-15").otherwise("FM-12").alias("report_type"),
        F.concat(pad(F.when(e % 13 == 0, 999).otherwise((e * 37) % 360), 3), F.lit(","), (e % 4).cast("string"), F.lit(",N,"),
                 pad(F.when(e % 17 == 0, 9999).when(e % 5 == 0, 0).otherwise((e * 7) % 250), 4), F.lit(",1")).alias("wnd"),
        F.concat(F.lit("+"), pad((e * 3) % 300, 4), F.lit(","), (e % 3).cast("string")).alias("tmp"),
        F.concat(pad(F.when(e % 11 == 0, 99999).otherwise(10000 + e % 300), 5), F.lit(",1")).alias("slp"),
        F.when(e % 8 != 0, F.concat(F.lit("99999,9,"), pad(9900 + e % 200, 5), F.lit(",1"))).alias("ma1"))


_NR_VALUES = ["wind_speed", "wind_direction", "wind_u", "wind_v", "temperature", "sea_level_pressure", "station_pressure"]


@query("station_reports", "S10 F29 W12", f"""
WITH {_NORM} SELECT station, date_utc, time_local, reports, conflict, {', '.join(f'round({c} + 1e-9, 6) + 0 AS {c}' for c in _NR_VALUES)} FROM nr""")
def station_reports(v) -> DataFrame:
    out = ST.normalise_reports(_reports(v))
    return out.select("station", "date_utc", "time_local", "reports", "conflict", *[r6(c).alias(c) for c in _NR_VALUES])


_SUM = [f"{n}_{s}" for n in ("ws", "ta") for s in ("mean", "std", "min", "max", "latest", "delta")]


@query("cutoff_window_summary", "J09 W12", f"""
WITH {_NORM},
dd AS (SELECT *, date_trunc('day', time_local + INTERVAL 10 HOUR) + INTERVAL 24 HOUR AS decision_day FROM nr),
al AS (SELECT station, unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-02-02', INTERVAL 1 DAY)) AS decision_day FROM (SELECT DISTINCT station FROM nr)),
g AS (SELECT decision_day, station, count(*) AS report_count, count(DISTINCT date_trunc('hour', time_local)) AS hour_count, max(time_local) AS last, {', '.join(
  f"count({c}) AS {n}_n, avg({c}) AS {n}_mean, stddev_pop({c}) AS {n}_std, min({c}) AS {n}_min, max({c}) AS {n}_max, arg_max({c}, time_local) FILTER ({c} IS NOT NULL) AS {n}_latest, arg_max({c}, time_local) FILTER ({c} IS NOT NULL) - arg_min({c}, time_local) FILTER ({c} IS NOT NULL) AS {n}_delta"
  for n, c in (('ws', 'wind_speed'), ('ta', 'temperature')))} FROM dd GROUP BY 1, 2)
SELECT al.decision_day, al.station, coalesce(report_count, 0) AS report_count, coalesce(hour_count, 0) AS hour_count, coalesce(ws_n, 0) AS ws_n, coalesce(ta_n, 0) AS ta_n,
  round(epoch(al.decision_day - INTERVAL 10 HOUR - last) / 3600.0 + 1e-9, 6) AS latest_age_h, {', '.join(f'round({c} + 1e-9, 6) + 0 AS {c}' for c in _SUM)} FROM al LEFT JOIN g ON g.decision_day = al.decision_day AND g.station = al.station""")
def cutoff_window_summary(v) -> DataFrame:
    rows = ST.normalise_reports(_reports(v))
    first, last = F.lit("2024-01-02").cast("timestamp_ntz"), F.lit("2024-02-02").cast("timestamp_ntz")
    days = rows.select("station").distinct().withColumn("decision_day", F.explode(F.sequence(first, last, F.expr("INTERVAL 1 DAY"))))
    out = ST.cutoff_summary(rows, days, {"ws": "wind_speed", "ta": "temperature"})
    return out.select("decision_day", "station", "report_count", "hour_count", "ws_n", "ta_n", r6("latest_age_h").alias("latest_age_h"), *[r6(c).alias(c) for c in _SUM])


@query("daily_and_fixed_hour", "J15", """
WITH d AS (SELECT grid_id, run_key, round(avg(u) + 1e-9, 6) AS mean_u FROM (SELECT grid_id, date_trunc('day', forecast_ts - INTERVAL 1 HOUR) AS run_key, u FROM wx_obs WHERE hour(forecast_ts) % 6 = 0) GROUP BY 1, 2),
h AS (SELECT grid_id, date_trunc('day', forecast_ts - INTERVAL 1 HOUR) AS run_key, round(gust + 1e-9, 6) AS gust FROM wx_obs WHERE hour(forecast_ts) = 13)
SELECT grid_id, run_key, mean_u, gust, CASE WHEN d.m AND h.m THEN 'both' WHEN d.m THEN 'daily' ELSE 'hour' END AS origin FROM (SELECT *, true AS m FROM d) d FULL JOIN (SELECT *, true AS m FROM h) h USING (grid_id, run_key)""")
def daily_and_fixed_hour(v) -> DataFrame:
    rows = v.wx_obs.withColumn("run_key", T.run_key("forecast_ts"))
    daily = rows.where(F.hour("forecast_ts") % 6 == 0).groupBy("grid_id", "run_key").agg(r6(F.avg("u")).alias("mean_u"))
    at13 = rows.where(F.hour("forecast_ts") == 13).select("grid_id", "run_key", r6("gust").alias("gust"))
    return ST.outer_daily(daily, at13, ["grid_id", "run_key"]).select("grid_id", "run_key", "mean_u", "gust", "origin")


@query("hourly_json_payload", "S11", """
SELECT grid_id, count(*) AS rows, count(gust) AS non_null_rows, min(forecast_ts) AS first_timestamp, max(forecast_ts) AS last_timestamp, min(forecast_ts) FILTER (gust IS NOT NULL) AS first_non_null,
  max(forecast_ts) FILTER (gust IS NOT NULL) AS last_non_null, round(sum(gust) + 1e-7, 4) AS total FROM wx GROUP BY 1""")
def hourly_json_payload(v) -> DataFrame:
    packed = v.wx.groupBy("grid_id", "run_key").agg(F.sort_array(F.collect_list(F.struct(F.date_format("forecast_ts", "yyyy-MM-dd'T'HH:mm").alias("t"), F.col("gust").alias("g")))).alias("a"))
    docs = packed.select("grid_id", F.to_json(F.struct(F.struct(F.col("a.t").alias("time"), F.col("a.g").alias("gust")).alias("hourly")), {"ignoreNullFields": "false"}).alias("payload"))
    rows = PL.hourly_payload(docs, "payload", "gust", ["grid_id"])
    total = rows.groupBy("grid_id").agg(r6(F.sum("value"), 4).alias("total"))
    return PL.payload_census(rows, ["grid_id"]).join(total, "grid_id")


@query("national_grid_text", "S12", """
WITH k AS (SELECT l_orderkey // 12 AS doc, row_number() OVER (PARTITION BY l_orderkey // 12 ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity) - 1 AS i, l_quantity, l_partkey FROM lineitem),
v AS (SELECT doc, i // 12 AS part, i % 12 AS cell, CASE WHEN i % 12 > 1 AND l_partkey % 10 = 0 THEN -99.0 ELSE l_quantity END AS q FROM k)
SELECT doc, part, CAST(12 AS INTEGER) AS token_count, (doc + part) % 2 = 0 AS trailing_comma, CAST(count(*) FILTER (q <= -99) + 12 - greatest(count(*), 2) AS INTEGER) AS sentinels,
  max(q) FILTER (cell = 0) AS cell_a, coalesce(max(q) FILTER (cell = 1), 0) AS cell_b
FROM v GROUP BY 1, 2""")
def national_grid_text(v) -> DataFrame:
    """All line items of twelve orders as texts of twelve cells; the last text of a document is filled up with the sentinel."""
    li = v.table("lineitem").withColumn("doc", F.floor(F.col("l_orderkey") / 12))
    cells = F.sort_array(F.collect_list(F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")))
    docs = li.groupBy("doc").agg(cells.alias("c")).select("doc", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.size("c") - 1) / 12))).alias("part"))
    docs = docs.withColumn("c", F.slice("c", (F.col("part") * 12 + 1).cast("int"), 12))
    values = F.transform("c", lambda r, i: F.when((i >= 2) & (r["l_partkey"] % 10 == 0), F.lit("-99.0")).otherwise(r["l_quantity"].cast("string")))
    values = F.concat(values, F.when(F.size("c") == 1, F.array(F.lit("0.0"))).otherwise(F.array().cast("array<string>")))  # a selected cell needs a value
    filled = F.concat(values, F.array_repeat(F.lit("-99.0"), 12 - F.greatest(F.size("c"), F.lit(2))))
    docs = docs.withColumn("text", F.concat(F.array_join(filled, ", "), F.when((F.col("doc") + F.col("part")) % 2 == 0, ",\n").otherwise("")))
    return PL.grid_cells(docs, "text", {"cell_a": (1, 1), "cell_b": (2, 1)}, ["doc", "part"], columns=4, rows=3)


_IDX = """ix AS (SELECT l_orderkey AS obj, row_number() OVER w AS rec, CAST(sum(CAST(l_quantity AS BIGINT) + 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CAST(l_quantity AS BIGINT) - 1 AS BIGINT) AS off,
  CASE WHEN row_number() OVER w = 2 THEN 'UGRD' ELSE 'VAR' || l_partkey % 5 END AS var, (l_suppkey % 3 + 1) || ' mb' AS lev, l_quantity FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)),
sz AS (SELECT obj, CAST(sum(CAST(l_quantity AS BIGINT) + 1) AS BIGINT) AS size, count(*) AS n FROM ix GROUP BY 1)"""


def _indexes(v) -> DataFrame:
    li = v.table("lineitem").select(F.col("l_orderkey").alias("obj"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    packed = li.groupBy("obj").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("r"))
    width = lambda x: x["l_quantity"].cast("bigint") + 1
    packed = packed.withColumn("size", F.aggregate("r", F.lit(0).cast("bigint"), lambda a, x: a + width(x)))
    offset = lambda i: F.aggregate(F.slice("r", 1, i), F.lit(0).cast("bigint"), lambda a, x: a + width(x))
    lines = F.transform("r", lambda x, i: F.concat_ws(":", (i + 1).cast("string"), offset(i).cast("string"), F.lit("d=2024010112"),
                                                       F.when(i == 1, "UGRD").otherwise(F.concat(F.lit("VAR"), (x["l_partkey"] % 5).cast("string"))),
                                                       F.concat((x["l_suppkey"] % 3 + 1).cast("string"), F.lit(" mb")), F.lit("3 hour fcst"), F.lit("")))
    return packed.select("obj", "size", F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("text"))


@query("record_index_ranges", "S13", f"""
WITH {_IDX}
SELECT ix.obj, CAST(rec AS INTEGER) AS record, off AS byte_start, coalesce(lead(off) OVER (PARTITION BY ix.obj ORDER BY rec), size) - 1 AS byte_end, var AS variable, lev AS level, '3 hour fcst' AS descriptor, '2024010112' AS initialization, true AS range_valid
FROM ix JOIN sz ON sz.obj = ix.obj""")
def record_index_ranges(v) -> DataFrame:
    docs = _indexes(v)
    records = PL.byte_ranges(PL.index_records(docs, "text", ["obj", "size"]), "size")
    return records.select("obj", "record", "byte_start", "byte_end", "variable", "level", "descriptor", "initialization", "range_valid")


@query("unique_index_record", "S13", f"""
WITH {_IDX}, e AS (SELECT ix.*, size, n, coalesce(lead(off) OVER (PARTITION BY ix.obj ORDER BY rec), size) - 1 AS fin FROM ix JOIN sz ON sz.obj = ix.obj)
SELECT obj, CAST(rec AS INTEGER) AS record, off AS byte_start, fin AS byte_end, fin - off + 1 AS byte_count FROM e WHERE var = 'UGRD' AND lev = '1 mb'""")
def unique_index_record(v) -> DataFrame:
    records = PL.byte_ranges(PL.index_records(_indexes(v), "text", ["obj", "size"]), "size")
    holders = records.where((F.col("variable") == "UGRD") & (F.col("level") == "1 mb")).select("obj").distinct()
    out = PL.unique_record(records.join(holders, "obj", "left_semi"), ["obj"], "UGRD", "1 mb")
    return out.select("obj", "record", "byte_start", "byte_end", "byte_count")


_CENSUS = """dy AS (SELECT DISTINCT date_trunc('day', l_shipdate) AS day FROM lineitem),
ex AS (SELECT day, lead, product, 'run.' || strftime(day - INTERVAL 48 HOUR, '%Y%m%d') || '/00/' || product || '.f' || lpad(CAST(lead AS VARCHAR), 3, '0') AS object_key FROM dy, (SELECT unnest([39, 42, 45]) AS lead), (SELECT unnest(['mean', 'spread']) AS product)),
iv AS (SELECT date_trunc('day', l_shipdate) AS day, [39, 42, 45][l_partkey % 3 + 1] AS lead, ['mean', 'spread'][l_suppkey % 2 + 1] AS product FROM lineitem)"""


def _plan(v) -> tuple[DataFrame, DataFrame]:
    li = v.table("lineitem").withColumn("day", T.day_floor("l_shipdate"))
    expected = PL.expected_objects(li.select("day").distinct(), [39, 42, 45], ["mean", "spread"])
    pick = lambda values, i: F.element_at(F.array(*[F.lit(x) for x in values]), (i + 1).cast("int"))
    return expected, li.select("day", pick([39, 42, 45], F.col("l_partkey") % 3).alias("lead"), pick(["mean", "spread"], F.col("l_suppkey") % 2).alias("product"))


@query("object_census", "S21", f"""
WITH {_CENSUS}, h AS (SELECT DISTINCT day, lead, product FROM iv)
SELECT ex.day, count(*) AS expected, count(h.day) AS present, count(*) = count(h.day) AS complete FROM ex LEFT JOIN h ON h.day = ex.day AND h.lead = ex.lead AND h.product = ex.product GROUP BY 1""")
def object_census(v) -> DataFrame:
    return PL.census(*_plan(v), ["day", "lead", "product"])


@query("missing_objects", "S21", f"WITH {_CENSUS} SELECT day, lead, product, object_key FROM ex ANTI JOIN iv USING (day, lead, product)")
def missing_objects(v) -> DataFrame:
    return PL.missing_objects(*_plan(v), ["day", "lead", "product"]).select("day", "lead", "product", "object_key")


@query("run_schedule", "F31", """
WITH d AS (SELECT DISTINCT date_trunc('day', l_shipdate) AS day FROM lineitem), h AS (SELECT day, unnest(range(1, 25)) AS h FROM d),
x AS (SELECT day, day + (h - 9) * INTERVAL 1 HOUR AS valid_utc, day - INTERVAL 19 HOUR AS cutoff_utc, day - INTERVAL 36 HOUR AS init_utc FROM h)
SELECT *, date_diff('hour', init_utc, valid_utc) AS forecast_hour, 'gfs.' || strftime(init_utc, '%Y%m%d') || '/12/atmos/gfs.t12z.pgrb2.0p25.f' || lpad(CAST(date_diff('hour', init_utc, valid_utc) AS VARCHAR), 3, '0') AS object_key FROM x""")
def run_schedule(v) -> DataFrame:
    days = v.table("lineitem").select(T.day_floor("l_shipdate").alias("day")).distinct()
    return PL.run_schedule(days)


_MEMBERS = range(6)  # turbines of a farm


@query("wide_telemetry_unpivot", "S06 U01", f"""
WITH w AS (SELECT hour_end, slot, grp, {', '.join(f'max({c}) FILTER (turbine % 6 = {i}) AS {c}{i}' for i in _MEMBERS for c in ('power', 'ws'))} FROM scada10 GROUP BY 1, 2, 3)
{' UNION ALL '.join(f"SELECT hour_end, slot, grp, 't{i}' AS turbine, round(power{i} + 1e-9, 6) AS power, round(ws{i} + 1e-9, 6) AS ws FROM w" for i in _MEMBERS)}""")
def wide_telemetry_unpivot(v) -> DataFrame:
    """Wide rows of every farm, one column per member and channel, back to one row per member."""
    member = F.col("turbine") % 6
    wide = v.scada10.groupBy("hour_end", "slot", "grp").agg(*[F.max(F.when(member == i, F.col(c))).alias(f"m_t{i}_{c}") for i in _MEMBERS for c in ("power", "ws")])
    wide = wide.select(F.struct("hour_end", "slot", F.col("grp").alias("farm")).alias("key"), *[c for c in wide.columns if c.startswith("m_")])
    out = RD.telemetry_long(wide, "key", [("", f"t{i}", f"m_t{i}") for i in _MEMBERS], {"power": "_power", "ws": "_ws"})
    return out.select("key.hour_end", "key.slot", F.col("key.farm").alias("grp"), "turbine", r6("power").alias("power"), r6("ws").alias("ws"))


@query("label_and_template_checks", "S04 S05", """
WITH w AS (SELECT ts, max(actual) FILTER (grp = 'g1') AS g1, max(actual) FILTER (grp = 'g2') AS g2, max(actual) FILTER (grp = 'g3') AS g3 FROM gday GROUP BY 1), l AS (SELECT * FROM w WHERE ts < TIMESTAMP '2000-01-01'), t AS (SELECT * FROM w WHERE ts >= TIMESTAMP '2000-01-01')
SELECT (SELECT count(*) FROM l) AS rows, CAST(0 AS BIGINT) AS duplicate_hours, (SELECT count(*) FROM l WHERE least(coalesce(g1, 0), coalesce(g2, 0), coalesce(g3, 0)) < 0) AS negative_hours, CAST(0 AS BIGINT) AS non_finite,
  (SELECT min(ts) FROM l) AS first_ts, (SELECT max(ts) FROM l) AS last_ts, (SELECT max(ts) FROM l) AS label_end, (SELECT min(ts) FROM t) AS template_start, (SELECT count(*) FROM t) AS template_rows, CAST(0 AS BIGINT) AS duplicate_ids, true AS follows""")
def label_and_template_checks(v) -> DataFrame:
    wide = v.gday.groupBy("ts").agg(*[F.max(F.when(F.col("grp") == g, F.col("actual"))).alias(g) for g in ("g1", "g2", "g3")])
    split = F.lit("2000-01-01").cast("timestamp_ntz")
    labels = wide.where(F.col("ts") < split)
    template = wide.where(F.col("ts") >= split).select("ts", F.date_format("ts", "yyyyMMdd").alias("forecast_id"))
    checks = RD.label_checks(labels, "ts", ["g1", "g2", "g3"])
    return checks.join(F.broadcast(RD.template_follows(labels, template)))


@query("feature_cache_roundtrip", "S14 S07 S08 S09", """
SELECT grp, count(*) AS n, round(sum(base) + 1e-7, 4) AS base FROM fcst WHERE ts <= TIMESTAMP '1998-06-30' GROUP BY 1""")
def feature_cache_roundtrip(v) -> DataFrame:
    path = scratch_folder(v.spark, "cache")
    rows = v.fcst.select("grp", F.year("ts").alias("split"), "ts", "site", "actual", "base")
    SK.write_feature_cache(rows, path)
    back = RD.read_until(v.spark, path, "ts", "1998-06-30", "split").select("grp", "base")
    return back.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("base"), 4).alias("base"))


@query("feature_cache_summary", "S14", """
SELECT CAST(year(ts) AS INTEGER) AS split, grp, count(*) AS rows, 3 AS features, min(ts) AS first_ts, max(ts) AS last_ts FROM fcst GROUP BY 1, 2""")
def feature_cache_summary(v) -> DataFrame:
    return SK.cache_summary(v.fcst.select("grp", F.year("ts").alias("split"), "ts", "site", "actual", "base"))


@query("weather_csv_roundtrip", "S01 S15 S16", """
SELECT grid_id, count(*) AS n, round(sum(CAST(u AS FLOAT)) + 1e-5, 2) AS u, count(u) AS known FROM wx GROUP BY 1""")
def weather_csv_roundtrip(v) -> DataFrame:
    path = scratch_folder(v.spark, "weather")
    rows = v.wx.select("grid_id", F.lit("x").alias("unregistered"), "forecast_ts", "u")
    rows.write.option("header", True).csv(path)
    schema = RD.weather_schema(["u"])
    keep = type(schema)([f for f in schema.fields if f.name in ("forecast_ts", "grid_id", "u")])
    back = RD.read_csv(v.spark, path, keep)
    return back.groupBy(F.col("grid_id").cast("int").alias("grid_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("u") + 1e-5, 2).alias("u"), F.count("u").alias("known"))


@query("written_result_checks", "S15 S16 S17 E28", """
WITH w AS (SELECT ts, max(base) FILTER (grp = 'g1') AS g1, max(base) FILTER (grp = 'g2') AS g2, max(base) FILTER (grp = 'g3') AS g3 FROM gday GROUP BY 1 HAVING count(*) = 3)
SELECT count(*) AS rows, CAST(0 AS BIGINT) AS duplicate_keys, CAST(0 AS BIGINT) AS null_keys, CAST(0 AS BIGINT) AS non_finite, count(*) FILTER (least(g1, g2, g3) < 0) AS negative, CAST(0 AS BIGINT) AS key_differences, count(*) AS expected_rows,
  count(*) FILTER (least(g1, g2, g3) < 0) = 0 AS valid, CAST(0 AS BIGINT) AS differing_rows FROM w""")
def written_result_checks(v) -> DataFrame:
    wide = v.gday.groupBy("ts").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("grp") == g, F.col("base"))).alias(g) for g in ("g1", "g2", "g3")]).where(F.col("n") == 3)
    rows = wide.select(F.date_format("ts", "yyyyMMdd").alias("forecast_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("forecast_ts"), "g1", "g2", "g3")
    csv, parquet = scratch_folder(v.spark, "result"), scratch_folder(v.spark, "result")
    SK.write_csv(rows, csv, "forecast_id")
    SK.write_parquet(rows, parquet)
    differ = SK.verify_written(v.spark, parquet, rows).unionByName(SK.verify_written(v.spark, csv, rows, "csv")).agg(F.count(F.lit(1)).alias("differing_rows"))
    contract = SK.output_contract(v.spark, csv, rows, ["forecast_id", "forecast_ts", "g1", "g2", "g3"], ["g1", "g2", "g3"])
    return contract.join(F.broadcast(differ))


@query("experiment_log", "S20", """
SELECT grp AS experiment_id, 'completed' AS status, count(*) AS n, round(sum(base) + 1e-7, 4) AS dev_base FROM fcst GROUP BY 1""")
def experiment_log(v) -> DataFrame:
    path = scratch_folder(v.spark, "log")
    per = v.fcst.groupBy("grp").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("base").alias("b"))
    empty = F.create_map().cast("map<string,string>")
    records = per.select(
        F.lit(1).alias("schema_version"), F.col("grp").alias("experiment_id"), F.current_timestamp().alias("created_utc"), F.lit("completed").alias("status"), empty.alias("validation"),
        empty.alias("model"), F.create_map(F.lit("n"), F.col("n"), F.lit("base"), F.col("b")).alias("dev_metrics"), F.create_map().cast("map<string,double>").alias("leaderboard_metrics"),
        empty.alias("artifacts"), F.lit("").alias("notes"))
    for g in ("g1", "g2", "g3"):
        SK.append_experiments(records.where(F.col("experiment_id") == g), path)
    back = SK.read_experiments(v.spark, path)
    return back.select("experiment_id", "status", F.col("dev_metrics")["n"].cast("bigint").alias("n"), r6(F.col("dev_metrics")["base"], 4).alias("dev_base"))


@query("file_manifest", "S18")
def file_manifest(v) -> DataFrame:
    files = MF.describe_files(v.spark, [v.sf_dir], "*.parquet").withColumn("path", MF.file_name("path"))
    declared = files.select("path", "size_bytes", F.when(F.col("path") == "orders.parquet", F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256")).alias("sha256")).where(F.col("path") != "part.parquet")
    extra = declared.limit(1).select(F.lit("gone.parquet").alias("path"), "size_bytes", "sha256")
    return MF.verify_manifest(declared.unionByName(extra), files).select("path", "size_bytes", "sha256", "status")


@query("nested_manifest_registration", "S19", """
WITH f AS (SELECT 'f' || s_suppkey AS path, sha256(CAST(s_suppkey AS VARCHAR)) AS sha, s_suppkey AS k FROM supplier)
SELECT path, CASE WHEN k % 7 = 0 THEN 'FOUND_UNREGISTERED' WHEN k % 7 = 1 THEN 'FOUND_HASH_MISMATCH' ELSE 'FOUND_HASH_MATCH' END AS status, CASE WHEN k % 7 <> 0 THEN 'm' || (k % 3) END AS registered_by FROM f""")
def nested_manifest_registration(v) -> DataFrame:
    s = F.col("s_suppkey")
    files = v.table("supplier").select(F.concat(F.lit("f"), s.cast("string")).alias("path"), F.sha2(s.cast("string"), 256).alias("sha256"), (s * 10).alias("size_bytes"), s.alias("k"))
    entry = F.struct("path", F.upper(F.when(F.col("k") % 7 == 1, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256"))).alias("sha256"), F.when(F.col("k") % 2 == 0, F.col("size_bytes")).alias("bytes"))
    nested = F.struct(F.lit(1).alias("version"), F.struct(F.array(F.struct(entry.alias("file"), F.lit("x").alias("note"))).alias("items")).alias("outputs"))
    docs = files.where(F.col("k") % 7 != 0).select(F.concat(F.lit("m"), (F.col("k") % 3).cast("string")).alias("source"), F.to_json(nested).alias("text"))
    out = MF.classify(files.drop("k"), MF.declared_records(docs, "text", "source"))
    return out.select("path", "status", F.array_join("registered_by", ",").alias("registered_by"))
