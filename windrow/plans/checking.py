"""Integrity, cutoff, fold and provider queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.functions import timekeys as T
from windrow.functions.exprs import r6
from windrow.operators import checks as C
from windrow.operators import providers as R
from windrow.plans.digest import row_values, row_values_sql
from windrow.plans.registry import query

RAD = repr(math.pi / 180.0) + 'e0'

_LATE = """la AS (SELECT forecast_ts, grid_id, issued_ts + (grid_id % 4) * INTERVAL 1 HOUR AS available,
              date_trunc('day', forecast_ts - INTERVAL 1 HOUR) - INTERVAL 10 HOUR AS cutoff FROM wx)"""


def _late(v) -> DataFrame:
    return v.wx.select("forecast_ts", "grid_id", (F.timestamp_add("HOUR", F.col("grid_id") % 4, F.col("issued_ts"))).alias("available"))


@query("cutoff_violations", "P10", f"""
WITH {_LATE} SELECT grid_id, forecast_ts, available, available > cutoff AS late FROM la""")
def cutoff_violations(v) -> DataFrame:
    return _late(v).select("grid_id", "forecast_ts", "available", C.after_cutoff("forecast_ts", "available").alias("late"))


@query("cutoff_examples", "P10", f"""
WITH {_LATE} SELECT forecast_ts, available FROM la WHERE available > cutoff ORDER BY 1, 2 LIMIT 5""")
def cutoff_examples(v) -> DataFrame:
    return C.cutoff_examples(_late(v), "forecast_ts", "available")


# break the view in one place per rule: repeated rows, missing keys, a second issuance, a moved and a dropped cell
_BROKEN = """br AS (
  SELECT forecast_ts, CASE WHEN grid_id = 2 AND day(run_key) = 3 THEN issued_ts - INTERVAL 6 HOUR
                           WHEN grid_id = 0 AND day(run_key) = 9 THEN forecast_ts + INTERVAL 1 HOUR ELSE issued_ts END AS issued_ts,
         grid_id, CASE WHEN grid_id = 3 AND day(run_key) = 5 THEN NULL ELSE lat END AS lat,
         CASE WHEN grid_id = 4 THEN lon + 0.001 ELSE lon END AS lon
  FROM wx WHERE NOT (grid_id = 5 AND day(run_key) = 11)
  UNION ALL SELECT forecast_ts, issued_ts, grid_id, lat, lon FROM wx WHERE grid_id = 1 AND hour(forecast_ts) = 6)"""


def _broken(v) -> DataFrame:
    d, g = F.day("run_key"), F.col("grid_id")
    issued = (
        F.when((g == 2) & (d == 3), F.col("issued_ts") - T.hours(6))
        .when((g == 0) & (d == 9), F.col("forecast_ts") + T.hours(1)).otherwise(F.col("issued_ts"))
    )
    main = v.wx.where(~((g == 5) & (d == 11))).select(
        "forecast_ts", issued.alias("issued_ts"), "grid_id", F.when(~((g == 3) & (d == 5)), F.col("lat")).alias("lat"),
        F.when(g == 4, F.col("lon") + 0.001).otherwise(F.col("lon")).alias("lon"),
    )
    extra = v.wx.where((g == 1) & (F.hour("forecast_ts") == 6)).select("forecast_ts", "issued_ts", "grid_id", "lat", "lon")
    return main.unionByName(extra)


@query("grid_integrity", "P13 A52", f"""
WITH {_BROKEN},
pc AS (SELECT forecast_ts, grid_id, count(*) AS n, min(issued_ts) AS a, max(issued_ts) AS b FROM br GROUP BY 1, 2),
ph AS (SELECT forecast_ts, count(*) FILTER (n > 1) AS dup, count(*) AS grids, min(a) AS a, max(b) AS b FROM pc GROUP BY 1),
pg AS (SELECT grid_id, min(lat) AS la, max(lat) AS lb, min(lon) AS oa, max(lon) AS ob FROM br GROUP BY 1)
SELECT 'null_key' AS rule, count(*) FILTER (lat IS NULL OR forecast_ts IS NULL OR issued_ts IS NULL) AS n FROM br
UNION ALL SELECT 'negative_lead', count(*) FILTER (forecast_ts < issued_ts) FROM br
UNION ALL SELECT 'duplicate_key', CAST(coalesce(sum(dup), 0) AS BIGINT) FROM ph
UNION ALL SELECT 'several_issuances', count(*) FILTER (a <> b) FROM ph
UNION ALL SELECT 'incomplete_grid', count(*) FILTER (grids <> (SELECT count(*) FROM wx_cells)) FROM ph
UNION ALL SELECT 'several_coordinates', count(*) FILTER (la <> lb OR oa <> ob) FROM pg
UNION ALL SELECT 'changed_catalogue', count(*) FILTER (coalesce(abs(la - lat) > 1e-5, true) OR coalesce(abs(oa - lon) > 1e-5, true))
  FROM pg FULL JOIN wx_cells c ON c.grid_id = pg.grid_id""")
def grid_integrity(v) -> DataFrame:
    return C.grid_integrity(_broken(v), v.wx_cells)


@query("complete_runs", "P14", """
SELECT grid_id, date_trunc('day', forecast_ts - INTERVAL 1 HOUR) AS run_key, count(*) AS n_hours,
       count(DISTINCT forecast_ts) AS n_distinct, min(forecast_ts) AS first_ts, max(forecast_ts) AS last_ts,
       count(*) = 24 AND count(DISTINCT forecast_ts) = 24 AND max(forecast_ts) - min(forecast_ts) = INTERVAL 23 HOUR
         AND hour(min(forecast_ts)) = 1 AND hour(max(forecast_ts)) = 0 AS complete
FROM wx_obs GROUP BY 1, 2""")
def complete_runs(v) -> DataFrame:
    return C.complete_runs(v.wx_obs.withColumn("run_key", T.run_key("forecast_ts")), ["grid_id", "run_key"])


_PAIR = """WITH l AS (SELECT forecast_ts, grid_id FROM wx_obs WHERE grid_id <> 2),
r AS (SELECT forecast_ts, grid_id FROM wx WHERE hour(forecast_ts) <> 5)"""


@query("key_alignment_report", "P15 J02 U04 J16", f"""
{_PAIR},
c AS (SELECT forecast_ts, grid_id, sum(l) AS l, sum(r) AS r FROM (SELECT *, 1 AS l, 0 AS r FROM l UNION ALL SELECT *, 0, 1 FROM r) GROUP BY 1, 2)
SELECT count(*) FILTER (l > 0 AND r > 0) AS matched, count(*) FILTER (r = 0) AS left_only, count(*) FILTER (l = 0) AS right_only,
       count(*) FILTER (l > 1) AS left_duplicates, count(*) FILTER (r > 1) AS right_duplicates, false AS one_to_one FROM c""")
def key_alignment_report(v) -> DataFrame:
    left = v.wx_obs.where(F.col("grid_id") != 2)
    right = v.wx.where(F.hour("forecast_ts") != 5)
    return C.key_report(left, right, ["forecast_ts", "grid_id"])


@query("exact_one_to_one_join", "J01 J02", """
SELECT a.forecast_ts, a.grid_id, round(a.u - p.a_ws_d1 + 1e-9, 6) AS gap
FROM wx_obs a JOIN prov p ON p.ts = a.forecast_ts AND p.grid_id = a.grid_id""")
def exact_one_to_one_join(v) -> DataFrame:
    left = v.wx_obs.select("forecast_ts", "grid_id", "u")
    right = v.prov.select(F.col("ts").alias("forecast_ts"), "grid_id", "a_ws_d1")
    out = C.exact_one_to_one(left, right, ["forecast_ts", "grid_id"])
    return out.select("forecast_ts", "grid_id", r6(F.col("u") - F.col("a_ws_d1")).alias("gap"))


@query("differing_rows", "P15 S16", """
WITH l AS (SELECT forecast_ts, grid_id FROM wx_obs), r AS (SELECT forecast_ts, grid_id FROM wx WHERE hour(forecast_ts) <> 5)
SELECT *, 'left' AS side FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) UNION ALL SELECT *, 'right' FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)""")
def differing_rows(v) -> DataFrame:
    left, right = v.wx_obs.select("forecast_ts", "grid_id"), v.wx.where(F.hour("forecast_ts") != 5).select("forecast_ts", "grid_id")
    return C.differing_rows(left, right).select("forecast_ts", "grid_id", "side")


@query("period_key_sets", "J16 U04 U05", """
WITH a AS (SELECT DISTINCT run_key FROM wx WHERE day(run_key) <= 20), b AS (SELECT DISTINCT run_key FROM wx WHERE day(run_key) >= 11)
SELECT 'both' AS part, run_key FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'first_only', run_key FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'second_only', run_key FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def period_key_sets(v) -> DataFrame:
    keys = v.events.select(T.run_key(T.hour_floor("ts") + T.hours(1)).alias("run_key")).dropDuplicates(["run_key"])
    a, b = keys.where(F.day("run_key") <= 20), keys.where(F.day("run_key") >= 11)
    return (
        a.intersect(b).select(F.lit("both").alias("part"), "run_key")
        .unionByName(a.join(b, "run_key", "left_anti").select(F.lit("first_only").alias("part"), "run_key"))
        .unionByName(b.join(a, "run_key", "left_anti").select(F.lit("second_only").alias("part"), "run_key"))
    )


_FOLDS = [
    {"name": "y1997", "train_start": "1995-01-01", "train_end": "1997-01-01", "valid_start": "1997-01-01", "valid_end": "1998-01-01"},
    {"name": "y1998", "train_start": "1995-01-01", "train_end": "1998-01-01", "valid_start": "1998-01-01", "valid_end": "1999-01-01"},
    {"name": "y1999", "train_start": "1995-01-01", "train_end": "1999-01-01", "valid_start": "1999-01-01", "valid_end": "2000-01-01"},
]


@query("expanding_folds", "P07", f"""
WITH f(fold, ts1, te, vs, ve) AS (VALUES {', '.join(f"('{f['name']}', TIMESTAMP '{f['train_start']}', TIMESTAMP '{f['train_end']}', TIMESTAMP '{f['valid_start']}', TIMESTAMP '{f['valid_end']}')" for f in _FOLDS)})
SELECT fold, count(*) FILTER (ts >= ts1 AND ts < te) AS train_rows, count(*) FILTER (ts >= vs AND ts < ve) AS valid_rows,
       max(ts) FILTER (ts >= ts1 AND ts < te) AS train_end, min(ts) FILTER (ts >= vs AND ts < ve) AS valid_start, true AS leak_free
FROM fcst, f GROUP BY fold""")
def expanding_folds(v) -> DataFrame:
    return C.fold_report(C.fold_roles(v.fcst.select("ts"), _FOLDS, "ts"), "ts")


@query("strict_forward_guard", "P08 P09", """
WITH f AS (SELECT grp, site, ts FROM fcst WHERE ts < TIMESTAMP '1999-01-01'), a AS (SELECT grp, site, ts FROM fcst WHERE ts >= TIMESTAMP '1998-07-01')
SELECT (SELECT max(ts) FROM f) AS fit_end, (SELECT count(*) FROM f) AS fit_rows, (SELECT min(ts) FROM a) AS apply_start,
       (SELECT count(*) FROM a) AS apply_rows, (SELECT max(ts) FROM f) < (SELECT min(ts) FROM a) AS forward,
       (SELECT count(*) FROM a SEMI JOIN f USING (grp, site, ts)) AS overlap""")
def strict_forward_guard(v) -> DataFrame:
    fit = v.fcst.where(F.col("ts") < F.lit("1999-01-01").cast("timestamp_ntz"))
    app = v.fcst.where(F.col("ts") >= F.lit("1998-07-01").cast("timestamp_ntz"))
    overlap = C.overlapping_rows(fit, app, ["grp", "site", "ts"]).agg(F.count(F.lit(1)).alias("overlap"))
    return C.strict_forward(fit, app, "ts").join(F.broadcast(overlap))


_LEAD_BINS = [("lead_12_17", 12, 18), ("lead_18_23", 18, 24), ("lead_24_29", 24, 30), ("lead_30_35", 30, 36)]


@query("lead_partition", "P16", """
WITH x AS (SELECT grid_id, run_key, (hour(forecast_ts) + 23) % 24 + 12 AS lead FROM wx),
r AS (SELECT grid_id, run_key, CASE WHEN lead < 18 THEN 'lead_12_17' WHEN lead < 24 THEN 'lead_18_23' WHEN lead < 30 THEN 'lead_24_29' ELSE 'lead_30_35' END AS bin,
             count(*) AS n, min(lead) AS lo, max(lead) AS hi FROM x GROUP BY 1, 2, 3)
SELECT bin, CAST(sum(n) AS BIGINT) AS rows, count(*) AS runs, min(n) AS rows_per_run_min, max(n) AS rows_per_run_max,
       CAST(min(lo) AS BIGINT) AS lead_min, CAST(max(hi) AS BIGINT) AS lead_max, min(n) = 6 AND max(n) = 6 AS valid FROM r GROUP BY bin""")
def lead_partition(v) -> DataFrame:
    rows = v.wx.withColumn("lead", T.lead_hours("forecast_ts").cast("long"))
    return C.partition_report(rows, ["grid_id", "run_key"], "lead", _LEAD_BINS, 6)


@query("cutoff_evidence", "P11", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate + (l_partkey % 24) * INTERVAL 1 HOUR AS valid, 1 + l_linenumber % 2 AS off,
                  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE 'run' || l_suppkey END AS run_id,
                  CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_shipdate - (l_suppkey % 40) * INTERVAL 1 HOUR END AS issued,
                  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_shipdate - (l_suppkey % 37) * INTERVAL 1 HOUR END AS published,
                  l_quantity > 5 AS raw FROM lineitem),
y AS (SELECT *, date_trunc('day', valid) - INTERVAL 10 HOUR AS cutoff FROM x),
z AS (SELECT *, valid - off * INTERVAL 24 HOUR <= cutoff AS nominal_ok, issued <= cutoff AS io, published <= cutoff AS po,
             coalesce(run_id IS NOT NULL AND issued IS NOT NULL AND published IS NOT NULL AND raw AND issued <= cutoff AND published <= cutoff, false) AS proven FROM y)
SELECT CASE WHEN proven THEN 'complete' ELSE 'missing_or_failed:' || concat_ws(',', CASE WHEN run_id IS NULL THEN 'exact_run_identifier' END,
         CASE WHEN issued IS NULL THEN 'issue_time' END, CASE WHEN published IS NULL THEN 'publication_time' END,
         CASE WHEN NOT raw THEN 'immutable_raw_sha' END, CASE WHEN NOT io THEN 'issue_after_cutoff' END,
         CASE WHEN NOT po THEN 'publication_after_cutoff' END) END AS reason,
       proven, count(*) AS n, count(*) FILTER (nominal_ok) AS nominal_before FROM z GROUP BY 1, 2""")
def cutoff_evidence(v) -> DataFrame:
    li = v.table("lineitem")
    ship = F.col("l_shipdate").cast("timestamp_ntz")
    rows = li.select(
        F.timestamp_add("HOUR", F.col("l_partkey") % 24, ship).alias("valid"), (1 + F.col("l_linenumber") % 2).alias("off"),
        F.when(F.col("l_partkey") % 11 != 0, F.concat(F.lit("run"), F.col("l_suppkey").cast("string"))).alias("run_id"),
        F.when(F.col("l_partkey") % 7 != 0, F.timestamp_add("HOUR", -(F.col("l_suppkey") % 40), ship)).alias("issued"),
        F.when(F.col("l_partkey") % 13 != 0, F.timestamp_add("HOUR", -(F.col("l_suppkey") % 37), ship)).alias("published"),
        (F.col("l_quantity") > 5).alias("raw"),
    )
    out = rows.select(*[c.alias(n) for n, c in C.cutoff_evidence("valid", "off", "run_id", "issued", "published", "raw").items()])
    return out.groupBy("reason", "proven").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("nominal_before_cutoff").cast("long")).alias("nominal_before"))


@query("publication_status", "P12", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 17 <> 0 AS seen, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_shipdate - (l_suppkey % 30) * INTERVAL 1 HOUR END AS modified,
                  l_shipdate - INTERVAL 10 HOUR AS cutoff, CASE WHEN l_linenumber = 3 THEN 'bad' ELSE sha256(CAST(l_partkey AS VARCHAR)) END AS sha,
                  CAST(l_quantity AS BIGINT) % 9 AS size, l_linestatus = 'O' AS fits FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN NOT seen THEN 'MISSING_RUN_ID' WHEN modified IS NULL THEN 'MISSING_PUBLICATION_EVIDENCE' WHEN modified > cutoff THEN 'AFTER_CUTOFF'
            WHEN NOT regexp_full_match(sha, '[0-9a-f]{64}') THEN 'MISSING_RAW' WHEN NOT (size > 0 AND fits) THEN 'FAIL' ELSE 'VERIFIED' END AS status FROM x""")
def publication_status(v) -> DataFrame:
    ship = F.col("l_shipdate").cast("timestamp_ntz")
    status = C.publication_status(
        F.col("l_partkey") % 17 != 0,
        F.when(F.col("l_partkey") % 5 != 0, F.timestamp_add("HOUR", -(F.col("l_suppkey") % 30), ship)), ship - T.hours(10),
        F.when(F.col("l_linenumber") == 3, "bad").otherwise(F.sha2(F.col("l_partkey").cast("string"), 256)),
        F.col("l_quantity").cast("long") % 9, F.col("l_linestatus") == "O",
    )
    return v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", status.alias("status"))


@query("prediction_contract", "P20 S17", """
WITH p AS (SELECT grp, site, ts, base, CASE WHEN site % 10 = 3 AND actual > 40 THEN NULL ELSE cand - 3 END AS cand FROM fcst
           UNION ALL SELECT grp, site, ts, base, cand FROM fcst WHERE site % 20 = 7 AND base > 45),
k AS (SELECT grp, site, ts, count(*) AS n, count(*) FILTER (cand IS NULL) AS bad, count(*) FILTER (base < 0 OR cand < 0) AS below FROM p GROUP BY 1, 2, 3)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (n > 1) AS duplicate_keys, CAST(0 AS BIGINT) AS null_keys,
       CAST(sum(bad) AS BIGINT) AS non_finite, CAST(sum(below) AS BIGINT) AS negative FROM k""")
def prediction_contract(v) -> DataFrame:
    main = v.fcst.select("grp", "site", "ts", "base", F.when(~((F.col("site") % 10 == 3) & (F.col("actual") > 40)), F.col("cand") - 3).alias("cand"))
    extra = v.fcst.where((F.col("site") % 20 == 7) & (F.col("base") > 45)).select("grp", "site", "ts", "base", "cand")
    return C.prediction_contract(main.unionByName(extra), ["grp", "site", "ts"], ["base", "cand"])


def _sel(name: str) -> tuple[str, str]:
    first = "hour(ts) BETWEEN 1 AND 13"
    return (f"CASE WHEN {first} THEN {name}_ws_d1 ELSE {name}_ws_d2 END", f"CASE WHEN {first} THEN {name}_wd_d1 ELSE {name}_wd_d2 END")


def _joint_cte() -> tuple[str, list[str]]:
    cols = []
    for n in "abc":
        ws, wd = _sel(n)
        cols += [f"{ws} AS {n}w", f"{wd} AS {n}d"]
    uv = ", ".join(f"-{n}w * sin({n}d * {RAD}) AS {n}u, -{n}w * cos({n}d * {RAD}) AS {n}v" for n in "abc")
    mid = "0.5 * (bu + 1.2 * bu) AS iu, 0.5 * (bv + 1.2 * bv) AS iv, 1.2 * bw - bw AS ish, cw - 0.9 * cw AS gsh"
    trip = {"ws": ("aw", "iw", "cw"), "u": ("au", "iu", "cu"), "v": ("av", "iv", "cv")}
    out = {}
    for p, i in (("first", 0), ("middle", 1), ("last", 2)):
        out.update({f"{p}_{k}100": t[i] for k, t in trip.items()})
    m = {k: f"(({' + '.join(t)}) / 3.0)" for k, t in trip.items()}
    sd = {k: "sqrt((" + " + ".join(f"pow({c} - {m[k]}, 2)" for c in t) + ") / 3.0)" for k, t in trip.items()}
    for k, t in trip.items():
        out[f"{k}100_mean"], out[f"{k}100_std"] = m[k], sd[k]
        out[f"{k}100_range"] = f"greatest({', '.join(t)}) - least({', '.join(t)})"
    vec = f"sqrt({m['u']} * {m['u']} + {m['v']} * {m['v']})"
    out["consensus_vector_speed"], out["directional_coherence"] = vec, f"{vec} / greatest({m['ws']}, 0.05)"
    for n, (a, b) in {"first_middle": ("a", "i"), "first_last": ("a", "c"), "middle_last": ("i", "c")}.items():
        out[f"distance_{n}"] = f"sqrt(pow({a}u - {b}u, 2) + pow({a}v - {b}v, 2))"
    for n, c in (("first", "aw"), ("middle", "iw"), ("last", "cw"), ("mean", m["ws"])):
        out[f"{n}_minus_hub_ws"] = f"{c} - hub"
    out["spread_to_mean_ratio"] = f"{sd['ws']} / greatest({m['ws']}, 0.05)"
    out["vertical_shear_mean"], out["vertical_shear_abs_disagreement"] = "0.5 * (ish + gsh)", "abs(ish - gsh)"
    cte = f"""j0 AS (SELECT p.grid_id, p.ts, o.gust AS hub, {', '.join(cols)} FROM prov p JOIN wx_obs o ON o.forecast_ts = p.ts AND o.grid_id = p.grid_id),
j1 AS (SELECT *, {uv} FROM j0), j2 AS (SELECT *, {mid} FROM j1), j3 AS (SELECT *, sqrt(iu * iu + iv * iv) AS iw FROM j2),
j4 AS (SELECT grid_id, ts, {', '.join(f'{e} AS {n}' for n, e in out.items())} FROM j3)"""
    return cte, list(out)


_JOINT, _JOINT_NAMES = _joint_cte()


@query("joint_provider_features", "J04 F13 F12 P19", f"""
WITH {_JOINT} {row_values_sql('j4', ['grid_id', 'ts'], _JOINT_NAMES)}""")
def joint_provider_features(v) -> DataFrame:
    keys = ["grid_id", "ts"]
    sources = {n: v.prov.select(*keys, *[f"{n}_{c}_{d}" for c in ("ws", "wd") for d in ("d1", "d2")]) for n in "abc"}
    sources["hub"] = v.wx_obs.select("grid_id", F.col("forecast_ts").alias("ts"), F.col("gust").alias("hub"))
    rows = R.join_sources(sources, keys)
    wind = {n: R.selected_wind("ts", n) for n in "abc"}
    upper = tuple(1.2 * c for c in wind["b"])
    features = R.joint_features(wind["a"], wind["b"], upper, 0.9 * wind["c"][0], wind["c"], "hub")
    rows = rows.select("grid_id", "ts", *[c.alias(n) for n, c in features.items()])
    return row_values(rows, ["grid_id", "ts"], _JOINT_NAMES)


@query("provider_revision_features", "F14 P19", f"""
WITH x AS (SELECT p.grid_id, p.ts, o.gust, o.u, o.v, o.u50, o.v50, {_sel('a')[0]} AS w, {_sel('a')[1]} AS d
           FROM prov p JOIN wx_obs o ON o.forecast_ts = p.ts AND o.grid_id = p.grid_id),
y AS (SELECT grid_id, ts AS forecast_ts, w AS rev_ws, -w * sin(d * {RAD}) AS rev_u, -w * cos(d * {RAD}) AS rev_v, w - gust AS rev_ws_minus_hub,
             sqrt(u * u + v * v) AS ens_ws_low, sqrt(u * u + v * v) - gust AS ens_ws_low_minus_hub, sqrt(u50 * u50 + v50 * v50) AS ens_ws_high,
             sqrt(u50 * u50 + v50 * v50) - sqrt(pow(w * sin(d * {RAD}), 2) + pow(w * cos(d * {RAD}), 2)) AS ens_ws_high_minus_control FROM x)
{row_values_sql('y', ['grid_id', 'forecast_ts'], ['rev_ws', 'rev_u', 'rev_v', 'rev_ws_minus_hub', 'ens_ws_low', 'ens_ws_low_minus_hub', 'ens_ws_high', 'ens_ws_high_minus_control'])}""")
def provider_revision_features(v) -> DataFrame:
    rows = v.prov.withColumnRenamed("ts", "forecast_ts").join(v.wx_obs, ["forecast_ts", "grid_id"])
    ws, u, w = R.selected_wind("forecast_ts", "a")
    features = {**R.revision_features(ws, u, w, "gust"), **R.ensemble_disagreement("u", "v", "u50", "v50", "gust", u, w)}
    rows = rows.select("grid_id", "forecast_ts", *[c.alias(n) for n, c in features.items()])
    return row_values(rows, ["grid_id", "forecast_ts"], list(features))


@query("agreement_gate", "F23", """
WITH x AS (SELECT ts, grid_id, (a_ws_d1 - 10) / 20 AS j, (b_ws_d1 - 9.5) / 19 AS s1, (c_ws_d1 - 11.5) / 23 AS s2, (a_ws_d2 - 10.5) / 21 AS s3 FROM prov),
y AS (SELECT *, CASE WHEN sign(j) <> 0 THEN (sign(s1) = sign(j))::INT + (sign(s2) = sign(j))::INT + (sign(s3) = sign(j))::INT ELSE 0 END AS votes,
             list_sort([abs(s1), abs(s2), abs(s3)])[2] AS med FROM x),
z AS (SELECT *, CASE WHEN votes >= 2 THEN votes / 3.0 ELSE 0 END * CASE WHEN j = 0 THEN 0 ELSE least(1, med / abs(j)) END AS confidence FROM y)
SELECT ts, grid_id, CAST(votes AS INTEGER) AS agreement, round(confidence + 1e-9, 6) AS confidence, round(j * confidence + 1e-9, 6) + 0 AS gated FROM z""")
def agreement_gate(v) -> DataFrame:
    rows = v.prov.select("ts", "grid_id", ((F.col("a_ws_d1") - 10) / 20).alias("j"), ((F.col("b_ws_d1") - 9.5) / 19).alias("s1"),
                         ((F.col("c_ws_d1") - 11.5) / 23).alias("s2"), ((F.col("a_ws_d2") - 10.5) / 21).alias("s3"))
    out = rows.withColumns(R.agreement_gate("j", ["s1", "s2", "s3"]))
    return out.select("ts", "grid_id", "agreement", r6("confidence").alias("confidence"), r6("gated").alias("gated"))
