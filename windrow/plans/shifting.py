"""Profile, drift, stability and regression-diagnostic queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.functions import timekeys as T
from windrow.functions.exprs import r6, rounded
from windrow.operators import drift as R
from windrow.operators import telemetry as M
from windrow.plans.digest import row_values, row_values_sql
from windrow.plans.registry import query

_CH = ["u", "gust", "t2"]
_Q = [f"q{int(q * 100):02d}" for q in R.PROFILE_QUANTILES]
_LONG = f"""lw AS (SELECT forecast_ts, run_key, issued_ts, grid_id, day(run_key) <= 15 AS ref, unnest({_CH}) AS variable, unnest([u, gust, t2]) AS value FROM wx)"""


@query("annual_column_profile", "A26 W10 A52", f"""
WITH {_LONG},
l AS (SELECT *, lag(value) OVER (PARTITION BY grid_id, ref, variable ORDER BY forecast_ts) AS before FROM lw)
SELECT variable, grid_id, ref AS period, count(*) AS rows, count(*) FILTER (value IS NULL) AS missing_count, round(count(*) FILTER (value IS NULL) / CAST(count(*) AS DOUBLE) + 1e-9, 6) AS missing_fraction,
       count(DISTINCT value) AS finite_unique, round(avg(value) + 1e-9, 6) AS mean, round(stddev_pop(value) + 1e-9, 6) AS std,
       {', '.join(f'round(quantile_cont(value, {q}) + 1e-9, 6) AS {n}' for q, n in zip(R.PROFILE_QUANTILES, _Q))},
       round(coalesce(count(*) FILTER (value = before), 0) / CAST(count(*) - 1 AS DOUBLE) + 1e-9, 6) AS consecutive_equal_fraction, coalesce(min(value) = max(value), false) AS constant
FROM l GROUP BY 1, 2, 3""")
def annual_column_profile(v) -> DataFrame:
    out = R.annual_profile(v.wx.withColumn("period", F.day("run_key") <= 15), _CH, ["grid_id", "period"], "forecast_ts")
    return out.select("variable", "grid_id", "period", "rows", "missing_count", r6("missing_fraction").alias("missing_fraction"), "finite_unique",
                      *[r6(c).alias(c) for c in ("mean", "std", *_Q, "consecutive_equal_fraction")], "constant")


def _drift_cte(prefix: str, ref: str, app: str) -> str:
    p = prefix
    return f"""{p}r AS (SELECT variable, grid_id, value, {ref} AS ref, month(run_key) AS m, (day(run_key) - 1) % 10 AS d, hour(forecast_ts) AS h FROM lw WHERE {ref} OR {app}),
{p}w AS (SELECT variable, grid_id, count(*) FILTER (ref) AS nr, count(*) FILTER (NOT ref) AS na, avg(value) FILTER (ref) AS mr, avg(value) FILTER (NOT ref) AS ma, stddev_pop(value) FILTER (ref) AS sr,
   stddev_pop(value) FILTER (NOT ref) AS sa, quantile_cont(value, {[0.01 + 0.98 * i / 98 for i in range(99)]}) FILTER (ref) AS qr, quantile_cont(value, {[0.01 + 0.98 * i / 98 for i in range(99)]}) FILTER (NOT ref) AS qa,
   avg((value IS NULL)::INT) FILTER (ref) AS xr, avg((value IS NULL)::INT) FILTER (NOT ref) AS xa FROM {p}r GROUP BY 1, 2),
{p}s AS (SELECT variable, grid_id, avg(abs(a - r)) AS sz, max(abs(a - r)) AS sx FROM (SELECT variable, grid_id, m, h, avg(value) FILTER (ref) AS r, avg(value) FILTER (NOT ref) AS a FROM {p}r GROUP BY 1, 2, 3, 4) WHERE r IS NOT NULL AND a IS NOT NULL GROUP BY 1, 2),
{p}d AS (SELECT variable, grid_id, quantile_cont(abs(a - r), 0.5) AS d5, quantile_cont(abs(a - r), 0.95) AS d95, count(*) AS cells FROM (SELECT variable, grid_id, m, d, h, quantile_cont(value, 0.5) FILTER (ref) AS r, quantile_cont(value, 0.5) FILTER (NOT ref) AS a
   FROM {p}r GROUP BY 1, 2, 3, 4, 5) WHERE r IS NOT NULL AND a IS NOT NULL GROUP BY 1, 2),
{p} AS (SELECT w.variable, w.grid_id, nr AS reference_rows, na AS application_rows, (ma - mr) / sr AS mean_shift, sa / sr AS std_ratio, xa - xr AS missing_delta,
   list_sum(list_transform(range(1, 100), lambda i: abs(qa[i] - qr[i]))) / 99.0 / sr AS quantile_l1, sz / sr AS seasonal_abs_z_mean, sx / sr AS seasonal_abs_z_max, d5 / sr AS daily_abs_z_median, d95 / sr AS daily_abs_z_p95, cells AS daily_matched_cells
   FROM {p}w w JOIN {p}s s ON s.variable = w.variable AND s.grid_id = w.grid_id JOIN {p}d d ON d.variable = w.variable AND d.grid_id = w.grid_id)"""


_DRIFT = ["mean_shift", "std_ratio", "missing_delta", "quantile_l1", "seasonal_abs_z_mean", "seasonal_abs_z_max", "daily_abs_z_median", "daily_abs_z_p95"]
_B1, _B2, _B3 = "day(run_key) <= 10", "day(run_key) BETWEEN 11 AND 20", "day(run_key) > 20"


def _drift(v, ref, app) -> DataFrame:
    d = F.day("run_key")
    rows = v.wx.where(ref(d) | app(d))
    return R.pair_drift(rows, _CH, ["grid_id"], ref(d), F.month("run_key"), (d - 1) % 10, F.hour("forecast_ts"))


_FIRST, _SECOND, _THIRD = (lambda d: d <= 10), (lambda d: (d > 10) & (d <= 20)), (lambda d: d > 20)


@query("period_drift", "A27 J12", f"""
WITH {_LONG}, {_drift_cte('dr', '(' + _B1 + ' OR ' + _B2 + ')', _B3)}
SELECT variable, grid_id, reference_rows, application_rows, {', '.join(f'round({c} + 1e-9, 6) + 0 AS {c}' for c in _DRIFT)}, daily_matched_cells FROM dr""")
def period_drift(v) -> DataFrame:
    out = _drift(v, lambda d: d <= 20, _THIRD)
    return out.select("variable", "grid_id", "reference_rows", "application_rows", *[r6(c).alias(c) for c in _DRIFT], "daily_matched_cells")


_ALLDRIFT = f"""{_LONG}, {_drift_cte('dr', '(' + _B1 + ' OR ' + _B2 + ')', _B3)}, {_drift_cte('ca', _B1, _B2)},
fl AS (SELECT dr.*, dr.seasonal_abs_z_mean / greatest(ca.seasonal_abs_z_mean, 1e-12) AS seasonal_control_ratio, dr.daily_abs_z_p95 / greatest(ca.daily_abs_z_p95, 1e-12) AS daily_control_ratio
       FROM dr JOIN ca ON ca.variable = dr.variable AND ca.grid_id = dr.grid_id)"""


def _with_controls(v) -> DataFrame:
    return R.control_ratios(_drift(v, lambda d: d <= 20, _THIRD), [_drift(v, _FIRST, _SECOND)], ["variable", "grid_id"])


@query("drift_flags", "A28 A27", f"""
WITH {_ALLDRIFT}
SELECT variable, grid_id, round(seasonal_control_ratio + 1e-9, 6) AS seasonal_control_ratio, round(daily_control_ratio + 1e-9, 6) AS daily_control_ratio,
  abs(missing_delta) > 0.001 OR abs(mean_shift) > 0.75 OR ((quantile_l1 > 1e-9 OR abs(mean_shift) > 1e-9) AND (std_ratio < 0.5 OR std_ratio > 2)) OR (seasonal_abs_z_mean > 0.35 AND seasonal_control_ratio > 3)
  OR (daily_abs_z_p95 > 3.5 AND daily_control_ratio > 2) AS flagged FROM fl""")
def drift_flags(v) -> DataFrame:
    out = _with_controls(v).withColumn("flagged", R.drift_flag())
    return out.select("variable", "grid_id", r6("seasonal_control_ratio").alias("seasonal_control_ratio"), r6("daily_control_ratio").alias("daily_control_ratio"), "flagged")


@query("drift_top_rows", "A28 T01", f"""
WITH {_ALLDRIFT},
u AS (SELECT variable, grid_id, unnest(['mean_shift', 'quantile_l1', 'seasonal_abs_z_mean', 'daily_abs_z_p95', 'missing_delta']) AS metric, abs(unnest([mean_shift, quantile_l1, seasonal_abs_z_mean, daily_abs_z_p95, missing_delta])) AS value FROM fl),
k AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY round(value, 12) DESC, variable, grid_id) AS rank FROM u)
SELECT variable, grid_id, metric, round(value + 1e-9, 6) AS value, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 12""")
def drift_top_rows(v) -> DataFrame:
    out = R.top_per_metric(_with_controls(v), ["mean_shift", "quantile_l1", "seasonal_abs_z_mean", "daily_abs_z_p95", "missing_delta"], ["variable", "grid_id"])
    return out.select("variable", "grid_id", "metric", r6("value").alias("value"), "rank")


@query("run_alignment_report", "A29 P14", """
WITH h AS (SELECT forecast_ts, count(DISTINCT grid_id) AS g, count(DISTINCT issued_ts) AS i FROM wx GROUP BY 1),
r AS (SELECT issued_ts, count(*) AS size, min(date_diff('hour', issued_ts, forecast_ts)) AS a, max(date_diff('hour', issued_ts, forecast_ts)) AS b FROM (SELECT DISTINCT issued_ts, forecast_ts FROM wx) GROUP BY 1)
SELECT (SELECT count(*) FROM h) AS forecast_hours, (SELECT min(forecast_ts) FROM h) AS start, (SELECT max(forecast_ts) FROM h) AS "end", CAST(0 AS BIGINT) AS duplicate_rows, (SELECT min(g) FROM h) AS grid_count_min,
  (SELECT max(g) FROM h) AS grid_count_max, (SELECT max(i) FROM h) AS issues_per_hour_max, count(*) AS runs, min(size) AS run_size_min, max(size) AS run_size_max, min(a) AS lead_min, max(b) AS lead_max, bool_and(size = 24 AND a = 12 AND b = 35) AS all_runs_exact FROM r""")
def run_alignment_report(v) -> DataFrame:
    return R.run_alignment(v.wx)


@query("duplicate_node_vectors", "A29", """
WITH p AS (SELECT forecast_ts, round(u) AS u, round(v) AS v, count(*) AS n FROM wx GROUP BY 1, 2, 3),
h AS (SELECT forecast_ts, count(*) AS un, sum(n) AS n, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS rep FROM p GROUP BY 1)
SELECT CAST(sum(rep) AS BIGINT) AS repeated_rows, round(sum(rep) / CAST(sum(n) AS DOUBLE) + 1e-9, 6) AS repeated_fraction, min(un) AS unique_min, max(un) AS unique_max FROM h""")
def duplicate_node_vectors(v) -> DataFrame:
    out = R.duplicate_vectors(v.wx.select("forecast_ts", F.round("u").alias("u"), F.round("v").alias("v")), ["u", "v"])
    return out.select("repeated_rows", r6("repeated_fraction").alias("repeated_fraction"), "unique_min", "unique_max")


@query("missing_event_report", "A29 A08", """
SELECT forecast_ts, count(*) FILTER (u IS NULL OR t2 IS NULL) AS grid_rows_affected, count(*) FILTER (u IS NULL) AS u_missing, count(*) FILTER (t2 IS NULL) AS t2_missing FROM wx GROUP BY 1 HAVING count(*) FILTER (u IS NULL OR t2 IS NULL) > 0""")
def missing_event_report(v) -> DataFrame:
    return R.missing_events(v.wx, ["u", "t2"])


_FEAT = ["u", "v", "gust", "t2", "d2", "sp", "grid_id"]
_WAS = f"""lf AS (SELECT day(forecast_ts) <= 15 AS src, unnest({_FEAT}) AS feature, unnest([u, v, gust, t2, d2, sp, 1.0]) AS value FROM wx_obs),
sh AS (SELECT feature, count(*) FILTER (src) AS ns, count(*) FILTER (NOT src) AS na, stddev_pop(value) AS sd, quantile_cont(value, {[i / 256 for i in range(257)]}) FILTER (src) AS qs, quantile_cont(value, {[i / 256 for i in range(257)]}) FILTER (NOT src) AS qa FROM lf GROUP BY 1),
ws AS (SELECT feature, list_position({_FEAT}, feature) - 1 AS position, ns, na, sd, list_sum(list_transform(range(1, 258), lambda i: abs(qs[i] - qa[i]) * CASE WHEN i IN (1, 257) THEN 0.5 ELSE 1 END)) / 256.0 AS num FROM sh)"""


def _sides(v) -> tuple[DataFrame, DataFrame]:
    rows = v.wx_obs.withColumn("grid_id", F.lit(1.0))
    return rows.where(F.day("forecast_ts") <= 15), rows.where(F.day("forecast_ts") > 15)


@query("wasserstein_shift", "A30", f"""
WITH {_WAS} SELECT feature, CAST(position AS INTEGER) AS position, ns AS source_rows, na AS application_rows, round(sd + 1e-9, 6) AS pooled_std, round(CASE WHEN sd > 1e-12 THEN num ELSE 0 END + 1e-9, 6) AS wasserstein_numerator,
round(CASE WHEN sd > 1e-12 THEN num / sd END + 1e-9, 6) AS shift_score, sd > 1e-12 AS rankable FROM ws""")
def wasserstein_shift(v) -> DataFrame:
    out = R.wasserstein_shift(*_sides(v), _FEAT)
    return out.select("feature", "position", "source_rows", "application_rows", r6("pooled_std").alias("pooled_std"), r6("wasserstein_numerator").alias("wasserstein_numerator"), r6("shift_score").alias("shift_score"), "rankable")


@query("least_shifted_features", "T02 P02 A30", f"""
WITH {_WAS}, k AS (SELECT feature, position, row_number() OVER (ORDER BY round(num / sd, 12), position) AS rank, count(*) OVER () AS n FROM ws WHERE sd > 1e-12)
SELECT feature, CAST(position AS INTEGER) AS position, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= greatest(floor(0.5 * n), 1)""")
def least_shifted_features(v) -> DataFrame:
    return R.least_shifted(R.wasserstein_shift(*_sides(v), _FEAT), 0.5).select("feature", "position", "rank")


@query("population_stability_index", "A31", """
WITH r AS (SELECT grid_id, gust AS value, day(forecast_ts) <= 15 AS ref FROM wx_obs),
e AS (SELECT grid_id, list_sort(list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS e FROM r WHERE ref GROUP BY 1),
b AS (SELECT r.grid_id, ref, len(list_filter(e.e, lambda x: x <= value)) AS bin, len(e.e) + 1 AS k FROM r JOIN e ON e.grid_id = r.grid_id),
a AS (SELECT grid_id, k, unnest(range(0, k)) AS bin FROM (SELECT DISTINCT grid_id, k FROM b)),
c AS (SELECT a.grid_id, a.k, a.bin, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM a LEFT JOIN b ON b.grid_id = a.grid_id AND b.bin = a.bin GROUP BY 1, 2, 3),
s AS (SELECT *, (r + 0.5) / (sum(r) OVER g + 0.5 * k) AS p, (c + 0.5) / (sum(c) OVER g + 0.5 * k) AS q FROM c WINDOW g AS (PARTITION BY grid_id))
SELECT grid_id, any_value(k) AS bins, CAST(sum(r) AS BIGINT) AS reference_rows, CAST(sum(c) AS BIGINT) AS comparison_rows, round(sum((q - p) * ln(q / p)) + 1e-9, 6) AS psi, sum((q - p) * ln(q / p)) < 0.5 AS passes FROM s GROUP BY 1""")
def population_stability_index(v) -> DataFrame:
    out = R.stability_index(v.wx_obs, ["grid_id"], "gust", F.day("forecast_ts") <= 15)
    return out.select("grid_id", F.col("bins").cast("long").alias("bins"), "reference_rows", "comparison_rows", r6("psi").alias("psi"), "passes")


@query("iqr_stability", "A32", """
WITH r AS (SELECT l_suppkey % 50 AS unit, month(l_shipdate) AS month, year(l_shipdate) AS y, l_extendedprice * CASE WHEN l_suppkey % 50 = 7 AND year(l_shipdate) = 1997 THEN 0 ELSE 1 END AS v FROM lineitem WHERE year(l_shipdate) IN (1996, 1997)),
q AS (SELECT unit, month, y, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM r GROUP BY 1, 2, 3),
p AS (SELECT unit, month, max(iqr) FILTER (y = 1996) AS a, max(iqr) FILTER (y = 1997) AS b FROM q GROUP BY 1, 2)
SELECT unit, CAST(month AS INTEGER) AS month, round(a + 1e-7, 4) AS iqr_first, round(b + 1e-7, 4) AS iqr_second, CASE WHEN a > 1e-12 AND b > 1e-12 THEN round(b / a + 1e-9, 6) END AS ratio,
  CASE WHEN a <= 1e-12 AND b <= 1e-12 THEN 'both periods constant' WHEN a <= 1e-12 THEN 'first period constant' WHEN b <= 1e-12 THEN 'second period constant' END AS reason,
  coalesce(a > 1e-12 AND b > 1e-12 AND b / a > 0.1 AND b / a < 10, false) AS passes FROM p""")
def iqr_stability(v) -> DataFrame:
    y, unit = F.year("l_shipdate"), F.col("l_suppkey") % 50
    rows = v.table("lineitem").where(y.isin(1996, 1997)).select(
        unit.alias("unit"), F.month("l_shipdate").alias("month"), y.alias("y"), (F.col("l_extendedprice") * F.when((unit == 7) & (y == 1997), 0).otherwise(1)).alias("v"))
    out = R.iqr_stability(rows, ["unit", "month"], "v", "y", 1996, 1997)
    return out.select("unit", "month", r6("iqr_first", 4).alias("iqr_first"), r6("iqr_second", 4).alias("iqr_second"), r6("ratio").alias("ratio"), "reason", "passes")


@query("regression_cell_metrics", "A33", """
WITH q AS (SELECT site, greatest(quantile_cont(actual, 0.95) - quantile_cont(actual, 0.05), 1e-9) AS den FROM fcst GROUP BY 1),
m AS (SELECT f.*, den, avg(actual) OVER (PARTITION BY f.site, year(ts)) AS mean FROM fcst f JOIN q ON q.site = f.site),
g AS (SELECT site, CAST(year(ts) AS INTEGER) AS year, count(*) AS rows, count(DISTINCT actual) AS u, sum(pow(actual - mean, 2)) AS sst, sum(pow(actual - base, 2)) AS sse, any_value(den) AS den FROM m GROUP BY 1, 2)
SELECT site, year, rows, CASE WHEN u < 3 THEN 'fewer than 3 distinct values' WHEN sst <= 1e-12 THEN 'no variance' END AS invalid_reason, CASE WHEN u >= 3 AND sst > 1e-12 THEN round(sqrt(sse / rows) + 1e-9, 6) END AS rmse,
  CASE WHEN u >= 3 AND sst > 1e-12 THEN round(1 - sse / sst + 1e-9, 6) END AS r2, CASE WHEN u >= 3 AND sst > 1e-12 THEN round(sqrt(sse / rows) / den + 1e-9, 6) END AS nrmse FROM g""")
def regression_cell_metrics(v) -> DataFrame:
    rows = v.fcst.withColumn("year", F.year("ts")).join(R.nrmse_denominators(v.fcst, ["site"], "actual"), "site")
    out = R.regression_metrics(rows, ["site", "year"], "actual", "base", "denominator")
    return out.select("site", "year", "rows", "invalid_reason", r6("rmse").alias("rmse"), r6("r2").alias("r2"), r6("nrmse").alias("nrmse"))


@query("affine_fit", "A34", """
SELECT site, count(*) AS train_rows, round(CASE WHEN regr_sxx(actual, x) <= 1e-12 THEN 0 ELSE regr_slope(actual, x) END + 1e-9, 6) AS slope, regr_sxx(actual, x) <= 1e-12 AS constant_predictor,
  round(CASE WHEN regr_sxx(actual, x) <= 1e-12 THEN avg(actual) ELSE regr_intercept(actual, x) END + 1e-9, 6) AS intercept FROM (SELECT site, actual, CASE WHEN site % 25 = 3 THEN 7.0 ELSE base END AS x FROM fcst) GROUP BY 1""")
def affine_fit(v) -> DataFrame:
    out = R.affine_fit(v.fcst.withColumn("x", F.when(F.col("site") % 25 == 3, 7.0).otherwise(F.col("base"))), ["site"], "x", "actual")
    return out.select("site", "train_rows", r6("slope").alias("slope"), "constant_predictor", r6("intercept").alias("intercept"))


_XFIT = """xf AS (SELECT *, day(ts) % 4 AS fold FROM fcst), kk AS (SELECT unnest([0, 1, 2, 3]) AS fold),
ln AS (SELECT grp, kk.fold, regr_slope(actual, base) AS a, regr_intercept(actual, base) AS b FROM xf JOIN kk ON kk.fold <> xf.fold GROUP BY 1, 2),
oo AS (SELECT xf.*, a * base + b AS oof FROM xf JOIN ln ON ln.grp = xf.grp AND ln.fold = xf.fold)"""


@query("affine_crossfit", "A34 M23", f"""
WITH {_XFIT} {row_values_sql('oo', ['grp', 'site', 'ts'], ['oof'])}""")
def affine_crossfit(v) -> DataFrame:
    out = R.affine_crossfit(v.fcst.withColumn("fold", F.day("ts") % 4), ["grp"], "fold", [0, 1, 2, 3], "base", "actual")
    return row_values(out, ["grp", "site", "ts"], ["oof"])


@query("redundancy_stability_gate", "M23 A33", f"""
WITH {_XFIT}, den AS (SELECT grp, greatest(quantile_cont(actual, 0.95) - quantile_cont(actual, 0.05), 1e-9) AS den FROM xf GROUP BY 1),
c AS (SELECT oo.grp, den, actual, oof, unnest(['year', 'season', 'site']) AS kind, unnest([CAST(year(ts) AS VARCHAR), CAST(quarter(ts) AS VARCHAR), CAST(site AS VARCHAR)]) AS cell FROM oo JOIN den ON den.grp = oo.grp),
m AS (SELECT *, avg(actual) OVER (PARTITION BY grp, kind, cell) AS mean FROM c),
g AS (SELECT grp, kind, cell, count(*) AS n, sum(pow(actual - mean, 2)) AS sst, sum(pow(actual - oof, 2)) AS sse, any_value(den) AS den FROM m GROUP BY 1, 2, 3),
s AS (SELECT *, n >= 48 AND (1 - sse / sst < 0.995 OR sqrt(sse / n) / den > 0.02) AS strict, n >= 48 AND sqrt(sse / n) / den > 0.01 AS weak FROM g),
k AS (SELECT grp, kind, count(*) AS cells, count(*) FILTER (strict) AS st, count(*) FILTER (NOT strict AND weak) AS wo FROM s GROUP BY 1, 2),
p AS (SELECT *, cells - st <= CASE WHEN kind = 'season' THEN 1 ELSE 0 END AND wo = cells - st AS ok FROM k)
SELECT grp, coalesce(string_agg(kind, ',' ORDER BY kind) FILTER (NOT ok), '') AS failed_kinds, bool_and(ok) AS stable FROM p GROUP BY 1""")
def redundancy_stability_gate(v) -> DataFrame:
    oof = R.affine_crossfit(v.fcst.withColumn("fold", F.day("ts") % 4), ["grp"], "fold", [0, 1, 2, 3], "base", "actual")
    rows = oof.join(R.nrmse_denominators(v.fcst, ["grp"], "actual"), "grp")
    cells = rows.select("grp", "denominator", "actual", "oof", F.inline(F.array(
        F.struct(F.lit("year").alias("kind"), F.year("ts").cast("string").alias("cell")), F.struct(F.lit("season").alias("kind"), F.quarter("ts").cast("string").alias("cell")),
        F.struct(F.lit("site").alias("kind"), F.col("site").cast("string").alias("cell")))))
    strength = R.cell_strength(R.regression_metrics(cells, ["grp", "kind", "cell"], "actual", "oof", "denominator"))
    out = R.stability_gate(strength, ["grp"], allowed={"season": 1})
    return out.select("grp", F.concat_ws(",", "failed_kinds").alias("failed_kinds"), "stable")


@query("quantile_map", "F26", f"""
WITH a AS (SELECT forecast_ts, grid_id, gust FROM wx_obs WHERE day(forecast_ts) > 15), r AS (SELECT gust FROM wx_obs WHERE day(forecast_ts) <= 15),
qa AS (SELECT unnest(quantile_cont(gust, {[i / 100 for i in range(101)]})) AS x, unnest(range(0, 101)) AS i FROM a), qr AS (SELECT unnest(quantile_cont(gust, {[i / 100 for i in range(101)]})) AS y, unnest(range(0, 101)) AS i FROM r),
kn AS (SELECT x, avg(i) AS a_t FROM qa GROUP BY 1),
kk AS (SELECT x, l.y + (a_t - floor(a_t + 1e-9)) * (h.y - l.y) AS y FROM kn JOIN qr l ON l.i = least(floor(a_t + 1e-9), 100) JOIN qr h ON h.i = least(floor(a_t + 1e-9) + 1, 100)),
sg AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM kk)
SELECT forecast_ts, grid_id, round(CASE WHEN x1 IS NULL THEN y0 ELSE y0 + (gust - x0) / (x1 - x0) * (y1 - y0) END + 1e-9, 6) AS mapped FROM a JOIN sg ON gust >= x0 AND (gust < x1 OR x1 IS NULL)""")
def quantile_map(v) -> DataFrame:
    rows = v.wx_obs.select("forecast_ts", "grid_id", "gust")
    out = R.quantile_map(rows.where(F.day("forecast_ts") <= 15), rows.where(F.day("forecast_ts") > 15), "gust")
    return rounded(out, ["forecast_ts", "grid_id"], ["mapped"])


@query("shift_hedge", "F27", """
WITH m AS (SELECT median(u) FILTER (day(forecast_ts) <= 15) AS ru, median(u) FILTER (day(forecast_ts) > 15) AS au, median(gust) FILTER (day(forecast_ts) <= 15) AS rg, median(gust) FILTER (day(forecast_ts) > 15) AS ag FROM wx_obs)
SELECT forecast_ts, grid_id, round(u / sqrt(least(greatest(au / ru, 0.9), 1.1)) + 1e-9, 6) AS u, round(gust / sqrt(least(greatest(ag / rg, 0.9), 1.1)) + 1e-9, 6) AS gust FROM wx_obs, m WHERE day(forecast_ts) > 15""")
def shift_hedge(v) -> DataFrame:
    rows = v.wx_obs.select("forecast_ts", "grid_id", "u", "gust")
    return rounded(R.shift_hedge(rows.where(F.day("forecast_ts") <= 15), rows.where(F.day("forecast_ts") > 15), ["u", "gust"]), ["forecast_ts", "grid_id"], ["u", "gust"])


@query("column_coverage", "A51", """
WITH l AS (SELECT grid_id, forecast_ts, unnest(['u', 'gust']) AS variable, unnest([u, gust]) AS value FROM wx)
SELECT grid_id, variable, count(*) AS expected_rows, count(value) AS non_null_rows, count(*) - count(value) AS missing_rows, round((count(*) - count(value)) / CAST(count(*) AS DOUBLE) + 1e-9, 6) AS missing_fraction,
  min(forecast_ts) FILTER (value IS NOT NULL) AS first_non_null, max(forecast_ts) FILTER (value IS NOT NULL) AS last_non_null FROM l GROUP BY 1, 2""")
def column_coverage(v) -> DataFrame:
    return R.coverage(v.wx, ["grid_id"], ["u", "gust"], "forecast_ts").withColumn("missing_fraction", r6("missing_fraction"))


@query("month_median_lookup", "J13", """
WITH t AS (SELECT hour(hour_end) % 5 AS cell, power FROM scada10 WHERE day(hour_end) <= 20 AND hour(hour_end) % 5 <> 3), m AS (SELECT cell, median(power) AS md FROM t GROUP BY 1), g AS (SELECT median(power) AS gm FROM t)
SELECT hour_end, slot, turbine, round(coalesce(md, gm) + 1e-9, 6) AS expected FROM scada10 s LEFT JOIN m ON m.cell = hour(s.hour_end) % 5, g WHERE day(hour_end) > 20""")
def month_median_lookup(v) -> DataFrame:
    rows = v.scada10.withColumn("cell", F.hour("hour_end") % 5)
    train = rows.where((F.day("hour_end") <= 20) & (F.col("cell") != 3))
    out = M.median_lookup(train, rows.where(F.day("hour_end") > 20), ["cell"], "power", "expected")
    return rounded(out, ["hour_end", "slot", "turbine"], ["expected"])
