"""Run, gap, physics and design-matrix queries on the gridded forecast view."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.functions import timekeys as T
from windrow.functions import wind as P
from windrow.functions.exprs import r6
from windrow.operators import gaps, runs
from windrow.operators import design
from windrow.plans.digest import row_values, row_values_sql
from windrow.plans.registry import query

PI = repr(math.pi)
_VARS = ["u", "v", "u50", "v50", "gust", "t2", "d2", "sp"]


def _complete(v) -> DataFrame:
    """The forecast view with its rare empty cells set to zero, for operators that need whole runs."""
    return v.wx.fillna(0.0, subset=_VARS)


_FULL = f"""wf AS (SELECT forecast_ts, run_key, issued_ts, grid_id, lat, lon, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _VARS)}
              FROM wx)"""


@query("run_calendar", "W01 W17 F31", """
SELECT forecast_ts, date_trunc('day', forecast_ts - INTERVAL 1 HOUR) AS run_key, (hour(forecast_ts) + 23) % 24 AS position,
       (hour(forecast_ts) + 23) % 24 + 12 AS lead_hours,
       date_trunc('day', forecast_ts - INTERVAL 1 HOUR) - INTERVAL 10 HOUR AS cutoff, count(*) AS n
FROM wx GROUP BY ALL""")
def run_calendar(v) -> DataFrame:
    out = v.wx.groupBy("forecast_ts").agg(F.count(F.lit(1)).alias("n"))
    return out.select(
        "forecast_ts", T.run_key("forecast_ts").alias("run_key"), T.run_position("forecast_ts").cast("long").alias("position"),
        T.lead_hours("forecast_ts").cast("long").alias("lead_hours"), T.decision_cutoff("forecast_ts").alias("cutoff"), "n",
    )


@query("missing_cell_counts", "A08", """
SELECT forecast_ts, CAST(sum((u IS NULL)::INT + (v IS NULL)::INT + (gust IS NULL)::INT) AS BIGINT) AS raw_missing_cells,
       count(*) FILTER (u IS NULL OR v IS NULL OR gust IS NULL) AS raw_missing_grids FROM wx GROUP BY forecast_ts""")
def missing_cell_counts(v) -> DataFrame:
    return gaps.missing_counts(v.wx, ["u", "v", "gust"])


# besides the cells the view lacks: one grid silent for whole runs (spatial median) and one run silent (training median)
_GAPPY = """gp AS (SELECT forecast_ts, run_key, issued_ts, grid_id,
  CASE WHEN day(run_key) = 7 OR (grid_id % 5 = 1 AND day(run_key) % 3 = 0) THEN NULL ELSE u END AS u,
  CASE WHEN grid_id % 5 = 2 AND day(run_key) % 4 = 0 THEN NULL ELSE gust END AS gust FROM wx)"""


def _gappy(v) -> DataFrame:
    d, g = F.day("run_key"), F.col("grid_id")
    return v.wx.select(
        "forecast_ts", "run_key", "issued_ts", "grid_id",
        F.when(~((d == 7) | ((g % 5 == 1) & (d % 3 == 0))), F.col("u")).alias("u"),
        F.when(~((g % 5 == 2) & (d % 4 == 0)), F.col("gust")).alias("gust"),
    )


def _temporal(v: str) -> str:
    w = "OVER (PARTITION BY issued_ts, grid_id ORDER BY forecast_ts ROWS BETWEEN"
    before = f"last_value({v} IGNORE NULLS) {w} UNBOUNDED PRECEDING AND CURRENT ROW)"
    after = f"first_value({v} IGNORE NULLS) {w} CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"coalesce({v}, ({before} + {after}) * 0.5, {before}, {after}) AS {v}"


@query("gap_fill", "W08 A25", f"""
WITH {_GAPPY},
md AS (SELECT quantile_cont(u, 0.5) AS mu, quantile_cont(gust, 0.5) AS mg FROM gp WHERE day(run_key) <= 15),
t AS (SELECT forecast_ts, run_key, issued_ts, grid_id, {_temporal('u')}, {_temporal('gust')} FROM gp),
s AS (SELECT forecast_ts, quantile_cont(u, 0.5) AS su, quantile_cont(gust, 0.5) AS sg FROM t GROUP BY 1)
SELECT t.forecast_ts, grid_id, round(coalesce(u, su, mu, 0) + 1e-9, 6) AS u, round(coalesce(gust, sg, mg, 0) + 1e-9, 6) AS gust
FROM t JOIN s ON s.forecast_ts = t.forecast_ts, md""")
def gap_fill(v) -> DataFrame:
    rows = _gappy(v)
    medians = gaps.training_medians(rows.where(F.day("run_key") <= 15), ["u", "gust"])
    out = gaps.fill_gaps(rows, ["u", "gust"], medians)
    return out.select("forecast_ts", "grid_id", r6("u").alias("u"), r6("gust").alias("gust"))


def _near(v: str, k: int) -> tuple[str, str]:
    w = "OVER (PARTITION BY grid_id, run_key ORDER BY forecast_ts)"
    return f"coalesce(lag({v}, {k}) {w}, {v})", f"coalesce(lead({v}, {k}) {w}, {v})"


def _near_sql() -> tuple[str, list[str]]:
    parts, names = [], []
    for v in ("u", "gust"):
        for k in (1, 3):
            lag, lead = _near(v, k)
            for n, e in (("lag", lag), ("lead", lead), ("gradient", f"({lead} - {lag}) / {2.0 * k}"),
                         ("curvature", f"({lead} - 2 * {v} + {lag}) / {float(k * k)}")):
                parts.append(f"{e} AS {v}__run_{n}_{k}h")
                names.append(f"{v}__run_{n}_{k}h")
    return ", ".join(parts), names


_NEAR, _NEAR_NAMES = _near_sql()


@query("within_run_neighbours", "W02 W03", f"""
WITH {_FULL}, x AS (SELECT grid_id, forecast_ts, {_NEAR} FROM wf)
{row_values_sql('x', ['grid_id', 'forecast_ts'], _NEAR_NAMES)}""")
def within_run_neighbours(v) -> DataFrame:
    out = runs.neighbours(_complete(v), ["u", "gust"], [1, 3], ["grid_id", "run_key"])
    return row_values(out, ["grid_id", "forecast_ts"], _NEAR_NAMES)


def _sequence_sql() -> tuple[str, list[str]]:
    whole = "OVER (PARTITION BY grid_id, run_key)"
    ordered = "OVER (PARTITION BY grid_id, run_key ORDER BY forecast_ts)"
    full = "OVER (PARTITION BY grid_id, run_key ORDER BY forecast_ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    parts, names = [], []
    v = "gust"
    exprs = {"run_mean": f"avg({v}) {whole}", "run_std": f"coalesce(stddev_samp({v}) {whole}, 0)", "run_min": f"min({v}) {whole}",
             "run_max": f"max({v}) {whole}", "run_range": f"max({v}) {whole} - min({v}) {whole}",
             "current_minus_run_mean": f"{v} - avg({v}) {whole}"}
    for k in (6, 12):
        lag = f"coalesce(lag({v}, {k}) {ordered}, first_value({v}) {full})"
        lead = f"coalesce(lead({v}, {k}) {ordered}, last_value({v}) {full})"
        t0 = f"coalesce(lag(forecast_ts, {k}) {ordered}, first_value(forecast_ts) {full})"
        t1 = f"coalesce(lead(forecast_ts, {k}) {ordered}, last_value(forecast_ts) {full})"
        exprs[f"run_lag_{k}h"], exprs[f"run_lead_{k}h"] = lag, lead
        exprs[f"run_ramp_{k}h"] = f"({lead} - {lag}) / greatest(epoch({t1} - {t0}) / 3600.0, 1)"
    for n, e in exprs.items():
        parts.append(f"{e} AS {v}__{n}")
        names.append(f"{v}__{n}")
    return ", ".join(parts), names


_SEQ, _SEQ_NAMES = _sequence_sql()


@query("run_sequence_features", "W04", f"""
WITH {_FULL}, x AS (SELECT grid_id, forecast_ts, {_SEQ} FROM wf)
{row_values_sql('x', ['grid_id', 'forecast_ts'], _SEQ_NAMES)}""")
def run_sequence_features(v) -> DataFrame:
    out = runs.run_sequence(_complete(v), ["gust"], [6, 12], ["grid_id", "run_key"])
    return row_values(out, ["grid_id", "forecast_ts"], _SEQ_NAMES)


def _shape_sql(c: str) -> dict[str, str]:
    x = f"l_{c}"
    h = "p"
    cur = f"{x}[{h} + 1]"
    prev, nxt = f"{x}[greatest({h}, 1)]", f"{x}[least({h} + 2, 24)]"
    dot = lambda f: f"list_sum(list_transform(range(0, 24), lambda i: {x}[i + 1] * {f}))"
    mean, std = f"list_avg({x})", f"sqrt(list_avg(list_transform({x}, lambda q: (q - list_avg({x})) * (q - list_avg({x})))))"
    out = {
        "current": cur, "run_mean": mean, "run_std": std, "run_min": f"list_min({x})", "run_max": f"list_max({x})",
        "run_range": f"list_max({x}) - list_min({x})",
        **{f"run_q{int(q * 100)}": f"list_aggregate({x}, 'quantile_cont', {q})" for q in (0.1, 0.25, 0.5, 0.75, 0.9)},
        "current_minus_mean": f"{cur} - {mean}", "current_zscore": f"({cur} - {mean}) / greatest({std}, 1e-6)",
        "within_run_rank": f"len(list_filter(range(0, 24), lambda i: {x}[i + 1] < {cur} OR ({x}[i + 1] = {cur} AND i < {h}))) / 23.0",
        "same_run_previous": prev, "same_run_next": nxt, "same_run_gradient": f"0.5 * ({nxt} - {prev})",
        "same_run_curvature": f"{nxt} - 2 * {cur} + {prev}",
        "run_peak_position": f"(list_position({x}, list_max({x})) - 1) / 23.0",
        "run_trough_position": f"(list_position({x}, list_min({x})) - 1) / 23.0",
        "run_linear_slope": dot("(i - 11.5)") + " / 1150.0",
    }
    for k in (1, 2):
        out[f"run_fft{k}_real"] = dot(f"cos(2 * {PI} * {k} * i / 24.0)") + " / 24.0"
        out[f"run_fft{k}_imag"] = "-" + dot(f"sin(2 * {PI} * {k} * i / 24.0)") + " / 24.0"
    return {f"{c}__{n}": e for n, e in out.items()}


_SHAPE_CTE = f"""{_FULL},
r AS (SELECT grid_id, run_key, list(gust ORDER BY forecast_ts) AS l_gust, list(u ORDER BY forecast_ts) AS l_u FROM wf GROUP BY 1, 2),
h AS (SELECT *, unnest(range(0, 24)) AS p FROM r)"""
_GUST_SHAPE, _U_SHAPE = _shape_sql("gust"), _shape_sql("u")


@query("run_shape_features", "W05 W09", f"""
WITH {_SHAPE_CTE}, x AS (SELECT grid_id, run_key + (p + 1) * INTERVAL 1 HOUR AS forecast_ts, {', '.join(f'{e} AS {n}' for n, e in _GUST_SHAPE.items())} FROM h)
{row_values_sql('x', ['grid_id', 'forecast_ts'], _GUST_SHAPE)}""")
def run_shape_features(v) -> DataFrame:
    return row_values(runs.run_shape(_complete(v), ["gust"], ["grid_id", "run_key"]), ["grid_id", "forecast_ts"], list(_GUST_SHAPE))


_HORIZON = {"horizon__position_fraction": "p / 23.0", **{
    f"horizon__{f}_{k}": f"{f}(2 * {PI} * {k} * p / 24.0)" for k in (1, 2) for f in ("sin", "cos")}}
_INTERACTIONS = {
    "interaction__baseline_center_x_horizon_sin1": "u__current_minus_mean * horizon__sin_1",
    "interaction__baseline_center_x_horizon_cos1": "u__current_minus_mean * horizon__cos_1",
    "interaction__baseline_x_wind": "u__current * gust__current",
    "interaction__baseline_center_x_wind_center": "u__current_minus_mean * gust__current_minus_mean",
    "interaction__baseline_rank_x_wind_rank": "u__within_run_rank * gust__within_run_rank",
}


@query("run_sequence_table", "W06", f"""
WITH {_SHAPE_CTE},
x AS (SELECT grid_id, run_key, p, {', '.join(f'{e} AS {n}' for n, e in {**_GUST_SHAPE, **_U_SHAPE, **_HORIZON}.items())} FROM h),
y AS (SELECT grid_id, run_key, p AS position, {', '.join(_HORIZON)}, {', '.join(f'{e} AS {n}' for n, e in _INTERACTIONS.items())} FROM x)
{row_values_sql('y', ['grid_id', 'run_key', 'position'], [*_HORIZON, *_INTERACTIONS])}""")
def run_sequence_table(v) -> DataFrame:
    out = runs.run_sequence_table(_complete(v), "u", "gust", [], ["grid_id", "run_key"])
    return row_values(out.withColumn("position", F.col("position").cast("long")), ["grid_id", "run_key", "position"], [*_HORIZON, *_INTERACTIONS])


@query("smooth_within_runs", "W07", f"""
WITH {_FULL},
x AS (SELECT *, coalesce(lag(gust) OVER w, gust) AS a, coalesce(lead(gust) OVER w, gust) AS b FROM wf
      WINDOW w AS (PARTITION BY grid_id, run_key ORDER BY forecast_ts))
SELECT forecast_ts, grid_id, round(0.8 * gust + 0.1 * (a + b) + 1e-9, 6) AS smoothed FROM x""")
def smooth_within_runs(v) -> DataFrame:
    out = runs.smooth(_complete(v), "gust", 0.2, ["grid_id", "run_key"], "forecast_ts")
    return out.select("forecast_ts", "grid_id", r6("smoothed").alias("smoothed"))


@query("run_dct", "W15", f"""
WITH {_FULL}
SELECT grid_id, run_key, {', '.join(f"round(sum(gust * cos({PI} * {k} / 24.0 * ((hour(forecast_ts) + 23) % 24 + 0.5))) * sqrt({1 if k == 0 else 2} / 24.0) + 1e-8, 5) + 0 AS gust__dct_{k}" for k in range(8))}
FROM wf GROUP BY 1, 2""")
def run_dct(v) -> DataFrame:
    out = runs.dct_coefficients(_complete(v), "gust", ["grid_id", "run_key"], T.run_position("forecast_ts"))
    return out.select("grid_id", "run_key", *[r6(f"gust__dct_{k}", 5).alias(f"gust__dct_{k}") for k in range(8)])


_ANCHORS = [1, 4, 7, 10, 13, 16, 19, 22, 24]


@query("anchor_interpolation", "W13", f"""
WITH {_FULL},
a AS (SELECT grid_id, run_key, (hour(forecast_ts) + 23) % 24 + 1 AS p, gust, u FROM wf
      WHERE (hour(forecast_ts) + 23) % 24 + 1 IN ({', '.join(map(str, _ANCHORS))})),
t AS (SELECT grid_id, run_key, unnest(range(1, 25)) AS lead FROM (SELECT DISTINCT grid_id, run_key FROM a)),
b AS (SELECT t.*, (SELECT max(p) FROM a WHERE a.grid_id = t.grid_id AND a.run_key = t.run_key AND a.p <= t.lead) AS p0,
             (SELECT min(p) FROM a WHERE a.grid_id = t.grid_id AND a.run_key = t.run_key AND a.p >= t.lead) AS p1 FROM t)
SELECT b.grid_id, b.run_key, b.lead,
       round(CASE WHEN p0 = p1 THEN a0.gust ELSE a0.gust + (lead - p0) / (p1 - p0) * (a1.gust - a0.gust) END + 1e-9, 6) AS gust,
       round(CASE WHEN p0 = p1 THEN a0.u ELSE a0.u + (lead - p0) / (p1 - p0) * (a1.u - a0.u) END + 1e-9, 6) AS u
FROM b JOIN a a0 ON a0.grid_id = b.grid_id AND a0.run_key = b.run_key AND a0.p = b.p0
JOIN a a1 ON a1.grid_id = b.grid_id AND a1.run_key = b.run_key AND a1.p = b.p1""")
def anchor_interpolation(v) -> DataFrame:
    rows = _complete(v).withColumn("lead", (T.run_position("forecast_ts") + 1).cast("long")).where(F.col("lead").isin(_ANCHORS))
    out = runs.interpolate_anchors(rows, ["gust", "u"], ["grid_id", "run_key"], "lead",
                                   F.sequence(F.lit(1).cast("long"), F.lit(24).cast("long")))
    return out.select("grid_id", "run_key", "lead", r6("gust").alias("gust"), r6("u").alias("u"))


@query("three_hour_interpolation", "W14 S22", f"""
WITH {_FULL},
n AS (SELECT run_key, (hour(forecast_ts) + 23) % 24 + 39 AS lead, grid_id % 2 AS product, avg(gust) AS w FROM wf GROUP BY 1, 2, 3),
wide AS (SELECT run_key, lead, max(w) FILTER (product = 0) AS m, max(w) FILTER (product = 1) AS s FROM n WHERE lead % 3 = 0 GROUP BY 1, 2),
t AS (SELECT run_key, unnest(range(39, 61)) AS lead FROM (SELECT DISTINCT run_key FROM wide))
SELECT t.run_key, t.lead, round(a.m + ((t.lead % 3) / 3.0) * (coalesce(b.m, a.m) - a.m) + 1e-9, 6) AS ens_mean,
       round(a.s + ((t.lead % 3) / 3.0) * (coalesce(b.s, a.s) - a.s) + 1e-9, 6) AS ens_spread
FROM t JOIN wide a ON a.run_key = t.run_key AND a.lead = t.lead - t.lead % 3
LEFT JOIN wide b ON b.run_key = t.run_key AND b.lead = a.lead + 3""")
def three_hour_interpolation(v) -> DataFrame:
    native = _complete(v).groupBy(
        "run_key", (T.run_position("forecast_ts") + 39).cast("long").alias("lead"), (F.col("grid_id") % 2).alias("product")
    ).agg(F.avg("gust").alias("w")).where(F.col("lead") % 3 == 0)
    wide = design.pivot_products(native, ["run_key", "lead"], "product", {0: "m", 1: "s"}, "w")
    out = runs.interpolate_anchors(wide, ["m", "s"], ["run_key"], "lead",
                                   F.sequence(F.lit(39).cast("long"), F.lit(60).cast("long")))
    return out.select("run_key", "lead", r6("m").alias("ens_mean"), r6("s").alias("ens_spread"))


@query("recency_weights", "W16", """
WITH a AS (SELECT forecast_ts, grid_id, pow(2, -greatest(epoch((SELECT max(forecast_ts) FROM wx_obs) - forecast_ts) / 86400.0, 0) / 45.0) AS w
           FROM wx_obs)
SELECT forecast_ts, grid_id, round(w / avg(w) OVER () + 1e-9, 6) AS weight FROM a""")
def recency_weights(v) -> DataFrame:
    end = v.wx_obs.agg(F.max("forecast_ts")).scalar()
    out = runs.recency_weights(v.wx_obs.select("forecast_ts", "grid_id"), "forecast_ts", end, 45.0)
    return out.select("forecast_ts", "grid_id", r6("weight").alias("weight"))


_S10, _S50 = "sqrt(u * u + v * v)", "sqrt(u50 * u50 + v50 * v50)"
_ALPHA = f"least(greatest(ln(({_S50} + 0.1) / ({_S10} + 0.1)) / ln(5), -0.5), 0.8)"
_HUB = f"({_S50} * pow(117.0 / 50.0, {_ALPHA}))"
_HUB2 = f"({_S50} * pow(117.0 / 50.0, least(greatest(ln(greatest({_S50}, 0.2) / greatest({_S10}, 0.2)) / ln(5), -0.3), 0.8)))"
_RHO = "(least(greatest(sp, 40000), 120000) / (287.05 * least(greatest(t2, 180), 340)))"
_PHYS = {
    "ws10": _S10, "ws10__flow_sin": f"u / greatest({_S10}, 1e-4)", "ws10__flow_cos": f"v / greatest({_S10}, 1e-4)",
    "ws10__cube": f"pow(least({_S10}, 50), 3)", "ws50": _S50, "shear_alpha": _ALPHA, "hub_ws": _HUB, "hub_ws_turbine": _HUB2,
    "hub_ws_constant": f"{_S50} * pow(117.0 / 50.0, 0.14)", "air_density": _RHO,
    "air_density_turbine": "least(greatest(sp / (287.05 * greatest(t2, 180)), 0.7), 1.5)",
    "wind_power_density": f"0.5 * {_RHO} * pow(least(greatest({_HUB}, 0), 50), 3)", "dewpoint_depression": "t2 - d2",
    "gust_excess": f"gust - {_S10}", "gust_ratio": f"gust / ({_S10} + 0.2)", "cross_mean": f"0.5 * ({_HUB} + gust)",
    "cross_difference": f"{_HUB} - gust", "cross_product": f"{_HUB} * gust",
}


@query("wind_physics", "F01 F02 F03 F04", f"""
WITH x AS (SELECT grid_id, forecast_ts, {', '.join(f'{e} AS {n}' for n, e in _PHYS.items())} FROM wx_obs)
{row_values_sql('x', ['grid_id', 'forecast_ts'], _PHYS)}""")
def wind_physics(v) -> DataFrame:
    rows = v.wx_obs.withColumns({**P.speed_features("ws10", "u", "v"), "ws50": P.speed("u50", "v50")})
    rows = rows.withColumn("shear_alpha", P.shear_exponent("ws50", "ws10", 5.0))
    hub = F.lit(117.0)
    rows = rows.withColumns({
        "hub_ws": P.hub_speed("ws50", "shear_alpha", hub, 50.0),
        "hub_ws_turbine": P.hub_speed("ws50", P.shear_exponent_floored("ws50", "ws10", 5.0), hub, 50.0),
        "hub_ws_constant": P.hub_speed("ws50", 0.14, hub, 50.0),
        "air_density": P.air_density("sp", "t2"), "air_density_turbine": P.air_density_bounded("sp", "t2"),
        "dewpoint_depression": F.col("t2") - F.col("d2"), "gust_excess": P.gust_excess("gust", "ws10"),
        "gust_ratio": P.gust_ratio("gust", "ws10"),
    })
    rows = rows.withColumns({"wind_power_density": P.power_density("air_density", "hub_ws"),
                             **P.cross_source("cross", "hub_ws", "gust")})
    return row_values(rows, ["grid_id", "forecast_ts"], list(_PHYS))


_TWO_PI = f"(2 * {PI})"
_TIME = {
    "time__hour_sin": f"sin({_TWO_PI} * hr / 24.0)", "time__hour_cos": f"cos({_TWO_PI} * hr / 24.0)",
    "time__doy_sin": f"sin({_TWO_PI} * dd / 365.2425)", "time__doy_cos": f"cos({_TWO_PI} * dd / 365.2425)",
    "time__month_sin": f"sin({_TWO_PI} * (mo - 1) / 12.0)", "time__month_cos": f"cos({_TWO_PI} * (mo - 1) / 12.0)",
    "time__lead_hours": "CAST(lead AS DOUBLE)", "time__run_position": "CAST(lead AS DOUBLE) - 12",
    "time__hour_x_doy_sin": f"sin({_TWO_PI} * hr / 24.0) * sin({_TWO_PI} * dd / 365.2425)",
    "time__hour_x_doy_cos": f"cos({_TWO_PI} * hr / 24.0) * cos({_TWO_PI} * dd / 365.2425)",
}
_CAL = {"month": "CAST(mo AS DOUBLE)", "day": "CAST(day(forecast_ts) AS DOUBLE)", "hour": "CAST(hr AS DOUBLE)",
        "dayofweek": "CAST(isodow(forecast_ts) - 1 AS DOUBLE)", "is_weekend": "CASE WHEN isodow(forecast_ts) >= 6 THEN 1.0 ELSE 0.0 END",
        "hour_sin": f"sin({_TWO_PI} * hr / 24.0)", "hour_cos": f"cos({_TWO_PI} * hr / 24.0)",
        "month_sin": f"sin({_TWO_PI} * mo / 12.0)", "month_cos": f"cos({_TWO_PI} * mo / 12.0)"}
_CLOCK = """cl AS (SELECT DISTINCT forecast_ts, hour(forecast_ts) AS hr, month(forecast_ts) AS mo,
              dayofyear(forecast_ts) - 1 + hour(forecast_ts) / 24.0 AS dd, (hour(forecast_ts) + 23) % 24 + 12 AS lead FROM wx_obs)"""


@query("time_features", "F05 F06", f"""
WITH {_CLOCK}
SELECT forecast_ts, {', '.join(f'round({e} + 1e-9, 6) + 0 AS {n}' for n, e in {**_TIME, **_CAL}.items())} FROM cl""")
def time_features(v) -> DataFrame:
    clock = v.wx_obs.select("forecast_ts").distinct()
    features = {**T.cyclic_time_features("forecast_ts", T.lead_hours("forecast_ts")), **P.calendar_columns("forecast_ts")}
    return clock.select("forecast_ts", *[r6(c).alias(n) for n, c in features.items()])


def _seasonal_sql() -> dict[str, str]:
    z = "(least(greatest(gust, 0), 30) / 15.0)"
    out = {"wind_z": z, "wind_z2": f"{z} * {z}"}
    for k in (3, 6, 9, 12, 15):
        out[f"wind_hinge2_{k:02d}"] = f"pow(greatest({z} - {k} / 15.0, 0), 2)"
    cyc = {}
    for name, base in (("doy", "(dayofyear(forecast_ts) - 1 + hour(forecast_ts) / 24.0) / 365.2425"), ("hour", "hour(forecast_ts) / 24.0")):
        for k in (1, 2):
            cyc[f"{name}_sin{k}"] = f"sin({k} * {_TWO_PI} * {base})"
            cyc[f"{name}_cos{k}"] = f"cos({k} * {_TWO_PI} * {base})"
    out.update(cyc)
    out.update({f"wind_x_{n}": f"{z} * {e}" for n, e in cyc.items()})
    return out


_SEASONAL = _seasonal_sql()


@query("seasonal_wind_design", "F07", f"""
WITH x AS (SELECT grid_id, forecast_ts, {', '.join(f'{e} AS {n}' for n, e in _SEASONAL.items())} FROM wx_obs)
{row_values_sql('x', ['grid_id', 'forecast_ts'], _SEASONAL)}""")
def seasonal_wind_design(v) -> DataFrame:
    rows = v.wx_obs.select("grid_id", "forecast_ts", *[c.alias(n) for n, c in P.seasonal_wind_design("forecast_ts", "gust").items()])
    return row_values(rows, ["grid_id", "forecast_ts"], list(_SEASONAL))


@query("raw_node_matrix", "F08", f"""
WITH x AS (SELECT forecast_ts, issued_ts, grid_id, unnest(['u', 'v', 'gust']) AS channel, unnest([u, v, gust]) AS value FROM wx)
SELECT forecast_ts, grid_id, channel, round(value + 1e-9, 6) + 0 AS value,
       round(sin({_TWO_PI} * hour(forecast_ts) / 24.0) + 1e-9, 6) + 0 AS forecast_hour_sin,
       round(cos({_TWO_PI} * hour(forecast_ts) / 24.0) + 1e-9, 6) + 0 AS forecast_hour_cos,
       round(sin({_TWO_PI} * (dayofyear(forecast_ts) - 1) / 365.25) + 1e-9, 6) + 0 AS forecast_dayofyear_sin,
       round(cos({_TWO_PI} * (dayofyear(forecast_ts) - 1) / 365.25) + 1e-9, 6) + 0 AS forecast_dayofyear_cos,
       round(epoch(forecast_ts - issued_ts) / 3600.0 + 1e-9, 6) AS lead_hours,
       round(sin({_TWO_PI} * hour(issued_ts) / 24.0) + 1e-9, 6) + 0 AS run_hour_sin,
       round(cos({_TWO_PI} * hour(issued_ts) / 24.0) + 1e-9, 6) + 0 AS run_hour_cos FROM x""")
def raw_node_matrix(v) -> DataFrame:
    out = design.node_rows(v.wx, ["u", "v", "gust"])
    keys = ["forecast_ts", "grid_id", "channel"]
    return row_values(out, keys, [c for c in out.columns if c not in keys])


@query("mean_weather_design", "F09", f"""
WITH m AS (SELECT forecast_ts, {', '.join(f'avg({c}) AS {c}_mean' for c in _VARS)} FROM wx GROUP BY 1),
x AS (SELECT *, hour(forecast_ts) AS hr, month(forecast_ts) AS mo FROM m)
SELECT forecast_ts, {', '.join(f'round({e} + 1e-9, 6) + 0 AS {n}' for n, e in _CAL.items())}, {', '.join(f'round({c}_mean + 1e-9, 6) AS {c}_mean' for c in _VARS)} FROM x""")
def mean_weather_design(v) -> DataFrame:
    out = design.mean_weather(v.wx, _VARS)
    return out.select("forecast_ts", *[r6(c).alias(c) for c in out.columns if c != "forecast_ts"])


def _profile_sql() -> dict[str, str]:
    lv = {"low": ("u", "v"), "mid": ("u50", "v50"), "top": ("gust", "v")}
    s = {n: f"sqrt({a} * {a} + {b} * {b})" for n, (a, b) in lv.items()}
    out = {f"ws_{n}": s[n] for n in lv}
    cos = []
    for a, b in (("low", "mid"), ("mid", "top"), ("low", "top")):
        (ua, va), (ub, vb) = lv[a], lv[b]
        out[f"speed_{b}_minus_{a}"] = f"{s[b]} - {s[a]}"
        out[f"ratio_{b}_to_{a}"] = f"{s[b]} / greatest({s[a]}, 1e-6)"
        out[f"vector_shear_{a}_{b}"] = f"sqrt(pow({ub} - {ua}, 2) + pow({vb} - {va}, 2))"
        c = f"(({ua} * {ub} + {va} * {vb}) / greatest({s[a]} * {s[b]}, 1e-6))"
        out[f"cos_{a}_{b}"] = f"least(greatest({c}, -1), 1)"
        cos.append(c)
    m = f"(({s['low']} + {s['mid']} + {s['top']}) / 3.0)"
    out["profile_speed_mean"] = m
    out["profile_speed_std"] = "sqrt((" + " + ".join(f"pow({s[n]} - {m}, 2)" for n in lv) + ") / 3.0)"
    out["profile_alignment_mean"] = f"(({' + '.join(cos)}) / 3.0)"
    return out


_PROFILE = _profile_sql()


@query("vertical_profile_geometry", "F15", f"""
WITH x AS (SELECT grid_id, forecast_ts, {', '.join(f'{e} AS {n}' for n, e in _PROFILE.items())} FROM wx_obs)
{row_values_sql('x', ['grid_id', 'forecast_ts'], _PROFILE)}""")
def vertical_profile_geometry(v) -> DataFrame:
    features = P.profile_geometry({"low": ("u", "v"), "mid": ("u50", "v50"), "top": ("gust", "v")})
    rows = v.wx_obs.select("grid_id", "forecast_ts", *[c.alias(n) for n, c in features.items()])
    return row_values(rows, ["grid_id", "forecast_ts"], list(_PROFILE))


def _hyp(a: str, b: str) -> str:
    return f"sqrt(({a}) * ({a}) + ({b}) * ({b}))"


def _residual_profile_sql() -> dict[str, str]:
    lo, mi, hi = ("u", "v"), ("u50", "v50"), ("gust", "v")
    w = {n: _hyp(*p) for n, p in (("lo", lo), ("mi", mi), ("hi", hi))}

    def geo(a, b, wa, wb):
        d = f"greatest({wa} * {wb}, 0.25)"
        return (f"least(greatest(({a[0]} * {b[0]} + {a[1]} * {b[1]}) / {d}, -1), 1)",
                f"least(greatest(({a[0]} * {b[1]} - {a[1]} * {b[0]}) / {d}, -1), 1)", _hyp(f"{a[0]} - {b[0]}", f"{a[1]} - {b[1]}"))

    c1, s1, h1 = geo(lo, hi, w["lo"], w["hi"])
    c2, s2, h2 = geo(lo, mi, w["lo"], w["mi"])
    c3, s3, h3 = geo(hi, mi, w["hi"], w["mi"])
    r8 = f"least(greatest({w['hi']} / greatest({w['lo']}, 0.5), 0), 4)"
    rp = f"least(greatest({w['mi']} / greatest({w['lo']}, 0.5), 0), 4)"
    q8 = f"least(greatest({h1} / greatest({w['lo']} + {w['hi']}, 0.5), 0), 2)"
    qp = f"least(greatest({h2} / greatest({w['lo']} + {w['mi']}, 0.5), 0), 2)"
    st = "least(greatest(d2 * pow(1000.0 / 850.0, 0.286) - t2 * pow(100000.0 / least(greatest(sp, 70000), 110000), 0.286), -40), 40)"
    b = "(gust / 30.0)"
    return {"baseline_cf": b, "ws100": w["lo"], "ws850": w["hi"], "ws_pbl": w["mi"], "ratio_850_100": r8, "ratio_pbl_100": rp,
            "shear_100_850": h1, "shear_100_pbl": h2, "shear_850_pbl": h3, "relative_shear_100_850": q8, "relative_shear_100_pbl": qp,
            "relative_cos_100_850": c1, "relative_sin_100_850": s1, "relative_cos_100_pbl": c2, "relative_sin_100_pbl": s2,
            "relative_cos_850_pbl": c3, "relative_sin_850_pbl": s3, "stability": st, "stability_x_ws100": f"{st} * {w['lo']}",
            "stability_x_shear_100_850": f"{st} * {h1}", "stability_x_ratio_850_100": f"{st} * {r8}",
            "baseline_x_ratio_850_100": f"{b} * {r8}", "baseline_x_relative_shear_100_850": f"{b} * {q8}", "baseline_x_stability": f"{b} * {st}"}


_RESID = _residual_profile_sql()


@query("residual_profile_features", "F15", f"""
WITH x AS (SELECT grid_id, forecast_ts, {', '.join(f'{e} AS {n}' for n, e in _RESID.items())} FROM wx_obs)
{row_values_sql('x', ['grid_id', 'forecast_ts'], _RESID)}""")
def residual_profile_features(v) -> DataFrame:
    features = P.residual_profile(("u", "v"), ("u50", "v50"), ("gust", "v"), "t2", "sp", "d2", F.col("gust") / 30.0)
    return row_values(v.wx_obs.select("grid_id", "forecast_ts", *[c.alias(n) for n, c in features.items()]), ["grid_id", "forecast_ts"], list(_RESID))


def _level_sql() -> dict[str, str]:
    lv = [(1000, "u", "v"), (975, "u50", "v50"), (950, "gust", "v"), (925, "gust", "u50")]
    s = {n: _hyp(a, b) for n, a, b in lv}
    out = {f"ws_{n}": s[n] for n, _, _ in lv}
    by = {n: (a, b) for n, a, b in lv}

    def shear(up, dn, name):
        out[f"{name}_du"], out[f"{name}_dv"] = f"{by[up][0]} - {by[dn][0]}", f"{by[up][1]} - {by[dn][1]}"
        out[f"{name}_shear"] = _hyp(f"{by[up][0]} - {by[dn][0]}", f"{by[up][1]} - {by[dn][1]}")

    shear(925, 1000, "endpoint")
    for (lo, _, _), (up, _, _) in zip(lv, lv[1:]):
        shear(up, lo, f"adjacent_{up}_{lo}")
    (u0, v0), (u1, v1) = by[1000], by[925]
    still, d = f"({s[1000]} < 0.25 OR {s[925]} < 0.25)", f"greatest({s[1000]} * {s[925]}, 0.25)"
    out["endpoint_cos"] = f"CASE WHEN {still} THEN 0 ELSE least(greatest(({u0} * {u1} + {v0} * {v1}) / {d}, -1), 1) END"
    out["endpoint_sin"] = f"CASE WHEN {still} THEN 0 ELSE least(greatest(({u0} * {v1} - {v0} * {u1}) / {d}, -1), 1) END"
    return out


_LEVEL = _level_sql()


@query("pressure_level_diagnostics", "F15", f"""
WITH x AS (SELECT grid_id, forecast_ts, {', '.join(f'{e} AS {n}' for n, e in _LEVEL.items())} FROM wx_obs)
{row_values_sql('x', ['grid_id', 'forecast_ts'], _LEVEL)}""")
def pressure_level_diagnostics(v) -> DataFrame:
    features = P.level_diagnostics([(1000, "u", "v"), (975, "u50", "v50"), (950, "gust", "v"), (925, "gust", "u50")])
    return row_values(v.wx_obs.select("grid_id", "forecast_ts", *[c.alias(n) for n, c in features.items()]), ["grid_id", "forecast_ts"], list(_LEVEL))


_ICE = {
    "hub_c_a": "t2 - 20 - 273.15 - 0.0065 * 117.0", "hub_c_b": "t2 - 19 - 273.15 - 0.0065 * 117.0",
    "mean_hub_c": "0.5 * ((t2 - 20 - 273.15 - 0.0065 * 117.0) + (t2 - 19 - 273.15 - 0.0065 * 117.0))",
    "depression_a": "abs(t2 - d2 - 8) / 2", "depression_b": "abs(t2 - d2 - 7) / 2",
    "precipitation_proxy": "(u > 3 OR gust > 15)::INT", "low_cloud_proxy": "(u50 >= 1 OR v50 >= 2)::INT",
}


@query("icing_regime", "F16", f"""
WITH x AS (SELECT grid_id, forecast_ts, gust, {', '.join(f'{e} AS {n}' for n, e in _ICE.items())},
                  {_S50} AS wa, gust / 4 AS wb FROM wx_obs),
y AS (SELECT *, (hub_c_a <= 0.5 AND hub_c_b <= 0.5 AND mean_hub_c >= -5 AND depression_a <= 3 AND depression_b <= 3
                AND wa >= 3 AND wb >= 1.5 AND precipitation_proxy = 1 AND low_cloud_proxy = 1)::INT AS icing_state FROM x),
z AS (SELECT *, CASE WHEN icing_state = 1 THEN 0.84 * gust ELSE gust END AS derated FROM y)
{row_values_sql('z', ['grid_id', 'forecast_ts'], [*_ICE, 'icing_state', 'derated'])}""")
def icing_regime(v) -> DataFrame:
    rows = v.wx_obs.withColumns({"ta": F.col("t2") - 20, "tb": F.col("t2") - 19})
    rows = rows.withColumns({"da": F.col("ta") - F.abs(F.col("t2") - F.col("d2") - 8) / 2,
                             "db": F.col("tb") - F.abs(F.col("t2") - F.col("d2") - 7) / 2})
    state = P.icing_state("ta", "da", "tb", "db", P.speed("u50", "v50"), F.col("gust") / 4, F.lit(117.0),
                          [F.col("u") > 3, F.col("gust") > 15], [F.col("u50") >= 1, F.col("v50") >= 2])
    rows = rows.withColumns(state).withColumn("derated", P.icing_derate("gust", "icing_state"))
    return row_values(rows, ["grid_id", "forecast_ts"], [*_ICE, "icing_state", "derated"])


_P98 = "least(greatest(cf, 0.02), 0.98)"
_TRANS = {"identity": "cf", "logit_eps02": f"ln({_P98} / (1 - {_P98}))", "arcsin_sqrt": "asin(sqrt(least(greatest(cf, 0), 1)))",
          "cube_root": "cbrt(least(greatest(cf, 0), 1.02))"}
_BACK = {"identity": "least(greatest(cf, 0), 1.02)", "logit_eps02": _P98, "arcsin_sqrt": "least(greatest(cf, 0), 1)",
         "cube_root": "least(greatest(cf, 0), 1.02)"}


@query("target_transforms", "F17 P17", f"""
WITH x AS (SELECT grp, site, ts, actual / capacity AS cf FROM fcst),
y AS (SELECT grp, site, ts, {', '.join(f'{e} AS {n}' for n, e in _TRANS.items())}, {', '.join(f'{e} AS {n}_back' for n, e in _BACK.items())} FROM x)
{row_values_sql('y', ['grp', 'site', 'ts'], [*_TRANS, *[f'{n}_back' for n in _BACK]])}""")
def target_transforms(v) -> DataFrame:
    rows = v.fcst.withColumn("cf", F.col("actual") / F.col("capacity"))
    rows = rows.withColumns({k: P.target_transform("cf", k) for k in P.TRANSFORMS})
    rows = rows.withColumns({f"{k}_back": P.inverse_target_transform(k, k) for k in P.TRANSFORMS})
    return row_values(rows, ["grp", "site", "ts"], [*_TRANS, *[f"{n}_back" for n in _BACK]])
