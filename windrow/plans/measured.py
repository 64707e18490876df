"""Telemetry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.functions.exprs import r6, rounded
from windrow.operators import telemetry as M
from windrow.plans.registry import query

# telemetry with two faults that its cleaning has to find: readings far outside and impossible wind
_RAW = """raw AS (SELECT hour_end, slot, turbine, grp, CASE WHEN (turbine + slot + hour(hour_end)) % 41 = 0 THEN power * 1e6 ELSE power END AS power,
  CASE WHEN (turbine * 3 + slot + day(hour_end)) % 37 = 0 THEN ws + 80 ELSE ws END AS ws,
  CASE WHEN (turbine + slot) % 29 = 0 THEN NULL ELSE wd - 180 END AS wd FROM scada10)"""


def _raw(v) -> DataFrame:
    t, s, h = F.col("turbine"), F.col("slot"), F.col("hour_end")
    return v.scada10.select(
        "hour_end", "slot", "turbine", "grp",
        F.when((t + s + F.hour(h)) % 41 == 0, F.col("power") * 1e6).otherwise(F.col("power")).alias("power"),
        F.when((t * 3 + s + F.day(h)) % 37 == 0, F.col("ws") + 80).otherwise(F.col("ws")).alias("ws"),
        F.when((t + s) % 29 != 0, F.col("wd") - 180).alias("wd"))


_HOURLY_EXPR = {
    "obs_power": "sum(p)", "obs_power_mean": "avg(p)", "obs_power_std": "stddev_pop(p)", "obs_ws_mean": "avg(s)", "obs_ws_std": "stddev_pop(s)",
    "obs_ws_min": "min(s)", "obs_ws_max": "max(s)", "obs_ws_p10": "quantile_cont(s, 0.1)", "obs_ws_p90": "quantile_cont(s, 0.9)",
    "obs_wd_sin": "avg(sin(radians(d)))", "obs_wd_cos": "avg(cos(radians(d)))",
    "obs_wd_resultant": "sqrt(pow(avg(sin(radians(d))), 2) + pow(avg(cos(radians(d))), 2))",
    "obs_record_fraction": "least(count(DISTINCT slot) / 6.0, 1)", "obs_power_valid_fraction": "least(count(p) / 36.0, 1)",
    "obs_ws_valid_fraction": "least(count(s) / 36.0, 1)", "obs_wd_valid_fraction": "least(count(d) / 36.0, 1)",
    "obs_wind_valid_fraction": "least(count(*) FILTER (s IS NOT NULL AND d IS NOT NULL) / 36.0, 1)",
    "obs_power_spike_fraction": "least(count(*) FILTER (spike) / 36.0, 1)",
    "obs_turbine_availability": "count(*) FILTER (adq AND p > 1) / CAST(nullif(count(*) FILTER (adq), 0) AS DOUBLE)",
    "obs_zero_power_fraction": "count(*) FILTER (adq AND p <= 0) / CAST(nullif(count(*) FILTER (adq), 0) AS DOUBLE)",
    "obs_power_scaled": "avg(p) * 36", "obs_capacity_factor": "CASE WHEN avg(p) IS NOT NULL THEN least(greatest(avg(p) * 36 / 1800, 0), 1.1) END",
}
_HOURLY_COUNTS = {"obs_n_intervals": "count(DISTINCT slot)", "obs_n_power_valid": "count(p)", "obs_n_ws_valid": "count(s)", "obs_n_wd_valid": "count(d)",
                  "obs_n_wind_pair_valid": "count(*) FILTER (s IS NOT NULL AND d IS NOT NULL)", "obs_n_adequate_wind": "count(*) FILTER (adq)",
                  "obs_n_online": "count(*) FILTER (adq AND p > 1)", "obs_power_spike_count": "count(*) FILTER (spike)",
                  "obs_invalid_ws_count": "count(*) FILTER (bad)"}


@query("telemetry_hourly", "A12 A13 A16", f"""
WITH {_RAW},
c AS (SELECT hour_end, grp, slot, CASE WHEN power BETWEEN -30 AND 90 THEN power END AS p, power < -30 OR power > 90 AS spike,
             CASE WHEN ws BETWEEN 0 AND 75 THEN ws END AS s, ws < 0 OR ws > 75 AS bad, (wd % 360 + 360) % 360 AS d FROM raw),
a AS (SELECT *, coalesce(p IS NOT NULL AND s BETWEEN 3 AND 25, false) AS adq FROM c)
SELECT hour_end, grp, {', '.join(f'{e} AS {n}' for n, e in _HOURLY_COUNTS.items())},
       {', '.join(f'round({e} + 1e-9, 6) + 0 AS {n}' for n, e in _HOURLY_EXPR.items())} FROM a GROUP BY 1, 2""")
def telemetry_hourly(v) -> DataFrame:
    out = _hourly(v)
    return out.select("hour_end", "grp", *_HOURLY_COUNTS, *[r6(c).alias(c) for c in _HOURLY_EXPR])


def _specs(v) -> DataFrame:
    return v.scada10.select("grp").distinct().select(
        "grp", F.lit(-30.0).alias("low"), F.lit(90.0).alias("high"), F.lit(36).alias("expected"), F.lit(1800.0).alias("group_capacity"))


def _hourly(v) -> DataFrame:
    return M.hourly_groups(_raw(v), _specs(v))


@query("spike_masking", "A13", f"""
WITH {_RAW} SELECT hour_end, slot, turbine, CASE WHEN power BETWEEN -30 AND 90 THEN power END AS power, power < -30 OR power > 90 AS spike FROM raw""")
def spike_masking(v) -> DataFrame:
    clean, spike = M.mask_spikes("power", -30.0, 90.0)
    return _raw(v).select("hour_end", "slot", "turbine", clean.alias("power"), spike.alias("spike"))


@query("strict_turbine_energy", "A14", """
SELECT hour_end, turbine, count(power) AS n_valid, CASE WHEN count(power) = 6 THEN round(sum(power) + 1e-9, 6) END AS energy FROM scada10 GROUP BY 1, 2""")
def strict_turbine_energy(v) -> DataFrame:
    out = M.strict_turbine_energy(v.scada10, ["hour_end", "turbine"], required=6)
    return out.select("hour_end", "turbine", "n_valid", r6("energy").alias("energy"))


@query("fleet_mean_wind", "A15", """
SELECT hour_end, grp, count(ws) AS n_valid, CASE WHEN count(ws) >= 4 THEN round(avg(ws) + 1e-9, 6) END AS fleet_mean FROM scada10 GROUP BY 1, 2""")
def fleet_mean_wind(v) -> DataFrame:
    out = M.fleet_mean(v.scada10, ["hour_end", "grp"], "ws", 4)
    return out.select("hour_end", "grp", "n_valid", r6("fleet_mean").alias("fleet_mean"))


@query("turbine_wind_bias", "A19", """
WITH m AS (SELECT hour_end, grp, avg(ws) AS m FROM scada10 GROUP BY 1, 2)
SELECT turbine, round(quantile_cont(round(ws - m, 12), 0.5) + 1e-9, 6) + 0 AS bias FROM scada10 s JOIN m ON m.hour_end = s.hour_end AND m.grp = s.grp GROUP BY 1""")
def turbine_wind_bias(v) -> DataFrame:
    return rounded(M.turbine_bias(v.scada10, ["hour_end", "grp"], "turbine", "ws"), ["turbine"], ["bias"])


@query("turbine_direction_bias", "A19 A16", """
WITH m AS (SELECT hour_end, grp, round((degrees(atan2(round(avg(sin(radians(wd))), 12), round(avg(cos(radians(wd))), 12))) % 360 + 360) % 360, 9) AS m FROM scada10 GROUP BY 1, 2)
SELECT turbine, round(quantile_cont(round(((wd - m + 180) % 360 + 360) % 360 - 180, 12), 0.5) + 1e-7, 4) + 0 AS bias
FROM scada10 s JOIN m ON m.hour_end = s.hour_end AND m.grp = s.grp GROUP BY 1""")
def turbine_direction_bias(v) -> DataFrame:
    return rounded(M.turbine_bias(v.scada10, ["hour_end", "grp"], "turbine", "wd", circular=True), ["turbine"], ["bias"], 4)


_BINS = """bn AS (SELECT turbine, floor(ws / 1.5)::BIGINT AS bin, count(*) AS n, quantile_cont(ws, 0.5) AS x, quantile_cont(power / 100, 0.6) AS y
              FROM scada10 GROUP BY 1, 2 HAVING count(*) >= 10)"""


def _curve(v) -> DataFrame:
    return M.binned_curve(v.scada10.withColumn("cf", F.col("power") / 100), "turbine", "ws", "cf", 1.5, 0.6, 10)


@query("power_curve_bins", "A17", f"""
WITH {_BINS} SELECT turbine, bin, n, round(x + 1e-9, 6) AS x, round(y + 1e-9, 6) AS y FROM bn""")
def power_curve_bins(v) -> DataFrame:
    return _curve(v).select("turbine", "bin", "n", r6("x").alias("x"), r6("y").alias("y"))


_ISO = f"""{_BINS},
pts AS (SELECT turbine, x, sum(w * y) / sum(w) AS y, sum(w) AS w FROM (SELECT turbine, x, y, CAST(n AS DOUBLE) AS w FROM bn
        UNION ALL SELECT t.turbine, a.x, a.y, 20.0 FROM (SELECT DISTINCT turbine FROM bn) t,
        (VALUES (0.0, 0.0), (3.0, 0.0), (12.0, 1.0), (20.0, 1.0), (24.99, 1.0)) a(x, y)) GROUP BY 1, 2),
nu AS (SELECT *, row_number() OVER (PARTITION BY turbine ORDER BY x) AS i, sum(w) OVER k AS cw, sum(w * y) OVER k AS cy FROM pts
       WINDOW k AS (PARTITION BY turbine ORDER BY x ROWS UNBOUNDED PRECEDING)),
se AS (SELECT a.turbine, a.i AS lo, b.i AS hi, (b.cy - a.cy + a.w * a.y) / (b.cw - a.cw + a.w) AS m FROM nu a JOIN nu b ON a.turbine = b.turbine AND b.i >= a.i),
mn AS (SELECT p.turbine, p.i, p.x, s.lo, min(s.m) AS m FROM nu p JOIN se s ON s.turbine = p.turbine AND s.lo <= p.i AND s.hi >= p.i GROUP BY ALL),
iso AS (SELECT turbine, i, x, least(greatest(max(m), 0), 1.02) AS y FROM mn GROUP BY ALL)"""


@query("isotonic_power_curve", "A18 A17", f"WITH {_ISO} SELECT turbine, round(x + 1e-9, 6) AS x, round(y + 1e-9, 6) AS y FROM iso")
def isotonic_power_curve(v) -> DataFrame:
    return M.isotonic_curve(_curve(v), "turbine").select("turbine", r6("x").alias("x"), r6("y").alias("y"))


_INTERP = f"""{_ISO},
sg AS (SELECT turbine, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM iso WINDOW w AS (PARTITION BY turbine ORDER BY x)),
fh AS (SELECT hour_end, grp, avg(ws) AS fw FROM scada10 GROUP BY 1, 2),
bi AS (SELECT turbine, min(grp) AS grp, (turbine % 5 - 2) / 4.0 AS bias, 20.0 + turbine % 3 AS rated FROM scada10 GROUP BY 1),
ex AS (SELECT fh.*, bi.turbine, bi.rated, fw + bias AS eff, least(greatest(fw + bias, 0), 24.99) AS a_t FROM fh JOIN bi ON bi.grp = fh.grp),
cv AS (SELECT ex.*, y0 + (a_t - x0) / (x1 - x0) * (y1 - y0) AS cf FROM ex JOIN sg ON sg.turbine = ex.turbine AND a_t >= x0 AND (a_t < x1 OR (a_t = x1 AND x1 = 24.99)))"""


@query("physical_fleet_power", "F37 J19 A18", f"""
WITH {_INTERP}
SELECT hour_end, grp, round(least(greatest(sum(CASE WHEN eff < 3 OR eff >= 25 THEN 0 ELSE least(greatest(cf, 0), 1.02) END * rated), 0), 1.02 * sum(rated)) + 1e-9, 6) AS physical_kwh
FROM cv GROUP BY 1, 2""")
def physical_fleet_power(v) -> DataFrame:
    t = F.col("turbine")
    turbines = v.scada10.select("turbine", "grp").distinct().withColumns({"bias": (t % 5 - 2) / 4.0, "rated": 20.0 + t % 3})
    hours = v.scada10.groupBy("hour_end", "grp").agg(F.avg("ws").alias("fw"))
    knots = M.isotonic_curve(_curve(v), "turbine")
    return rounded(M.physical_fleet(hours, turbines, knots, ["hour_end", "grp"], "fw"), ["hour_end", "grp"], ["physical_kwh"])


@query("availability_by_sector", "A20", """
WITH r AS (SELECT turbine, month(hour_end) AS month, floor(((wd % 360) + 360) % 360 / 45)::BIGINT AS sector, least(power / 60, 1) AS ratio FROM scada10),
g AS (SELECT turbine, avg(ratio) AS g FROM r GROUP BY 1),
c AS (SELECT turbine, month, sector, count(*) AS n, avg(ratio) AS m FROM r GROUP BY 1, 2, 3)
SELECT c.turbine, month, sector, n, round(g + 1e-9, 6) AS availability_global, round(n / (n + 120.0) * m + (1 - n / (n + 120.0)) * g + 1e-9, 6) AS availability
FROM c JOIN g ON g.turbine = c.turbine""")
def availability_by_sector(v) -> DataFrame:
    rows = v.scada10.withColumn("ratio", F.least(F.col("power") / 60, F.lit(1.0)))
    out = M.availability_cells(rows, "turbine", F.month("hour_end"), "wd", "ratio")
    return out.select("turbine", F.col("month").cast("long").alias("month"), F.col("sector").cast("long").alias("sector"), "n",
                      r6("availability_global").alias("availability_global"), r6("availability").alias("availability"))


@query("leave_one_out_peer_median", "W11", """
SELECT a.hour_end, a.slot, a.grp, a.turbine, round(quantile_cont(b.power, 0.5) + 1e-9, 6) AS peer_median
FROM scada10 a LEFT JOIN scada10 b ON a.hour_end = b.hour_end AND a.slot = b.slot AND a.grp = b.grp AND a.turbine <> b.turbine GROUP BY 1, 2, 3, 4""")
def leave_one_out_peer_median(v) -> DataFrame:
    out = M.leave_one_out_median(v.scada10, ["hour_end", "slot", "grp"], "turbine", "power")
    return out.select("hour_end", "slot", "grp", "turbine", r6("peer_median").alias("peer_median"))


# hourly turbine means stand in for readings, so that a timestamp holds several turbines of a farm
_TH = """th AS (SELECT hour_end, grp, turbine, avg(power) / 60 AS pcf, avg(ws) AS w, least(avg(ws) * avg(ws) * avg(ws) / 1728.0, 1.0) AS pot FROM scada10 GROUP BY 1, 2, 3)"""
_ST = f"""{_TH},
va AS (SELECT *, pcf BETWEEN 0 AND 1.05 AND w BETWEEN 0 AND 40 AS valid, pcf BETWEEN 0 AND 1.05 AND w BETWEEN 3 AND 20 AND pot >= 0.1 AS ok FROM th),
ra AS (SELECT *, CASE WHEN ok THEN pcf / pot END AS ratio FROM va),
gm AS (SELECT hour_end, grp, quantile_cont(ratio, 0.5) AS gmed, count(ratio) AS n_ok, coalesce(count(*) FILTER (ratio < 0.7) / CAST(nullif(count(ratio), 0) AS DOUBLE), 0) AS low FROM ra GROUP BY 1, 2),
pe AS (SELECT a.hour_end, a.grp, a.turbine, quantile_cont(b.ratio, 0.5) AS peer FROM ra a LEFT JOIN ra b ON a.hour_end = b.hour_end AND a.grp = b.grp AND a.turbine <> b.turbine GROUP BY 1, 2, 3),
ss AS (SELECT ra.*, peer, CASE WHEN NOT valid THEN 'SENSOR_OR_DATA_ANOMALY' WHEN w < 3 OR pot < 0.1 THEN 'LOW_RESOURCE'
         WHEN ok AND n_ok >= 3 AND ratio <= 0.1 AND peer >= 0.75 THEN 'OUTAGE_LIKE' WHEN ok AND n_ok >= 3 AND gmed <= 0.6 AND low >= 2.0 / 3.0 AND ratio < 0.75 THEN 'CURTAILMENT_LIKE'
         WHEN ok AND n_ok >= 3 AND ratio >= 0.8 AND peer >= 0.75 THEN 'NORMAL' WHEN ok AND n_ok >= 3 AND ratio > 0.1 AND ratio < 0.8 THEN 'PARTIAL_DERATE' ELSE 'UNKNOWN' END AS state
       FROM ra JOIN gm ON gm.hour_end = ra.hour_end AND gm.grp = ra.grp JOIN pe ON pe.hour_end = ra.hour_end AND pe.grp = ra.grp AND pe.turbine = ra.turbine)"""


def _states(v) -> DataFrame:
    mean = F.avg("ws")
    rows = v.scada10.groupBy("hour_end", "grp", "turbine").agg((F.avg("power") / 60).alias("pcf"), mean.alias("w"),
                                                               F.least(mean * mean * mean / 1728.0, F.lit(1.0)).alias("pot"))
    return M.proxy_states(rows, ["hour_end", "grp"], "turbine", "pcf", "w", "pot")


@query("turbine_states", "F33 W11", f"""
WITH {_ST} SELECT hour_end, grp, turbine, state, round(ratio + 1e-9, 6) AS ratio, round(peer + 1e-9, 6) AS peer FROM ss""")
def turbine_states(v) -> DataFrame:
    return _states(v).select("hour_end", "grp", "turbine", "state", r6("ratio").alias("ratio"), r6("peer").alias("peer"))


_FRACTIONS = [f"{s.lower()}_fraction" for s in M.STATES]


def _entropy_sql() -> str:
    terms = [f"CASE WHEN k_{i} > 0 THEN -(k_{i} / n::DOUBLE) * ln(k_{i} / n::DOUBLE) ELSE 0 END" for i in range(7)]
    return " + ".join(terms)


_HS = f"""{_ST},
hc AS (SELECT hour_end, grp, count(*) AS n, count(*) FILTER (ok) AS cells, coalesce(sum(pcf) FILTER (ok), 0) AS p, coalesce(sum(pot) FILTER (ok), 0) AS c,
              coalesce(sum(pcf) FILTER (pcf BETWEEN 0 AND 1.05), 0) AS ap, sum(pot) AS ac, count(*) FILTER (ok AND state = 'UNKNOWN') AS unk,
              {', '.join(f"count(*) FILTER (state = '{s}') AS k_{i}" for i, s in enumerate(M.STATES))} FROM ss GROUP BY 1, 2),
hs AS (SELECT hour_end, grp, cells AS resource_eligible_cells, CASE WHEN c > 0 THEN least(greatest(p / c, 0), 1) END AS availability_factor, ap / 6.0 AS delivered_cf,
              ac / 6.0 AS potential_cf, {_entropy_sql()} AS state_entropy, unk / CAST(greatest(cells, 1) AS DOUBLE) AS unknown_resource_fraction,
              {', '.join(f"k_{i} / CAST(n AS DOUBLE) AS {f}" for i, f in enumerate(_FRACTIONS))} FROM hc)"""
_HS_VALUES = ["availability_factor", "delivered_cf", "potential_cf", "state_entropy", "unknown_resource_fraction", *_FRACTIONS]


def _hour_states(v) -> DataFrame:
    return M.hourly_states(_states(v), ["hour_end", "grp"], F.lit(6.0), "pcf", "w", "pot")


@query("hourly_states", "A21 A22", f"""
WITH {_HS} SELECT hour_end, grp, resource_eligible_cells, {', '.join(f'round({c} + 1e-9, 6) + 0 AS {c}' for c in _HS_VALUES)},
coalesce(availability_factor >= 0.85 AND normal_fraction >= 0.75, false) AS normal_hour FROM hs""")
def hourly_states(v) -> DataFrame:
    return _hour_states(v).select("hour_end", "grp", "resource_eligible_cells", *[r6(c).alias(c) for c in _HS_VALUES], "normal_hour")


@query("confidence_weights", "F32", f"""
WITH {_HS},
cf AS (SELECT hour_end, grp, CASE WHEN availability_factor IS NULL THEN 0 ELSE least(greatest(availability_factor, 0), 1) * normal_fraction * (1 - unknown_resource_fraction)
              * (1 - least(greatest(state_entropy / ln(7), 0), 1)) END AS confidence FROM hs)
SELECT hour_end, grp, round(confidence + 1e-9, 6) AS confidence, round((0.5 + 0.5 * confidence) / avg(0.5 + 0.5 * confidence) OVER () + 1e-9, 6) AS weight FROM cf""")
def confidence_weights(v) -> DataFrame:
    out = M.confidence_weights(_hour_states(v), "availability_factor", "normal_fraction", "unknown_resource_fraction", "state_entropy")
    return out.select("hour_end", "grp", r6("confidence").alias("confidence"), r6("weight").alias("weight"))


def _js_sql() -> str:
    out = []
    for f in _FRACTIONS:
        p, q = f"(t_{f} / t_all)", f"(v_{f} / v_all)"
        for a in (p, q):
            out.append(f"CASE WHEN {a} > 0 THEN 0.5 * {a} * ln({a} / (0.5 * ({p} + {q}))) ELSE 0 END")
    return " + ".join(out)


@query("reliability_gate", "A50 A22", f"""
WITH {_HS},
w AS (SELECT *, day(hour_end) <= 20 AS tr FROM hs),
g AS (SELECT grp, count(availability_factor) FILTER (tr) AS train_resource_hours, count(availability_factor) FILTER (NOT tr) AS valid_resource_hours,
             avg(unknown_resource_fraction) FILTER (tr) AS tu, avg(unknown_resource_fraction) FILTER (NOT tr) AS vu,
             {', '.join(f"avg({f}) FILTER (tr) AS t_{f}, avg({f}) FILTER (NOT tr) AS v_{f}" for f in _FRACTIONS)} FROM w GROUP BY 1),
k AS (SELECT *, {' + '.join(f't_{f}' for f in _FRACTIONS)} AS t_all, {' + '.join(f'v_{f}' for f in _FRACTIONS)} AS v_all FROM g),
j AS (SELECT *, {_js_sql()} AS js FROM k)
SELECT grp, train_resource_hours, valid_resource_hours, round(tu + 1e-9, 6) AS train_unknown, round(vu + 1e-9, 6) AS valid_unknown, round(js + 1e-9, 6) AS state_divergence,
       coalesce(train_resource_hours >= 500 AND valid_resource_hours >= 500 AND tu <= 0.15 AND vu <= 0.15 AND js <= 0.15, false) AS gate FROM j""")
def reliability_gate(v) -> DataFrame:
    rows = _hour_states(v).withColumn("window", F.when(F.day("hour_end") <= 20, "train").otherwise("valid"))
    out = M.reliability_gate(rows, "grp", "window", "train", "valid")
    return out.select("grp", "train_resource_hours", "valid_resource_hours", r6("train_unknown").alias("train_unknown"),
                      r6("valid_unknown").alias("valid_unknown"), r6("state_divergence").alias("state_divergence"), "gate")


@query("telemetry_channel_audit", "A50 S06", f"""
WITH {_RAW}, l AS (SELECT grp, unnest(['power', 'ws', 'wd']) AS channel, unnest([power, ws, wd]) AS value, unnest([-30.0, 0.0, -1e9]) AS lo, unnest([90.0, 40.0, 1e9]) AS hi FROM raw)
SELECT grp, channel, count(*) AS rows, count(value) AS finite_rows, count(*) - count(value) AS missing_rows, min(value) AS minimum, max(value) AS maximum,
       count(*) FILTER (value < lo OR value > hi) AS out_of_range FROM l GROUP BY 1, 2""")
def telemetry_channel_audit(v) -> DataFrame:
    return M.channel_audit(_raw(v), {"power": (-30.0, 90.0), "ws": (0.0, 40.0), "wd": None}, ["grp"])
