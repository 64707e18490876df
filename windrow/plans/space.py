"""Spatial queries: neighbours, interpolation, layout, wake, terrain and lookups."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.functions import geo as G
from windrow.functions.exprs import r6
from windrow.functions.ranks import exact_quantiles
from windrow.operators import spatial as X
from windrow.plans.digest import row_values, row_values_sql
from windrow.plans.registry import query
from windrow.plans.weather import _FULL, _VARS, _complete
from windrow.sources import dimensions as D

RAD = repr(math.pi / 180.0) + 'e0'


def _hav(a: str, b: str) -> str:
    h = (f"pow(sin(({b}.lat - {a}.lat) * {RAD} / 2), 2) + cos({a}.lat * {RAD}) * cos({b}.lat * {RAD}) "
         f"* pow(sin(({b}.lon - {a}.lon) * {RAD} / 2), 2)")
    return f"(6371.0088 * 2 * asin(sqrt(least(greatest({h}, 0), 1))))"


_NN = f"""nn AS (SELECT * FROM (SELECT s.turbine_id, c.grid_id, {_hav('s', 'c')} AS d,
  row_number() OVER (PARTITION BY s.turbine_id ORDER BY round({_hav('s', 'c')}, 9), c.grid_id) AS rn FROM sites s, wx_cells c) WHERE rn <= 4),
nw AS (SELECT *, (1 / pow(d + 0.05, 2)) / sum(1 / pow(d + 0.05, 2)) OVER (PARTITION BY turbine_id) AS w FROM nn)"""


def _near(v) -> DataFrame:
    return X.nearest_cells(v.sites, v.wx_cells, 4)


@query("nearest_cells", "J05 F10 J06", f"""
WITH {_NN} SELECT turbine_id, grid_id, rn AS rank, round(d + 1e-9, 6) AS distance_km, round(w + 1e-9, 6) AS weight FROM nw""")
def nearest_cells(v) -> DataFrame:
    out = X.idw_weights(_near(v))
    return out.select("turbine_id", "grid_id", F.col("rank").cast("long").alias("rank"), r6("distance_km").alias("distance_km"),
                      r6("weight").alias("weight"))


@query("idw_interpolation", "J06 A09", f"""
WITH {_FULL}, {_NN},
x AS (SELECT f.forecast_ts, n.turbine_id, sum(w * gust) AS idw__gust, sum(w * u) AS idw__u, max(gust) FILTER (rn = 1) AS nearest__gust,
             max(u) FILTER (rn = 1) AS nearest__u, stddev_pop(gust) FILTER (rn <= 3) AS near3_std__gust, stddev_pop(u) FILTER (rn <= 3) AS near3_std__u
      FROM wf f JOIN nw n ON n.grid_id = f.grid_id GROUP BY 1, 2)
{row_values_sql('x', ['forecast_ts', 'turbine_id'], ['idw__gust', 'idw__u', 'nearest__gust', 'nearest__u', 'near3_std__gust', 'near3_std__u'])}""")
def idw_interpolation(v) -> DataFrame:
    out = X.interpolate(_complete(v), X.idw_weights(_near(v)), ["gust", "u"], near_k=3)
    return row_values(out, ["forecast_ts", "turbine_id"], ["idw__gust", "idw__u", "nearest__gust", "nearest__u", "near3_std__gust", "near3_std__u"])


@query("spatial_summary", "A07", f"""
SELECT forecast_ts, {', '.join(f'round(avg({c}) + 1e-9, 6) AS global_mean__{c}, round(stddev_pop({c}) + 1e-9, 6) AS global_std__{c}' for c in _VARS)},
       {', '.join(f'round(min({c}) + 1e-9, 6) AS global_min__{c}, round(max({c}) + 1e-9, 6) AS global_max__{c}' for c in ('u', 'v', 'gust'))}
FROM wx GROUP BY 1""")
def spatial_summary(v) -> DataFrame:
    out = X.spatial_summary(v.wx, _VARS, ["u", "v", "gust"])
    return out.select("forecast_ts", *[r6(c).alias(c) for c in out.columns[1:]])


def _turbine_wind(v, static: DataFrame, how: str = "left") -> DataFrame:
    """Wind of every turbine and hour beside ``static``; the turbines of a farm lie in one task."""
    return X.interpolate(_complete(v), X.idw_weights(_near(v)), ["u50", "v50"], static=static, group=["farm"], how=how)


_TW = f"""{_FULL}, {_NN},
tw AS (SELECT f.forecast_ts, s.farm, s.turbine_id, s.lat, s.lon, s.capacity_mw, sum(w * u50) AS tu, sum(w * v50) AS tv
       FROM wf f JOIN nw n ON n.grid_id = f.grid_id JOIN sites s ON s.turbine_id = n.turbine_id GROUP BY ALL)"""


@query("capacity_weighted_statistics", "A10", f"""
WITH {_TW},
x AS (SELECT forecast_ts, farm, sum(capacity_mw * tu) / sum(capacity_mw) AS m,
             sum(capacity_mw * tu * tu) / sum(capacity_mw) AS q, max(tu) - min(tu) AS r FROM tw GROUP BY 1, 2),
y AS (SELECT forecast_ts, farm, m AS tu__cw_mean, sqrt(greatest(q - m * m, 0)) AS tu__cw_std, r AS tu__range FROM x)
{row_values_sql('y', ['forecast_ts', 'farm'], ['tu__cw_mean', 'tu__cw_std', 'tu__range'])}""")
def capacity_weighted_statistics(v) -> DataFrame:
    rows = _turbine_wind(v, v.sites.select("turbine_id", "farm", "capacity_mw")).withColumnRenamed("idw__u50", "tu")
    out = X.capacity_statistics(rows, ["forecast_ts", "farm"], "tu")
    return row_values(out, ["forecast_ts", "farm"], ["tu__cw_mean", "tu__cw_std", "tu__range"])


@query("capacity_weighted_group_mean", "A43", """
WITH x AS (SELECT o.forecast_ts, c.grid_id, CASE WHEN (c.grid_id + hour(o.forecast_ts)) % 3 = 0 THEN NULL ELSE o.gust END AS gust, o.u,
                  3.6 + 0.3 * (c.grid_id % 3) AS capacity_mw FROM wx_obs o JOIN wx_cells c ON c.grid_id = o.grid_id)
SELECT forecast_ts, round(sum(capacity_mw * gust) / nullif(sum(capacity_mw) FILTER (gust IS NOT NULL), 0) + 1e-9, 6) AS gust,
       round(sum(capacity_mw * u) / sum(capacity_mw) + 1e-9, 6) AS u FROM x GROUP BY 1""")
def capacity_weighted_group_mean(v) -> DataFrame:
    rows = v.wx_obs.select(
        "forecast_ts", F.when((F.col("grid_id") + F.hour("forecast_ts")) % 3 != 0, F.col("gust")).alias("gust"), "u",
        (3.6 + 0.3 * (F.col("grid_id") % 3)).alias("capacity_mw"))
    out = X.capacity_weighted(rows, ["forecast_ts"], ["gust", "u"])
    return out.select("forecast_ts", r6("gust").alias("gust"), r6("u").alias("u"))


_XY = """lay AS (SELECT s.farm, s.turbine_id, s.lat, s.lon, s.capacity_mw, s.rotor_m, s.capacity_mw / k.cap AS w,
  (s.lon - k.lon0) * 111.320 * cos(k.lat0 * RAD) AS x, (s.lat - k.lat0) * 110.574 AS y
  FROM sites s JOIN (SELECT farm, sum(capacity_mw) AS cap, sum(capacity_mw * lat) / sum(capacity_mw) AS lat0,
                            sum(capacity_mw * lon) / sum(capacity_mw) AS lon0 FROM sites GROUP BY farm) k ON k.farm = s.farm)""".replace("RAD", RAD)


@query("layout_constants", "A11 J05", f"""
WITH {_NN}, {_XY},
pt AS (SELECT n.turbine_id, min(d) AS nearest, sum(w * d) AS effective FROM nw n GROUP BY 1),
fx AS (SELECT a.farm, max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS ext FROM lay a JOIN lay b ON a.farm = b.farm GROUP BY 1),
gs AS (SELECT quantile_cont(d, 0.5) AS g FROM (SELECT a.grid_id, min({_hav('a', 'b')}) AS d FROM wx_cells a JOIN wx_cells b ON a.grid_id <> b.grid_id GROUP BY 1)),
f AS (SELECT l.farm, sum(l.capacity_mw) AS cap, count(*) AS n, sum(l.w * nearest) AS nm, max(nearest) AS nx, sum(l.w * nearest * nearest) AS nq,
             sum(l.w * effective) AS em FROM lay l JOIN pt ON pt.turbine_id = l.turbine_id GROUP BY 1)
SELECT f.farm, round(cap + 1e-9, 6) AS capacity_mw, n AS turbine_count, round(nm + 1e-9, 6) AS nearest_distance_cw_mean_km,
       round(nx + 1e-9, 6) AS nearest_distance_max_km, round(em + 1e-9, 6) AS idw_effective_distance_cw_mean_km,
       round(sqrt(greatest(nq - nm * nm, 0)) + 1e-7, 4) AS nearest_distance_std_km, round(g + 1e-9, 6) AS grid_spacing_median_km,
       round(nm / greatest(g, 1e-6) + 1e-9, 6) AS nearest_distance_over_grid_spacing, round(ext + 1e-9, 6) AS layout_extent_km
FROM f JOIN fx ON fx.farm = f.farm, gs""")
def layout_constants(v) -> DataFrame:
    out = X.layout_constants(v.sites, _near(v), X.grid_spacing(v.wx_cells))
    values = ["capacity_mw", "nearest_distance_cw_mean_km", "nearest_distance_max_km", "idw_effective_distance_cw_mean_km",
              "grid_spacing_median_km", "nearest_distance_over_grid_spacing", "layout_extent_km"]
    return out.select("farm", "turbine_count", r6("nearest_distance_std_km", 4).alias("nearest_distance_std_km"),
                      *[r6(c).alias(c) for c in values])


_WAKE = list(X.WAKE_FIELDS)


@query("wake_layout_features", "F11 J18 W18 A10", f"""
WITH {_TW}, {_XY},
t AS (SELECT tw.forecast_ts, tw.farm, tw.turbine_id, tu, tv, lay.w, lay.x, lay.y, lay.rotor_m FROM tw JOIN lay ON lay.turbine_id = tw.turbine_id),
rt AS (SELECT farm, sum(w * rotor_m) / 1000 AS rk FROM lay GROUP BY 1),
fl AS (SELECT forecast_ts, farm, sum(w * tu) AS mu, sum(w * tv) AS mv, count(*) AS n FROM t GROUP BY 1, 2),
un AS (SELECT fl.*, rk, sqrt(mu * mu + mv * mv) AS s, CASE WHEN sqrt(mu * mu + mv * mv) > 1e-5 THEN mu / sqrt(mu * mu + mv * mv) ELSE 0 END AS ux,
              CASE WHEN sqrt(mu * mu + mv * mv) > 1e-5 THEN mv / sqrt(mu * mu + mv * mv) ELSE 0 END AS uy FROM fl JOIN rt ON rt.farm = fl.farm),
p AS (SELECT t.*, un.ux, un.uy, un.rk, un.s, un.n, ux * x + uy * y AS pr, -uy * x + ux * y AS cr, sqrt(tu * tu + tv * tv) AS ws
      FROM t JOIN un ON un.forecast_ts = t.forecast_ts AND un.farm = t.farm),
pe AS (SELECT a.forecast_ts, a.farm, b.turbine_id, CASE WHEN a.ux * (b.x - a.x) + a.uy * (b.y - a.y) > 0 THEN
         exp(-pow(abs(-a.uy * (b.x - a.x) + a.ux * (b.y - a.y)) / greatest(0.5 * a.rk + 0.05 * greatest(a.ux * (b.x - a.x) + a.uy * (b.y - a.y), 0), 1e-6), 2))
         / pow(1 + 0.05 * greatest(a.ux * (b.x - a.x) + a.uy * (b.y - a.y), 0) / a.rk, 2) ELSE 0 END AS e
       FROM p a JOIN p b ON a.forecast_ts = b.forecast_ts AND a.farm = b.farm AND a.turbine_id <> b.turbine_id),
pa AS (SELECT forecast_ts, farm, avg(e) AS pm, max(e) AS px, avg(CASE WHEN e > 0.10 THEN 1.0 ELSE 0.0 END) AS act FROM pe GROUP BY 1, 2),
re AS (SELECT forecast_ts, farm, turbine_id, sum(e) AS r FROM pe GROUP BY 1, 2, 3),
pc AS (SELECT p.*, coalesce(re.r, 0) AS r, greatest(ws * (1 - 0.08 * coalesce(re.r, 0)), 0) AS es,
              sum(w * pr) OVER g AS prm, sum(w * ws) OVER g AS wsm FROM p LEFT JOIN re USING (forecast_ts, farm, turbine_id)
       WINDOW g AS (PARTITION BY p.forecast_ts, p.farm)),
x AS (SELECT pc.forecast_ts, pc.farm, max(s) AS flow_speed, max(pr) - min(pr) AS downwind_span_km, max(cr) - min(cr) AS crosswind_span_km,
             arg_min(ws, (round(pr, 12), turbine_id)) AS u0, arg_max(ws, (round(pr, 12), -turbine_id)) AS d0,
             sum(w * (pr - prm) * (ws - wsm)) / sqrt(greatest(sum(w * pow(pr - prm, 2)), 1e-8) * greatest(sum(w * pow(ws - wsm, 2)), 1e-8)) AS projection_ws_correlation,
             sum(w * r) AS wake_receiver_cw_mean, max(r) AS wake_receiver_max, sum(w * es) AS wake_effective_ws_cw_mean,
             (sum(w * pow(ws, 3)) - sum(w * pow(es, 3))) / greatest(sum(w * pow(ws, 3)), 1e-6) AS wake_power_loss_proxy FROM pc GROUP BY 1, 2),
y AS (SELECT x.*, u0 AS upstream_edge_ws, d0 AS downstream_edge_ws, d0 - u0 AS downstream_minus_upstream_ws,
             coalesce(pm, 0) AS wake_pair_mean, coalesce(px, 0) AS wake_pair_max, coalesce(act, 0) AS wake_active_fraction
      FROM x LEFT JOIN pa ON pa.forecast_ts = x.forecast_ts AND pa.farm = x.farm)
{row_values_sql('y', ['forecast_ts', 'farm'], _WAKE)}""")
def wake_layout_features(v) -> DataFrame:
    out = X.wake_features(_turbine_wind(v, v.sites.select("turbine_id", "farm"), "inner"), v.sites, "idw__u50", "idw__v50")
    return row_values(out, ["forecast_ts", "farm"], _WAKE)


@query("edge_turbine_speeds", "W18", f"""
WITH {_TW}, {_XY},
fl AS (SELECT tw.forecast_ts, tw.farm, sum(w * tu) AS mu, sum(w * tv) AS mv FROM tw JOIN lay ON lay.turbine_id = tw.turbine_id GROUP BY 1, 2),
pr AS (SELECT tw.forecast_ts, tw.farm, tw.turbine_id, sqrt(tu * tu + tv * tv) AS s, round((mu * x + mv * y) / greatest(sqrt(mu * mu + mv * mv), 1e-5), 9) AS p
       FROM tw JOIN lay ON lay.turbine_id = tw.turbine_id JOIN fl ON fl.forecast_ts = tw.forecast_ts AND fl.farm = tw.farm)
SELECT forecast_ts, farm, round(arg_min(s, (p, turbine_id)) + 1e-9, 6) AS upstream, round(arg_max(s, (p, turbine_id)) + 1e-9, 6) AS downstream FROM pr GROUP BY 1, 2""")
def edge_turbine_speeds(v) -> DataFrame:
    wind = _turbine_wind(v, X.turbine_places(v.sites), "inner")
    place = X.flow_projection(wind, v.sites, "idw__u50", "idw__v50")
    out = X.edge_speeds(place, ["forecast_ts", "farm"], F.struct(F.round("projection", 9), "turbine_id"), F.hypot("idw__u50", "idw__v50"))
    return row_values(out, ["forecast_ts", "farm"], ["upstream", "downstream"])


_STATIC = """st AS (SELECT turbine_id, farm, capacity_mw, k AS sector, ((turbine_id * 7 + k * 13) % 100) / 100.0 AS slope,
              ((turbine_id * 3 + k * 29) % 90) / 10.0 AS horizon FROM sites, range(16) r(k))"""


def _static(v) -> DataFrame:
    t = F.col("turbine_id")
    rows = v.sites.withColumn("sector", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return rows.select("turbine_id", "farm", "capacity_mw", "sector",
                       ((t * 7 + F.col("sector") * 13) % 100 / 100.0).alias("slope"),
                       ((t * 3 + F.col("sector") * 29) % 90 / 10.0).alias("horizon"))


def _farm_wind(v) -> DataFrame:
    rows = _turbine_wind(v, v.sites.select("turbine_id", "farm", "capacity_mw"))
    return X.capacity_weighted(rows.withColumnsRenamed({"idw__u50": "fu", "idw__v50": "fv"}), ["forecast_ts", "farm"], ["fu", "fv"])


_FW = f"""{_TW},
fw AS (SELECT forecast_ts, farm, sum(capacity_mw * tu) / sum(capacity_mw) AS fu, sum(capacity_mw * tv) / sum(capacity_mw) AS fv FROM tw GROUP BY 1, 2)"""
_EXPO = ["slope_cw_mean", "slope_cw_std", "horizon_cw_mean", "horizon_cw_std"]


@query("directional_exposure", "J07", f"""
WITH {_FW}, {_STATIC},
h AS (SELECT *, CAST(floor((((degrees(atan2(-fu, -fv)) % 360 + 360) % 360) + 11.25) / 22.5) AS BIGINT) % 16 AS sector FROM fw),
m AS (SELECT farm, sector, sum(capacity_mw * slope) / sum(capacity_mw) AS slope_cw_mean, sum(capacity_mw * horizon) / sum(capacity_mw) AS horizon_cw_mean FROM st GROUP BY 1, 2),
y AS (SELECT h.forecast_ts, h.farm, h.sector, any_value(slope_cw_mean) AS slope_cw_mean, any_value(horizon_cw_mean) AS horizon_cw_mean,
             sqrt(sum(capacity_mw * pow(slope - slope_cw_mean, 2)) / sum(capacity_mw)) AS slope_cw_std, sqrt(sum(capacity_mw * pow(horizon - horizon_cw_mean, 2)) / sum(capacity_mw)) AS horizon_cw_std
      FROM h JOIN st ON st.farm = h.farm AND st.sector = h.sector JOIN m ON m.farm = h.farm AND m.sector = h.sector GROUP BY 1, 2, 3)
{row_values_sql('y', ['forecast_ts', 'farm', 'sector'], _EXPO)}""")
def directional_exposure(v) -> DataFrame:
    out = X.directional_exposure(_farm_wind(v), _static(v), ["slope", "horizon"], "fu", "fv")
    return row_values(out.withColumn("sector", F.col("sector").cast("long")), ["forecast_ts", "farm", "sector"], _EXPO)


_GWA = ["alignment__r1", "alignment__r2", "resource_curve__capacity", "resource_curve__r2"]


@query("static_resource_alignment", "J08 F02", f"""
WITH {_FW}, {_XY},
ra AS (SELECT lay.*, ((turbine_id * 37) % 50) / 10.0 + 4 AS r1, 0.2 + ((turbine_id * 11) % 50) / 100.0 AS r2 FROM lay),
s0 AS (SELECT farm, sum(w * r1) AS m1, sum(w * r2) AS m2 FROM ra GROUP BY 1),
s1 AS (SELECT ra.*, r1 / m1 AS ratio, w * r2 / m2 AS wr2, (r1 - m1) / greatest(sqrt(sum(w * pow(r1 - m1, 2)) OVER (PARTITION BY ra.farm)), 1e-12) AS z1,
              (r2 - m2) / greatest(sqrt(sum(w * pow(r2 - m2, 2)) OVER (PARTITION BY ra.farm)), 1e-12) AS z2 FROM ra JOIN s0 ON s0.farm = ra.farm),
h AS (SELECT *, sqrt(fu * fu + fv * fv) AS s FROM fw),
k AS (SELECT h.forecast_ts, h.farm, s1.*, CASE WHEN s > 1e-8 THEN fu / s ELSE 0 END * x + CASE WHEN s > 1e-8 THEN fv / s ELSE 0 END * y AS al,
             least(greatest((pow(greatest(2.5 * s * ratio, 0), 3) - 27) / (1728 - 27), 0), 1) AS cu FROM h JOIN s1 ON s1.farm = h.farm),
c AS (SELECT *, al - sum(w * al) OVER g AS ac FROM k WINDOW g AS (PARTITION BY forecast_ts, farm)),
x AS (SELECT forecast_ts, farm, CASE WHEN sqrt(sum(w * ac * ac)) > 1e-12 THEN sum(w * ac * z1) / sqrt(sum(w * ac * ac)) ELSE 0 END AS alignment__r1,
             CASE WHEN sqrt(sum(w * ac * ac)) > 1e-12 THEN sum(w * ac * z2) / sqrt(sum(w * ac * ac)) ELSE 0 END AS alignment__r2,
             sum(w * cu) AS resource_curve__capacity, sum(wr2 * cu) AS resource_curve__r2 FROM c GROUP BY 1, 2)
{row_values_sql('x', ['forecast_ts', 'farm'], _GWA)}""")
def static_resource_alignment(v) -> DataFrame:
    t = F.col("turbine_id")
    turbines = v.sites.withColumns({"r1": (t * 37) % 50 / 10.0 + 4, "r2": 0.2 + (t * 11) % 50 / 100.0})
    wind = _farm_wind(v).withColumn("hub", 2.5 * F.hypot("fu", "fv"))
    out = X.along_flow_alignment(wind, turbines, ["r1", "r2"], "fu", "fv", "hub", "r1", ["r2"])
    return row_values(out, ["forecast_ts", "farm"], _GWA)


@query("turbine_expansion", "J19", f"""
WITH {_FW},
k AS (SELECT farm, avg(lat) AS la, avg(lon) AS lo, sum(capacity_mw) AS cap, count(*) AS n FROM sites GROUP BY 1),
d AS (SELECT s.farm, s.turbine_id, (dense_rank() OVER (PARTITION BY s.farm ORDER BY s.turbine_id) - 1) / CAST(greatest(n - 1, 1) AS DOUBLE) AS turbine_index_fraction,
             s.lat - la AS lat_offset, s.lon - lo AS lon_offset, s.capacity_mw / cap AS capacity_fraction FROM sites s JOIN k ON k.farm = s.farm),
x AS (SELECT d.*, fw.forecast_ts, fw.fu FROM fw JOIN d ON d.farm = fw.farm)
{row_values_sql('x', ['forecast_ts', 'farm', 'turbine_id'], ['fu', 'turbine_index_fraction', 'lat_offset', 'lon_offset', 'capacity_fraction'])}""")
def turbine_expansion(v) -> DataFrame:
    out = X.expand_turbines(_farm_wind(v), v.sites)
    return row_values(out, ["forecast_ts", "farm", "turbine_id"], ["fu", "turbine_index_fraction", "lat_offset", "lon_offset", "capacity_fraction"])


_PT = """pt AS (SELECT turbine_id, farm, lat + 0.00037 AS lat, lon + 0.00061 AS lon, (lat + 0.00037 - 37.2) * 1000 AS r, (lon + 0.00061 - 128.9) * 1000 AS c FROM sites)"""
_BIL = f"""{_PT},
co AS (SELECT pt.*, i, j, floor(r)::BIGINT + i AS rr, floor(c)::BIGINT + j AS cc,
              (CASE WHEN i = 1 THEN r - floor(r) ELSE 1 - (r - floor(r)) END) * (CASE WHEN j = 1 THEN c - floor(c) ELSE 1 - (c - floor(c)) END) AS w
       FROM pt, range(2) a(i), range(2) b(j)),
el AS (SELECT turbine_id, CASE WHEN count(z) = 4 THEN sum(w * z) END AS z FROM co LEFT JOIN dem ON dem.row_no = rr AND dem.col_no = cc GROUP BY 1)"""


def _points(v) -> DataFrame:
    p = v.sites.select("turbine_id", "farm", (F.col("lat") + 0.00037).alias("lat"), (F.col("lon") + 0.00061).alias("lon"))
    return p.withColumns({"r": (F.col("lat") - 37.2) * 1000, "c": (F.col("lon") - 128.9) * 1000})


@query("bilinear_sampling", "F28", f"WITH {_BIL} SELECT turbine_id, round(z + 1e-9, 6) AS z FROM el")
def bilinear_sampling(v) -> DataFrame:
    return X.bilinear(_points(v), v.dem, "r", "c", "z", ["turbine_id"]).select("turbine_id", r6("z").alias("z"))


_HOR = [f"horizon_angle_r{r:04d}m" for r in (500, 1000, 2000, 5000)]


@query("terrain_horizon", "J17 F10", f"""
WITH {_BIL},
m AS (SELECT pt.turbine_id, dem.z - el.z AS dz, (dem.lat - pt.lat) * {RAD} * 6371008.8e0 AS nn, (dem.lon - pt.lon) * {RAD} * 6371008.8e0 * cos(pt.lat * {RAD}) AS ee
      FROM pt JOIN el ON el.turbine_id = pt.turbine_id AND el.z IS NOT NULL JOIN dem ON abs(dem.lat - pt.lat) < 0.05 AND abs(dem.lon - pt.lon) < 0.06),
d AS (SELECT *, sqrt(ee * ee + nn * nn) AS dist, (degrees(atan2(ee, nn)) % 360 + 360) % 360 AS be FROM m),
x AS (SELECT d.*, k AS sector FROM d, range(16) s(k) WHERE dist BETWEEN 100 AND 5000 AND abs(((be - k * 22.5 + 180) % 360 + 360) % 360 - 180) <= 11.25)
SELECT turbine_id, sector, {', '.join(f"round(max(degrees(atan2(dz, dist))) FILTER (dist <= {r}) + 1e-9, 6) AS horizon_angle_r{r:04d}m" for r in (500, 1000, 2000, 5000))}
FROM x GROUP BY 1, 2""")
def terrain_horizon(v) -> DataFrame:
    points = _points(v)
    z0 = X.bilinear(points, v.dem, "r", "c", "z", ["turbine_id"])
    out = X.horizon_angles(points, v.dem, z0)
    return out.select("turbine_id", F.col("sector").cast("long").alias("sector"), *[r6(c).alias(c) for c in _HOR])


@query("terrain_slope_alignment", "J17", f"""
WITH {_PT},
g AS (SELECT turbine_id, pt.lat, floor(r + 0.5)::BIGINT AS ri, floor(c + 0.5)::BIGINT AS ci FROM pt),
n AS (SELECT turbine_id, g.lat, max(z) FILTER (row_no = ri AND col_no = ci - 1) AS zw, max(z) FILTER (row_no = ri AND col_no = ci + 1) AS ze,
             max(z) FILTER (row_no = ri - 1 AND col_no = ci) AS zs, max(z) FILTER (row_no = ri + 1 AND col_no = ci) AS zn
      FROM g JOIN dem ON abs(row_no - ri) + abs(col_no - ci) = 1 GROUP BY 1, 2),
s AS (SELECT turbine_id, (ze - zw) / (2 * 0.001 * pi() * 6371008.8e0 / 180 * cos(lat * {RAD})) AS dx, (zn - zs) / (2 * 0.001 * pi() * 6371008.8e0 / 180) AS dy FROM n)
SELECT turbine_id, k AS sector, round(dx * sin(k * 22.5 * {RAD}) + dy * cos(k * 22.5 * {RAD}) + 1e-9, 6) + 0 AS signed_slope_alignment FROM s, range(16) t(k)""")
def terrain_slope_alignment(v) -> DataFrame:
    grad = X.lattice_gradient(_points(v), v.dem, "r", "c", "lat", 0.001, ["turbine_id"])
    theta = F.radians(F.col("sector") * 22.5)
    out = grad.withColumn("sector", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    return out.select("turbine_id", "sector", r6(F.col("dz_dx") * F.sin(theta) + F.col("dz_dy") * F.cos(theta)).alias("signed_slope_alignment"))


_INFO = """inf AS (SELECT s_suppkey AS row_no, CASE WHEN s_suppkey % 6 = 0 THEN floor(s_suppkey / 6) + 1 END AS grp,
  concat(37 + s_suppkey % 3, '°', s_suppkey % 60, '''', (s_suppkey * 7) % 60, '.', s_suppkey % 10, '"N ', 128, '°', (s_suppkey * 11) % 60, '''',
         (s_suppkey * 13) % 60, '.5"E') AS coord, 100.0 + s_nationkey AS hub, 120.0 + s_nationkey % 7 AS rotor, 3.6 AS mw FROM supplier)"""


def _info(v) -> DataFrame:
    s = F.col("s_suppkey")
    text = F.concat((37 + s % 3).cast("string"), F.lit("°"), (s % 60).cast("string"), F.lit("'"), ((s * 7) % 60).cast("string"), F.lit("."),
                    (s % 10).cast("string"), F.lit('"N 128°'), ((s * 11) % 60).cast("string"), F.lit("'"), ((s * 13) % 60).cast("string"), F.lit('.5"E'))
    return v.table("supplier").select(
        s.alias("row_no"), F.when(s % 6 == 0, F.floor(s / 6) + 1).alias("grp"), text.alias("coord"),
        (100.0 + F.col("s_nationkey")).alias("hub"), (120.0 + F.col("s_nationkey") % 7).alias("rotor"), F.lit(3.6).alias("mw"))


@query("site_dimension", "S02 S03 F30", f"""
WITH {_INFO},
ff AS (SELECT *, last_value(grp IGNORE NULLS) OVER (ORDER BY row_no) AS g, regexp_extract_all(upper(coord), '[0-9.]+|[NSEW]') AS t FROM inf),
co AS (SELECT *, t[1]::DOUBLE + t[2]::DOUBLE / 60 + t[3]::DOUBLE / 3600 AS lat, t[5]::DOUBLE + t[6]::DOUBLE / 60 + t[7]::DOUBLE / 3600 AS lon FROM ff)
SELECT CAST(g AS BIGINT) AS grp, count(*) AS turbines, round(avg(lat) + 1e-9, 6) AS lat, round(avg(lon) + 1e-9, 6) AS lon,
       round(avg(hub) + 1e-9, 6) AS hub_height_m, round(avg(rotor) + 1e-9, 6) AS rotor_diameter_m, round(sum(mw) * 1000 + 1e-9, 6) AS capacity_kwh FROM co GROUP BY g""")
def site_dimension(v) -> DataFrame:
    turbines = D.turbine_rows(_info(v), "row_no", "grp", "coord", "hub", "rotor", "mw")
    out = D.group_sites(turbines, "grp")
    return out.select("grp", "turbines", *[r6(c).alias(c) for c in ("lat", "lon", "hub_height_m", "rotor_diameter_m", "capacity_kwh")])


@query("turbine_dimension_checks", "S03", """
SELECT 'duplicate_turbine' AS rule, count(*) AS n FROM (SELECT turbine_id % 90 AS k FROM sites GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'incomplete', CAST(0 AS BIGINT)
UNION ALL SELECT 'capacity_mismatch', count(*) FROM (SELECT farm FROM sites GROUP BY 1 HAVING abs(sum(capacity_mw) * 1000 - 23400) > 1e-6)
UNION ALL SELECT 'uncovered_group', CAST(1 AS BIGINT)""")
def turbine_dimension_checks(v) -> DataFrame:
    rows = v.sites.withColumn("turbine", F.col("turbine_id") % 90)
    expected = v.sites.select("farm").distinct().unionByName(v.sites.limit(1).select(F.lit("f_none").alias("farm"))).withColumn("capacity_kwh", F.lit(23400.0))
    return D.turbine_checks(rows, expected, "farm", ["turbine"], ["lat", "lon", "capacity_mw"])
