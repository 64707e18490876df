"""Association, redundancy and lineage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.functions.exprs import r6
from windrow.functions.ranks import AS241
from windrow.operators import association as A
from windrow.operators import lineage as L
from windrow.operators import utility as U
from windrow.plans.registry import query
from windrow.plans.scoring import _ELIG, _MEANS_SQL, _u
from windrow.session import stored

_NAMES_SQL = """fn AS (SELECT p_partkey AS position, CASE p_partkey % 7 WHEN 0 THEN 'time__' || ['hour_sin', 'doy_cos', 'lead_hours', 'run_position'][p_size % 4 + 1]
  WHEN 1 THEN 'site__' || ['latitude', 'hub_height_m'][p_size % 2 + 1] WHEN 2 THEN 'cross__' || ['hub_ws_mean', 'ws10_difference'][p_size % 2 + 1] || ['', '__run_lag_1h', '__run_curvature_3h'][p_partkey % 3 + 1]
  WHEN 3 THEN 'ldaps__' || ['raw_missing_cells', 'rank2_distance_km'][p_size % 2 + 1]
  WHEN 4 THEN 'ldaps__' || ['idw', 'global_std', 'near4_std'][p_size % 3 + 1] || '__' || ['heightAboveGround_10_10u', 'heightAboveGround_2_SWDIR', 'etc_0_hcc', 'surface_0_snol', 'surface_0_sp', 'etc_0_blh', 'surface_0_lsm'][p_partkey % 7 + 1 - 4 + p_size % 4]
  WHEN 5 THEN 'gfs__' || ['idw', 'nearest', 'rank3', 'global_max'][p_size % 4 + 1] || '__' || ['isobaricInhPa_850_t', 'surface_0_gust', 'atmosphere_0_tcc', 'surface_0_prate', 'isobaricInhPa_500_gh'][p_size % 5 + 1]
  ELSE 'gfs__idw__' || ['ws10', 'hub_ws', 'air_density', 'gust_ratio', 'shear_alpha_10_100'][p_size % 5 + 1] || ['', '__run_lead_3h', '__run_gradient_1h'][p_partkey % 3 + 1] END AS feature FROM part)"""


def _names(v) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(x) for x in values]), (i).cast("int"))
    lit = F.lit
    name = (
        F.when(k % 7 == 0, F.concat(lit("time__"), pick(["hour_sin", "doy_cos", "lead_hours", "run_position"], s % 4 + 1)))
        .when(k % 7 == 1, F.concat(lit("site__"), pick(["latitude", "hub_height_m"], s % 2 + 1)))
        .when(k % 7 == 2, F.concat(lit("cross__"), pick(["hub_ws_mean", "ws10_difference"], s % 2 + 1), pick(["", "__run_lag_1h", "__run_curvature_3h"], k % 3 + 1)))
        .when(k % 7 == 3, F.concat(lit("ldaps__"), pick(["raw_missing_cells", "rank2_distance_km"], s % 2 + 1)))
        .when(k % 7 == 4, F.concat(lit("ldaps__"), pick(["idw", "global_std", "near4_std"], s % 3 + 1), lit("__"), pick(
            ["heightAboveGround_10_10u", "heightAboveGround_2_SWDIR", "etc_0_hcc", "surface_0_snol", "surface_0_sp", "etc_0_blh", "surface_0_lsm"], k % 7 + 1 - 4 + s % 4)))
        .when(k % 7 == 5, F.concat(lit("gfs__"), pick(["idw", "nearest", "rank3", "global_max"], s % 4 + 1), lit("__"), pick(
            ["isobaricInhPa_850_t", "surface_0_gust", "atmosphere_0_tcc", "surface_0_prate", "isobaricInhPa_500_gh"], s % 5 + 1)))
        .otherwise(F.concat(lit("gfs__idw__"), pick(["ws10", "hub_ws", "air_density", "gust_ratio", "shear_alpha_10_100"], s % 5 + 1), pick(["", "__run_lead_3h", "__run_gradient_1h"], k % 3 + 1)))
    )
    return v.table("part").select(k.alias("position"), name.alias("feature"))


def _family_sql() -> str:
    leaf = "list_last(string_split(regexp_replace(lower(feature), '__run_(lag|lead|gradient|curvature)_[13]h$', ''), '__'))"
    tests = [f"WHEN {leaf} IN ({', '.join(repr(x) for x in leaves)})" + ("".join(f" OR starts_with({leaf}, '{p}')" for p in A.WIND_HEIGHT_PREFIXES) if family == "wind" else "") + f" THEN '{family}'"
             for family, leaves in A.LEAF_FAMILIES.items()]
    return ("CASE WHEN lower(feature) IN ('time__lead_hours', 'time__run_position') THEN 'lead' WHEN starts_with(feature, 'time__') THEN 'calendar' WHEN starts_with(feature, 'site__') THEN 'static_site' "
            "WHEN starts_with(feature, 'cross__') THEN 'cross_source_wind' WHEN contains(feature, 'raw_missing') OR contains(feature, 'distance_km') THEN 'quality_geometry' " + " ".join(tests) + " END")


_TAX = f"""{_NAMES_SQL},
tx AS (SELECT position, feature, {_family_sql()} AS physical_family FROM fn),
tm AS (SELECT *, regexp_matches(lower(feature), '{A.RUN_PATTERN}') OR feature IN ('time__lead_hours', 'time__run_position') AS run_dynamics, regexp_matches(lower(feature), '{A.SPATIAL_PATTERN}') OR regexp_matches(lower(feature), '{A.RANK_DISTANCE_PATTERN}') AS spatial_redundancy,
   physical_family IN ({', '.join(repr(f) for f in A.NONWIND_FAMILIES)}) AS nonwind_atmospheric, starts_with(feature, 'cross__') AS cross_source_disagreement FROM tx)"""


@query("feature_taxonomy", "P04", f"WITH {_TAX} SELECT * FROM tm")
def feature_taxonomy(v) -> DataFrame:
    return A.taxonomy(_names(v))


@query("features_after_exit", "P05 P04", f"WITH {_TAX} SELECT position, feature FROM tm WHERE NOT nonwind_atmospheric")
def features_after_exit(v) -> DataFrame:
    return A.kept_features(A.taxonomy(_names(v)), "nonwind_atmospheric").select("position", "feature")


@query("top_features_by_gain", "P06", """
SELECT p_partkey AS position, p_retailprice AS gain FROM part ORDER BY floor(p_retailprice / 50) DESC, p_partkey LIMIT 200""")
def top_features_by_gain(v) -> DataFrame:
    rows = v.table("part").select(F.col("p_partkey").alias("position"), F.col("p_retailprice").alias("gain"), F.floor(F.col("p_retailprice") / 50).alias("g"))
    return A.top_by_gain(rows, 200, "g").select("position", "gain")


def _ndtri_sql(p: str) -> str:
    def poly(c, x):
        out = repr(c[-1]) + "e0" if "e" not in repr(c[-1]) else repr(c[-1])
        for k in reversed(c[:-1]):
            out = f"({out} * {x} + {repr(k) if 'e' in repr(k) else repr(k) + 'e0'})"
        return out

    q = f"({p} - 0.5)"
    r = f"(0.180625 - {q} * {q})"
    t = f"sqrt(-ln(least({p}, 1 - {p})))"
    mid = f"{q} * {poly(AS241['a'], r)} / {poly(AS241['b'], r)}"
    near = f"{poly(AS241['c'], f'({t} - 1.6)')} / {poly(AS241['d'], f'({t} - 1.6)')}"
    far = f"{poly(AS241['e'], f'({t} - 5)')} / {poly(AS241['f'], f'({t} - 5)')}"
    tail = f"CASE WHEN {t} <= 5 THEN {near} ELSE {far} END"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {mid} WHEN {q} < 0 THEN -({tail}) ELSE {tail} END"


_RANK = lambda c, part: f"(rank() OVER (PARTITION BY {part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {part}, {c}) - 1) / 2.0)"


@query("rank_associations", "A35 W09", f"""
WITH x AS (SELECT grp, base / capacity AS x, (actual - base) / capacity AS y, actual AS w FROM fcst WHERE {_ELIG}),
r AS (SELECT *, {_RANK('x', 'grp')} AS rx, {_RANK('y', 'grp')} AS ry, CAST(count(*) OVER (PARTITION BY grp) AS DOUBLE) AS n FROM x),
z AS (SELECT *, {_ndtri_sql('((rx - 0.5) / n)')} AS zx, {_ndtri_sql('((ry - 0.5) / n)')} AS zy, sum(w * rx) OVER g / sum(w) OVER g AS mx, sum(w * ry) OVER g / sum(w) OVER g AS my FROM r WINDOW g AS (PARTITION BY grp))
SELECT grp, count(*) AS n_valid, round(corr(rx, ry) + 1e-9, 6) AS spearman, round(sum(w * (rx - mx) * (ry - my)) / sqrt(sum(w * pow(rx - mx, 2)) * sum(w * pow(ry - my, 2))) + 1e-9, 6) AS weighted_spearman,
       round(corr(zx, zy) + 1e-9, 6) AS rank_normal_pearson FROM z GROUP BY 1""")
def rank_associations(v) -> DataFrame:
    cap = F.col("capacity")
    rows = v.fcst.where(F.col("actual") >= 0.10 * cap).select("grp", (F.col("base") / cap).alias("x"), ((F.col("actual") - F.col("base")) / cap).alias("y"), F.col("actual").alias("w"))
    out = A.pair_associations(rows, ["grp"], "x", "y", "w")
    return out.select("grp", "n_valid", *[r6(c).alias(c) for c in ("spearman", "weighted_spearman", "rank_normal_pearson")])


@query("energy_weighted_auc", "A36", f"""
WITH x AS (SELECT grp, cand / capacity AS x, (abs(base - actual) / capacity <= 0.06)::INT AS l, actual AS w FROM fcst WHERE {_ELIG}),
d AS (SELECT grp, x, coalesce(sum(w) FILTER (l = 1), 0) AS p, coalesce(sum(w) FILTER (l = 0), 0) AS q, count(*) AS n FROM x GROUP BY 1, 2),
c AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY grp ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS qb FROM d)
SELECT grp, CAST(sum(n) AS BIGINT) AS n_valid, round(sum(p * (qb + 0.5 * q)) / (sum(p) * sum(q)) + 1e-9, 6) AS weighted_auc FROM c GROUP BY 1""")
def energy_weighted_auc(v) -> DataFrame:
    cap = F.col("capacity")
    rows = v.fcst.where(F.col("actual") >= 0.10 * cap).select(
        "grp", (F.col("cand") / cap).alias("x"), (F.abs(F.col("base") - F.col("actual")) / cap <= 0.06).cast("double").alias("l"), F.col("actual").alias("w"))
    return A.weighted_auc(rows, ["grp"], "x", "l", "w").withColumn("weighted_auc", r6("weighted_auc"))


_STRATA = """sx AS (SELECT grp, ts, actual, base, cand, third, capacity, grp AS s_group, CAST(year(ts) % 3 AS VARCHAR) AS s_fold,
  'lead_bin_' || ((day(ts) >= 6)::INT + (day(ts) >= 12)::INT + (day(ts) >= 18)::INT + (day(ts) >= 24)::INT) AS s_lead,
  CASE WHEN month(ts) IN (12, 1, 2) THEN 'DJF' WHEN month(ts) <= 5 THEN 'MAM' WHEN month(ts) <= 8 THEN 'JJA' ELSE 'SON' END AS s_season,
  'control_cf_bin_' || ((base / capacity >= 0.25)::INT + (base / capacity >= 0.5)::INT + (base / capacity >= 0.75)::INT) AS s_cf FROM fcst)"""


def _stratified(v) -> DataFrame:
    labels = A.strata(F.day("ts"), F.month("ts"), F.col("base") / F.col("capacity"), F.col("grp"), F.year("ts") % 3)
    return v.fcst.withColumns(labels)


@query("strata_labels", "W19", f"WITH {_STRATA} SELECT s_group AS \"group\", s_fold AS fold, s_lead AS lead_bin, s_season AS season, s_cf AS control_cf_bin, count(*) AS n FROM sx GROUP BY ALL")
def strata_labels(v) -> DataFrame:
    return _stratified(v).groupBy("group", "fold", "lead_bin", "season", "control_cf_bin").agg(F.count(F.lit(1)).alias("n"))


_FEATURES = ["cand_cf", "third_cf", "day_no"]
_CONT = ["signed_residual_cf", "plus_vs_minus_utility"]
_BIN = ["within_6", "within_8"]
_LABELS = ["group", "fold", "lead_bin", "season", "control_cf_bin"]


def _map_sql() -> str:
    return f"""{_STRATA},
{_MEANS_SQL},
ma2 AS (SELECT sx.*, mean_actual, cand / capacity AS cand_cf, third / capacity AS third_cf, CAST(day(ts) AS DOUBLE) AS day_no, (actual - base) / capacity AS signed_residual_cf,
   {_u('(base + 0.01 * capacity)')} - {_u('(base - 0.01 * capacity)')} AS plus_vs_minus_utility, (abs((actual - base) / capacity) <= 0.06)::INT AS within_6, (abs((actual - base) / capacity) <= 0.08)::INT AS within_8
   FROM sx JOIN ma ON ma.grp = sx.grp WHERE {_ELIG}),
sl AS (SELECT *, unnest(['all', 'group=' || s_group, 'fold=' || s_fold, 'lead_bin=' || s_lead, 'season=' || s_season, 'control_cf_bin=' || s_cf]) AS slice FROM ma2),
fp AS (SELECT slice, actual AS w, unnest({_FEATURES}) AS feature, unnest([cand_cf, third_cf, day_no]) AS x, signed_residual_cf, plus_vs_minus_utility, within_6, within_8 FROM sl),
cp AS (SELECT slice, w, feature, x, unnest({_CONT}) AS target, round(unnest([signed_residual_cf, plus_vs_minus_utility]), 12) AS y FROM fp),
cr AS (SELECT *, {_RANK('x', 'slice, feature, target')} AS rx, {_RANK('y', 'slice, feature, target')} AS ry, CAST(count(*) OVER (PARTITION BY slice, feature, target) AS DOUBLE) AS n FROM cp),
cz AS (SELECT *, {_ndtri_sql('((rx - 0.5) / n)')} AS zx, {_ndtri_sql('((ry - 0.5) / n)')} AS zy, sum(w * rx) OVER g / sum(w) OVER g AS mx, sum(w * ry) OVER g / sum(w) OVER g AS my FROM cr WINDOW g AS (PARTITION BY slice, feature, target)),
ca AS (SELECT slice, feature, target, count(*) AS n_valid, corr(rx, ry) AS spearman, sum(w * (rx - mx) * (ry - my)) / sqrt(sum(w * pow(rx - mx, 2)) * sum(w * pow(ry - my, 2))) AS weighted_spearman, corr(zx, zy) AS rank_normal_pearson
   FROM cz GROUP BY 1, 2, 3 HAVING count(*) >= 30),
bp AS (SELECT slice, w, feature, x, unnest({_BIN}) AS target, unnest([within_6, within_8]) AS l FROM fp),
bd AS (SELECT slice, feature, target, x, coalesce(sum(w) FILTER (l = 1), 0) AS p, coalesce(sum(w) FILTER (l = 0), 0) AS q, count(*) AS n FROM bp GROUP BY 1, 2, 3, 4),
bc AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY slice, feature, target ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS qb FROM bd),
ba AS (SELECT slice, feature, target, CAST(sum(n) AS BIGINT) AS n_valid, CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN sum(p * (qb + 0.5 * q)) / (sum(p) * sum(q)) END AS weighted_auc FROM bc GROUP BY 1, 2, 3 HAVING sum(n) >= 30),
al AS (SELECT slice, feature, target, 'continuous' AS kind, n_valid, spearman, weighted_spearman, rank_normal_pearson, NULL::DOUBLE AS weighted_auc, weighted_spearman AS val, weighted_spearman AS edge FROM ca
   UNION ALL SELECT slice, feature, target, 'binary', n_valid, NULL, NULL, NULL, weighted_auc, weighted_auc, weighted_auc - 0.5 FROM ba),
ov AS (SELECT * FROM al WHERE slice = 'all'),
st AS (SELECT o.feature, o.target, count(s.val) AS valid_slice_count, avg(s.val) AS mean_slice, min(s.val) AS minimum_slice, max(s.val) AS maximum_slice,
   count(*) FILTER (abs(s.edge) > 1e-12) AS sign_slice_count, avg((sign(s.edge) = sign(o.edge))::INT) FILTER (abs(s.edge) > 1e-12) AS sign_stability,
   avg((sign(s.edge) = sign(o.edge))::INT) FILTER (abs(s.edge) > 1e-12 AND starts_with(s.slice, 'group=')) AS group_sign_stability,
   avg((sign(s.edge) = sign(o.edge))::INT) FILTER (abs(s.edge) > 1e-12 AND starts_with(s.slice, 'fold=')) AS fold_sign_stability
   FROM ov o JOIN al s ON s.feature = o.feature AND s.target = o.target AND s.slice <> 'all' AND s.val IS NOT NULL GROUP BY 1, 2),
am AS (SELECT ov.feature, ov.target, kind, n_valid, spearman, weighted_spearman, rank_normal_pearson, weighted_auc, CASE WHEN kind = 'binary' THEN 2 * (weighted_auc - 0.5) ELSE weighted_spearman END AS signed,
   abs(CASE WHEN kind = 'binary' THEN 2 * (weighted_auc - 0.5) ELSE weighted_spearman END) AS strength, st.* EXCLUDE (feature, target) FROM ov JOIN st ON st.feature = ov.feature AND st.target = ov.target)"""


_MAPSQL = _map_sql()
_MAP_VALUES = ["spearman", "weighted_spearman", "rank_normal_pearson", "weighted_auc", "signed", "strength", "mean_slice", "minimum_slice", "maximum_slice", "sign_stability", "group_sign_stability", "fold_sign_stability"]


def _map_rows(v) -> DataFrame:
    rows = U.score_aware_targets(_stratified(v)).where(F.col("eligible") == 1.0)
    cap = F.col("capacity")
    return rows.withColumns({"cand_cf": F.col("cand") / cap, "third_cf": F.col("third") / cap, "day_no": F.day("ts").cast("double"),
                             "plus_vs_minus_utility": F.round("plus_vs_minus_utility", 12), "signed_residual_cf": F.round("signed_residual_cf", 12)})


def _associations(rows: DataFrame) -> DataFrame:
    return A.association_map(rows, _FEATURES, _CONT, _BIN, "actual", _LABELS)


@query("association_map", "A38 A35 A36 A37 F20", f"WITH {_MAPSQL} SELECT feature, target, kind, n_valid, valid_slice_count, sign_slice_count, {', '.join(f'round({c} + 1e-9, 6) AS {c}' for c in _MAP_VALUES)} FROM am")
def association_map(v) -> DataFrame:
    return _associations(_map_rows(v)).select("feature", "target", "kind", "n_valid", "valid_slice_count", "sign_slice_count", *[r6(c).alias(c) for c in _MAP_VALUES])


#: names under which the three features stand in the taxonomy
_TAXON = {"cand_cf": "cross__cand_cf", "third_cf": "cross__third_cf", "day_no": "time__day_no"}


@query("family_association_map", "A39 P04", f"""
WITH RECURSIVE {_MAPSQL[5:] if _MAPSQL.lower().startswith("with ") else _MAPSQL},
fk AS (SELECT {', '.join(f"(rank() OVER (ORDER BY {n}) + (count(*) OVER (PARTITION BY {n}) - 1) / 2.0) AS {n}" for n in _FEATURES)} FROM ma2),
fe AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS rho FROM fk" for a in _FEATURES for b in _FEATURES if a != b)}),
fr(a, b) AS (SELECT unnest({_FEATURES}), unnest({_FEATURES}) UNION SELECT fr.a, fe.b FROM fr JOIN fe ON fe.a = fr.b AND abs(fe.rho) >= {A.REDUNDANCY_THRESHOLD}),
fc AS (SELECT a AS feature, min(b) AS comp, count(*) > 1 AS red FROM fr GROUP BY 1),
fi AS (SELECT feature, CASE WHEN feature = 'day_no' THEN 'calendar' ELSE 'cross_source_wind' END AS family, red, comp FROM fc),
sz AS (SELECT family, count(*) AS feature_count, count(*) FILTER (red) AS redundant_feature_count, count(DISTINCT comp) AS redundancy_cluster_count FROM fi GROUP BY 1),
k AS (SELECT am.*, fi.family, row_number() OVER (PARTITION BY fi.family, am.target ORDER BY round(strength, 12) DESC, am.feature) AS rn FROM am JOIN fi ON fi.feature = am.feature)
SELECT k.family AS physical_family, target, any_value(feature_count) AS feature_count, any_value(redundant_feature_count) AS redundant_feature_count, any_value(redundancy_cluster_count) AS redundancy_cluster_count, count(strength) AS finite_feature_count,
  round(quantile_cont(strength, 0.5) + 1e-9, 6) AS median_strength, round(quantile_cont(strength, 0.9) + 1e-9, 6) AS q90_strength, round(max(strength) + 1e-9, 6) AS maximum_strength, round(avg(sign_stability) + 1e-9, 6) AS mean_sign_stability,
  round(avg((sign_stability >= 0.75)::INT) + 1e-9, 6) AS stable_feature_fraction, max(feature) FILTER (rn = 1) AS top_feature, round(max(signed) FILTER (rn = 1) + 1e-9, 6) AS top_signed FROM k JOIN sz ON sz.family = k.family GROUP BY 1, 2""")
def family_association_map(v) -> DataFrame:
    """Families from the taxonomy of the features' names, clusters from their rank correlations."""
    names = v.spark.createDataFrame(list(_TAXON.items()), "feature string, name string")
    families = A.taxonomy(names, "name").select("feature", "physical_family")
    rows = stored(_map_rows(v).select(*_FEATURES, *_CONT, *_BIN, "actual", *_LABELS, F.monotonically_increasing_id().alias("_row")), "map-rows")
    edges = A.redundancy_edges(A.spearman_matrix(rows, _FEATURES, ["_row"]))
    out = A.family_map(_associations(rows), families, A.redundancy_clusters(names.select("feature"), edges))
    values = ["median_strength", "q90_strength", "maximum_strength", "mean_sign_stability", "stable_feature_fraction", "top_signed"]
    return out.select("physical_family", "target", "feature_count", "redundant_feature_count", "redundancy_cluster_count", "finite_feature_count", *[r6(c).alias(c) for c in values], "top_feature")


_RF = {"ws10": "sqrt(u * u + v * v)", "ws10_cube": "pow(sqrt(u * u + v * v), 3)", "ws10_plus": "sqrt(u * u + v * v) * 2 + 1", "gust": "gust", "minus_gust": "-gust", "t2": "t2", "t2_noise": "t2 + gust / 50", "sp": "sp", "u50": "u50"}
_RM = f"""rf AS (SELECT {', '.join(f'round({e}, 9) AS {n}' for n, e in _RF.items())} FROM wx_obs),
rk AS (SELECT {', '.join(f"(rank() OVER (ORDER BY {n}) + (count(*) OVER (PARTITION BY {n}) - 1) / 2.0) AS {n}" for n in _RF)} FROM rf),
rm AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS rho FROM rk" for i, a in enumerate(_RF) for b in list(_RF)[i + 1:])})"""


def _redundancy(v) -> DataFrame:
    s = F.hypot("u", "v")
    cols = {"ws10": s, "ws10_cube": s * s * s, "ws10_plus": s * 2 + 1, "gust": F.col("gust"), "minus_gust": -F.col("gust"), "t2": F.col("t2"), "t2_noise": F.col("t2") + F.col("gust") / 50, "sp": F.col("sp"), "u50": F.col("u50")}
    return v.wx_obs.select("forecast_ts", "grid_id", *[F.round(c, 9).alias(n) for n, c in cols.items()])


@query("spearman_matrix", "A40", f"WITH {_RM} SELECT a, b, round(rho + 1e-9, 6) AS rho FROM rm")
def spearman_matrix(v) -> DataFrame:
    return A.spearman_matrix(_redundancy(v), list(_RF), ["forecast_ts", "grid_id"]).withColumn("rho", r6("rho"))


@query("redundancy_clusters", "A41 A40", f"""
WITH RECURSIVE {_RM}, nd AS (SELECT unnest({list(_RF)}) AS n), ed AS (SELECT a, b FROM rm WHERE abs(rho) >= 0.92 UNION SELECT b, a FROM rm WHERE abs(rho) >= 0.92),
re AS (SELECT n, n AS r FROM nd UNION SELECT re.n, ed.b FROM re JOIN ed ON ed.a = re.r),
cp AS (SELECT n AS feature, min(r) AS component FROM re GROUP BY 1)
SELECT feature, component, count(*) OVER (PARTITION BY component) AS cluster_size, count(*) OVER (PARTITION BY component) > 1 AS is_redundant FROM cp""")
def redundancy_clusters(v) -> DataFrame:
    matrix = A.spearman_matrix(_redundancy(v), list(_RF), ["forecast_ts", "grid_id"])
    nodes = v.spark.createDataFrame([(n,) for n in _RF], "feature string")
    return A.redundancy_clusters(nodes, A.redundancy_edges(matrix)).select("feature", "component", "cluster_size", "is_redundant")


def _ranks_sql(source: str, keys: str) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    ties = lambda n: f"PARTITION BY {keys + ', ' if keys else ''}{n}"
    return f"SELECT {keys + ', ' if keys else ''}{', '.join(f'(rank() OVER ({part}ORDER BY {n}) + (count(*) OVER ({ties(n)}) - 1) / 2.0) AS {n}' for n in _RF)} FROM {source}"


_PAIRS = [(a, b) for i, a in enumerate(_RF) for b in list(_RF)[i + 1:]]


@query("edge_sign_stability", "A41", f"""
WITH s AS (SELECT day(forecast_ts) <= 15 AS src, {', '.join(f'round({e}, 9) AS {n}' for n, e in _RF.items())} FROM wx_obs),
rk AS ({_ranks_sql('s', 'src')}), pk AS ({_ranks_sql('s', '')}),
sm AS ({' UNION ALL '.join(f"SELECT src, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS rho FROM rk GROUP BY src" for a, b in _PAIRS)}),
pm AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS rho FROM pk" for a, b in _PAIRS)})
SELECT pm.a, pm.b, round(pm.rho + 1e-9, 6) + 0 AS rho, round(min(abs(sm.rho)) + 1e-9, 6) AS minimum_source_abs, round(avg((sign(sm.rho) = sign(pm.rho))::INT) + 1e-9, 6) AS source_sign_stability
FROM pm JOIN sm ON sm.a = pm.a AND sm.b = pm.b GROUP BY 1, 2, pm.rho""")
def edge_sign_stability(v) -> DataFrame:
    rows = _redundancy(v).withColumn("src", F.day("forecast_ts") <= 15)
    keys = ["forecast_ts", "grid_id"]
    out = A.edge_stability(A.spearman_matrix(rows, list(_RF), keys), A.spearman_matrix(rows, list(_RF), keys, ["src"]))
    return out.select("a", "b", *[r6(c).alias(c) for c in ("rho", "minimum_source_abs", "source_sign_stability")])


@query("even_row_sample", "T08", """
WITH s AS (SELECT forecast_ts, grid_id, gust, day(forecast_ts) <= 15 AS src, row_number() OVER (PARTITION BY day(forecast_ts) <= 15 ORDER BY forecast_ts, grid_id) - 1 AS pos, count(*) OVER (PARTITION BY day(forecast_ts) <= 15) AS n FROM wx_obs),
ix AS (SELECT DISTINCT src, CAST(CASE WHEN i = 1499 THEN n - 1 ELSE floor(i * ((n - 1) / 1499.0)) END AS BIGINT) AS pos FROM (SELECT DISTINCT src, n FROM s), range(1500) r(i))
SELECT s.src, forecast_ts, grid_id, round(gust + 1e-9, 6) AS gust FROM s LEFT JOIN ix ON ix.src = s.src AND ix.pos = s.pos WHERE ix.pos IS NOT NULL OR s.n <= 1500""")
def even_row_sample(v) -> DataFrame:
    rows = v.wx_obs.select("forecast_ts", "grid_id", "gust", (F.day("forecast_ts") <= 15).alias("src"))
    return A.even_sample(rows, ["src"], ["forecast_ts", "grid_id"], 1500).select("src", "forecast_ts", "grid_id", r6("gust").alias("gust"))


_ALT = "CASE WHEN site % 3 = 0 THEN base WHEN site % 3 = 1 THEN cand ELSE base + 2 END"


@query("increment_similarity", "A46", f"""
WITH x AS (SELECT cand - base AS a, third - base AS b, {_ALT} - base AS c FROM fcst),
p AS (SELECT 'cand' AS "left", 'third' AS "right", a AS x, b AS y FROM x UNION ALL SELECT 'cand', 'alt', a, c FROM x UNION ALL SELECT 'third', 'alt', b, c FROM x)
SELECT "left", "right", round(corr(x, y) + 1e-9, 6) AS increment_corr, bool_and(x = y) AS increment_exact, count(*) FILTER (x <> 0 AND y <> 0) AS overlap,
 round(count(*) FILTER (x <> 0 AND y <> 0) / CAST(count(*) FILTER (x <> 0 OR y <> 0) AS DOUBLE) + 1e-9, 6) AS jaccard,
 round(count(*) FILTER (x <> 0 AND y <> 0 AND sign(x) = sign(y)) / CAST(count(*) FILTER (x <> 0 AND y <> 0) AS DOUBLE) + 1e-9, 6) AS sign_agreement FROM p GROUP BY 1, 2""")
def increment_similarity(v) -> DataFrame:
    rows = _with_alt(v)
    out = L.increment_similarity(rows, "base", ["cand", "third", "alt"])
    return out.select("left", "right", r6("increment_corr").alias("increment_corr"), "increment_exact", "overlap", r6("jaccard").alias("jaccard"), r6("sign_agreement").alias("sign_agreement"))


def _with_alt(v) -> DataFrame:
    s = F.col("site") % 3
    return v.fcst.withColumn("alt", F.when(s == 0, F.col("base")).when(s == 1, F.col("cand")).otherwise(F.col("base") + 2))


@query("forecast_pair_metrics", "A34 A46", f"""
WITH x AS (SELECT base AS x, {_ALT} AS y FROM fcst), r AS (SELECT x, y, (rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0) AS rx, (rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0) AS ry FROM x),
f AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM x)
SELECT round(any_value(a) + 1e-9, 6) AS affine_a, round(any_value(b) + 1e-9, 6) AS affine_b, round(max(abs(y - (a * x + b))) + 1e-9, 6) AS affine_max_abs_residual, round(corr(x, y) + 1e-9, 6) AS pearson, round(corr(rx, ry) + 1e-9, 6) AS spearman,
 round(sqrt(avg(pow(y - x, 2))) + 1e-9, 6) AS rmse, round(avg(abs(y - x)) + 1e-9, 6) AS mae, round(max(abs(y - x)) + 1e-9, 6) AS max_abs_delta, count(*) FILTER (y <> x) AS changed_rows, round(avg((y <> x)::INT) + 1e-9, 6) AS changed_fraction FROM r, f""")
def forecast_pair_metrics(v) -> DataFrame:
    out = L.pair_metrics(_with_alt(v), "base", "alt")
    values = ["affine_a", "affine_b", "affine_max_abs_residual", "pearson", "spearman", "rmse", "mae", "max_abs_delta", "changed_fraction"]
    return out.select("changed_rows", *[r6(c).alias(c) for c in values])


@query("changed_slices", "A48", f"""
WITH x AS (SELECT grp, ts, (base <> {_ALT})::INT AS c FROM fcst), h AS (SELECT ts, max(c) AS c FROM x GROUP BY 1)
SELECT 'group' AS kind, grp AS slice, CAST(sum(c) AS BIGINT) AS changed FROM x GROUP BY 2 UNION ALL SELECT 'month', strftime(ts, '%Y-%m'), CAST(sum(c) AS BIGINT) FROM h GROUP BY 2
UNION ALL SELECT 'lead', ['L01_06', 'L07_12', 'L13_18', 'L19_24'][CAST(floor(((hour(ts) + 23) % 24) / 6) AS INTEGER) + 1], CAST(sum(c) AS BIGINT) FROM h GROUP BY 2""")
def changed_slices(v) -> DataFrame:
    return L.changed_slices(_with_alt(v), "base", "alt").select("kind", "slice", "changed")


@query("scalar_identity", "F38", """
SELECT grp, bool_and(abs(round(CASE WHEN grp = 'g2' AND site = 1 THEN base * 0.951 ELSE base * 0.95 END, 6) - 0.95 * base) <= 0.5e-6 * 1.95 + 8 * 2.220446049250313e-16 * greatest(1, abs(base * 0.95))) AS identity, count(*) AS rows FROM fcst GROUP BY 1""")
def scalar_identity(v) -> DataFrame:
    child = F.round(F.when((F.col("grp") == "g2") & (F.col("site") == 1), F.col("base") * 0.951).otherwise(F.col("base") * 0.95), 6)
    return L.scalar_identity(v.fcst.withColumn("child", child), "base", "child", 0.95, ["grp"])


_DIMS = [f"d{i:02d}" for i in range(64)]


def _dims(v) -> DataFrame:
    return v.table("embeddings").select("vec_id", *[F.element_at("embedding", i + 1).cast("double").alias(d) for i, d in enumerate(_DIMS)])


@query("increment_products", "A47", """
WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS a, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT CAST(p.a AS INTEGER) AS a, CAST(q.a AS INTEGER) AS b, round(sum(p.x * q.x) + 1e-8, 5) AS dot FROM e p JOIN e q ON q.vec_id = p.vec_id AND q.a >= p.a GROUP BY 1, 2""")
def increment_products(v) -> DataFrame:
    return L.increment_gram(_dims(v), None, _DIMS).withColumn("dot", r6("dot", 5))


@query("effective_rank", "A47")
def effective_rank(v) -> DataFrame:
    return L.effective_rank(L.increment_gram(_dims(v), None, _DIMS), 64)


_FILES = """fv AS (SELECT unnest(['base.csv', 'cand.csv', 'third.csv', 'base_copy.csv', 'cand_scaled.csv']) AS path, unnest(['a', 'b', 'c', 'a', 'b']) AS axis, grp, site, ts, unnest([base, cand, third, base, cand * 0.95]) AS kwh FROM fcst),
fh AS (SELECT path, axis, count(*) AS rows, count(*) || '-' || sum(CAST('0x' || substr(h, 1, 8) AS BIGINT)) || '-' || sum(CAST('0x' || substr(h, 9, 8) AS BIGINT)) AS content_hash FROM
  (SELECT path, axis, md5(grp || '|' || site || '|' || epoch_us(ts) || '|' || CAST(round(kwh * 10000) AS BIGINT)) AS h FROM fv) GROUP BY 1, 2)"""


def _files(v) -> DataFrame:
    variants = [("base.csv", "a", F.col("base")), ("cand.csv", "b", F.col("cand")), ("third.csv", "c", F.col("third")), ("base_copy.csv", "a", F.col("base")), ("cand_scaled.csv", "b", F.col("cand") * 0.95)]
    rows = v.fcst.select("grp", "site", "ts", F.inline(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(a).alias("axis"), c.alias("kwh")) for p, a, c in variants])))
    micros = F.unix_micros(F.col("ts").cast("timestamp_ltz"))
    return L.content_digest(rows, ["path", "axis"], ["grp", "site", micros, F.round(F.col("kwh") * 10000).cast("bigint")])


@query("content_clusters", "A49", f"""
WITH {_FILES} SELECT content_hash, count(*) AS file_count, min(path) AS representative, arg_min(axis, path) AS axis, max(length(path) / 10.0) AS best_score FROM fh GROUP BY 1""")
def content_clusters(v) -> DataFrame:
    return L.content_clusters(_files(v).withColumn("score", F.length("path") / 10.0), "content_hash", "path", "score", "axis")


@query("axis_ledger", "A49", f"""
WITH {_FILES} SELECT axis, count(*) AS file_count, count(DISTINCT content_hash) AS unique_content, count(*) FILTER (contains(path, '_')) AS linked_count, max(length(path) / 10.0) AS best_score FROM fh GROUP BY 1""")
def axis_ledger(v) -> DataFrame:
    return L.axis_ledger(_files(v).withColumn("score", F.length("path") / 10.0), "axis", "content_hash", "score", F.col("path").contains("_"))
