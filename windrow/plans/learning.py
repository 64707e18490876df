"""Model-backed queries.  Trained weights have no SQL twin; closed-form parts are checked by the tests."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.functions import timekeys as T
from windrow.functions import wind as P
from windrow.functions.exprs import r6, rounded
from windrow.operators import analogs as N
from windrow.operators import calibrate as K
from windrow.operators import decisions as D
from windrow.operators import design
from windrow.operators import drift as R
from windrow.operators import least_squares as Q
from windrow.operators import meta as A
from windrow.operators import models as M
from windrow.operators import runs
from windrow.operators import telemetry as TE
from windrow.operators.lookups import attach
from windrow.plans.measured import _hour_states, _hourly
from windrow.plans.registry import query
from windrow.session import checkpoint

SPLIT = "1999-07-01"
# fixed value: penalty of the seasonal ridge on standardised columns
RIDGE_ALPHA = 250.0
FEATURES = ["base_cf", "cand_cf", "third_cf", "component_std_cf", "component_range_cf", "day_of_year_sin", "day_of_year_cos", "z_wind"]
GROUPS = ["g1", "g2", "g3"]
KEYS = ["grp", "site", "ts"]
#: runs a block of the neighbour search holds; every row is sent once to each block of the other side
NEIGHBOUR_BLOCK = 16_384


def _design(v) -> DataFrame:
    features = A.meta_features("base", ["cand", "third"], [("cand", "third")], "ts", "capacity")
    rows = v.fcst.withColumns(features)
    return rows.withColumns({"actual_cf": F.col("actual") / F.col("capacity"), "z_wind": F.col("third") / 15.0, "lead": (F.dayofmonth("ts") % 24 + 12).cast("double"), "run": T.day_floor("ts")})


def _rows(v) -> DataFrame:
    return checkpoint(_design(v))  # every fit and scaler reads the design


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    at = F.lit(SPLIT).cast("timestamp_ntz")
    return df.where((F.col("ts") < at) & (F.col("actual_cf") >= 0.10)), df.where(F.col("ts") >= at)


def _mean_cf(train: DataFrame) -> float:
    """Mean capacity factor of the training rows: one number."""
    return train.agg(F.avg("actual_cf")).first()[0]


def _out(df: DataFrame, *values: str, keys=("grp", "site", "ts")) -> DataFrame:
    return df.select(*keys, *[r6(c).alias(c) for c in values])


@query("group_regressors", "M01 P01 P17 P18")
def group_regressors(v) -> DataFrame:
    train, apply = _split(_rows(v).withColumn("w", 0.5 + 2.0 * F.least("actual_cf", F.lit(1.5))))
    out = M.per_group(train, apply, GROUPS, lambda d: M.boosted(d, FEATURES, "actual_cf", "w"), FEATURES, "cf")
    return _out(out.withColumn("kwh", F.col("cf") * F.col("capacity")), "kwh")


@query("shared_regressor", "M02 U02")
def shared_regressor(v) -> DataFrame:
    train, apply = _split(M.shared_design(_rows(v), GROUPS))
    model = M.boosted(train, [*FEATURES, "group_id"], "actual_cf")
    return _out(M.predict(model, apply, [*FEATURES, "group_id"], "cf", (0.0, 1.02)), "cf")


@query("feature_gains", "P06 M01")
def feature_gains(v) -> DataFrame:
    train, _ = _split(_rows(v))
    model = M.boosted(train, FEATURES, "actual_cf")
    return M.gain_table(model, FEATURES, v.spark).orderBy(F.col("gain").desc(), "position").limit(5)


@query("quantile_forecast", "M03 F24")
def quantile_forecast(v) -> DataFrame:
    train, apply = _split(_rows(v))
    out = M.binned_quantile_surface(train, apply, "base_cf", "actual_cf", [0.1, 0.25, 0.5, 0.6, 0.7, 0.9])
    return out.select("grp", "site", "ts", *[r6(F.element_at("quantiles", i + 1)).alias(f"q{i}") for i in range(6)])


@query("leaf_quantile_forecast", "M03 J11")
def leaf_quantile_forecast(v) -> DataFrame:
    train, apply = _split(_rows(v))
    model = M.forest(train, FEATURES, "actual_cf", leaf="leaf")
    fit, ask = M.leaf_rows(model, train, FEATURES), M.leaf_rows(model, apply, FEATURES)
    out = M.leaf_quantile_surface(fit, ask, "leaves", ["grp", "site", "ts"], "actual_cf", [0.1, 0.5, 0.9])
    return out.select("grp", "site", "ts", *[r6(F.element_at("quantiles", i + 1)).alias(f"q{i}") for i in range(3)])


@query("train_only_scaling", "M04 A25", """
WITH s AS (SELECT forecast_ts, grid_id, day(forecast_ts) <= 15 AS tr, CASE WHEN grid_id % 5 = 1 THEN NULL ELSE u END AS u, gust FROM wx_obs),
m AS (SELECT median(u) FILTER (tr) AS mu, median(gust) FILTER (tr) AS mg FROM s), f AS (SELECT forecast_ts, grid_id, tr, coalesce(u, mu) AS u, coalesce(gust, mg) AS gust FROM s, m),
k AS (SELECT avg(u) FILTER (tr) AS au, stddev_pop(u) FILTER (tr) AS su, avg(gust) FILTER (tr) AS ag, stddev_pop(gust) FILTER (tr) AS sg FROM f)
SELECT forecast_ts, grid_id, round((u - au) / su + 1e-9, 6) + 0 AS u, round((gust - ag) / sg + 1e-9, 6) + 0 AS gust FROM f, k WHERE NOT tr""")
def train_only_scaling(v) -> DataFrame:
    rows = v.wx_obs.select("forecast_ts", "grid_id", F.when(F.col("grid_id") % 5 != 1, F.col("u")).alias("u"), "gust")
    scaler = M.TrainOnlyScaler(rows.where(F.day("forecast_ts") <= 15), ["u", "gust"])
    return rounded(scaler.transform(rows.where(F.day("forecast_ts") > 15)), ["forecast_ts", "grid_id"], ["u", "gust"])


@query("density_ratio_weights", "M05")
def density_ratio_weights(v) -> DataFrame:
    rows = _rows(v)
    at = F.lit(SPLIT).cast("timestamp_ntz")
    cols = ["grp", "site", "ts", "run", *FEATURES[:4], "actual_cf"]
    weighted, _ = M.density_ratio(rows.where(F.col("ts") < at).select(*cols), rows.where(F.col("ts") >= at).select(*cols), FEATURES[:4], "run", F.col("actual_cf") >= 0.10)
    return _out(weighted, "domain_probability", "density_weight")


@query("seasonal_wind_ridge", "M06 F07")
def seasonal_wind_ridge(v) -> DataFrame:
    """One standardised ridge per group, all in one pass."""
    rows = v.fcst.withColumn("actual_cf", F.col("actual") / F.col("capacity"))
    design = P.seasonal_wind_design("ts", F.col("third") / 2)
    names = list(design)
    train, apply = _split(rows.withColumns(design))
    models = Q.ridges(train, ["grp"], names, "actual_cf", RIDGE_ALPHA, standardise=True, minimum=len(names) + 1)
    return _out(Q.apply_ridges(apply, models, ["grp"], names, "cf", (0.0, M.UPPER_CF)), "cf")


@query("run_residual_models", "M07 W06")
def run_residual_models(v) -> DataFrame:
    rows = v.wx.fillna(0.0, subset=["u", "gust", "t2"])
    table = runs.run_sequence_table(rows.withColumn("base", F.col("gust") / 30), "base", "u", [], ["grid_id", "run_key"])
    names = ["base__current", "base__current_minus_mean", "u__current", "u__run_mean", "u__within_run_rank", "horizon__sin_1", "horizon__cos_1", "interaction__baseline_x_wind"]
    data = table.withColumn("actual_cf", F.col("base__current") * 0.75 + F.col("u__current") / 60)
    day, kept = F.day("run_key"), ["grid_id", "forecast_ts", *names, "actual_cf"]
    train, apply = (checkpoint(data.where(part).select(*kept)) for part in (day <= 20, day > 20))  # read by every fit and scaler
    scaler = M.TrainOnlyScaler(train.where(F.col("actual_cf") >= 0.10), names)
    out = None
    for kind in ("ridge", "huber", "boosted"):
        part = M.residual_correction(train, apply, names, "base__current", "actual_cf", kind, alpha=10.0, shrinkage=0.5, scaler=scaler).select(
            "grid_id", "forecast_ts", F.lit(kind).alias("kind"), r6("correction_cf").alias("correction_cf"), r6("corrected_cf").alias("corrected_cf"))
        out = part if out is None else out.unionByName(part)
    return out


@query("profile_residual_ridge", "M08 F15")
def profile_residual_ridge(v) -> DataFrame:
    rows = v.wx_obs.withColumn("base", F.col("gust") / 30)
    features = P.residual_profile(("u", "v"), ("u50", "v50"), ("gust", "v"), "t2", "sp", "d2", F.col("base"))
    names = list(features)
    rows = rows.withColumns(features).withColumn("actual_cf", F.col("gust") / 40 + F.col("u") / 60)
    out = M.residual_correction(rows.where(F.day("forecast_ts") <= 20), rows.where(F.day("forecast_ts") > 20), names, "base", "actual_cf")
    return _out(out, "correction_cf", "corrected_cf", keys=("grid_id", "forecast_ts"))


@query("mean_weather_forest", "M09 F09")
def mean_weather_forest(v) -> DataFrame:
    data = design.mean_weather(v.wx_obs, ["u", "v", "gust", "t2", "sp"])
    names = [c for c in data.columns if c != "forecast_ts"]
    data = data.withColumn("y", F.least(F.col("gust_mean") / 25, F.lit(1.0)))
    model = M.forest(data.where(F.col("day") <= 20), names, "y")
    return _out(M.predict(model, data.where(F.col("day") > 20), names, "cf", (0.0, 1.02)), "cf", keys=("forecast_ts",))


@query("compact_physics_forest", "M10 F36")
def compact_physics_forest(v) -> DataFrame:
    train, apply = _split(_rows(v))
    compact = FEATURES[:6]
    model = M.forest(train, compact, "actual_cf", featureSubsetStrategy="all")
    return _out(M.predict(model, apply, compact, "cf", (0.0, 1.02)), "cf")


@query("lead_bin_experts", "M11 P16")
def lead_bin_experts(v) -> DataFrame:
    train, apply = _split(_rows(v))
    bins = [("lead_12_17", 12, 18), ("lead_18_23", 18, 24), ("lead_24_29", 24, 30), ("lead_30_35", 30, 36)]
    out = M.lead_experts(train, apply, FEATURES, "actual_cf", bins, "lead", lambda d: M.boosted(d, FEATURES, "actual_cf"))
    return _out(out.withColumn("candidate", F.least(F.greatest(F.col("base") + 0.2 * (F.col("expert_cf") - F.col("global_cf")) * F.col("capacity"), F.lit(0.0)), 1.02 * F.col("capacity"))), "global_cf", "expert_cf", "candidate")


@query("telemetry_auxiliary_predictions", "M12 J03 P21")
def telemetry_auxiliary_predictions(v) -> DataFrame:
    farm = F.concat(F.lit("f"), F.floor(F.col("grid_id") / 3).cast("int").cast("string"))
    features = v.wx_obs.groupBy("forecast_ts", farm.alias("grp")).agg(*[F.avg(c).alias(c) for c in ("u", "gust", "t2", "sp")])
    targets = _hourly(v).select(F.col("hour_end").alias("forecast_ts"), "grp", "obs_ws_mean", "obs_turbine_availability")
    day = F.day("forecast_ts")
    out = M.auxiliary_predictions(features, targets, ["forecast_ts", "grp"], ["u", "gust", "t2", "sp"], ["obs_ws_mean", "obs_turbine_availability"],
                                  [(day <= 15, day > 15)], "grp", {"obs_ws_mean": (0.0, None), "obs_turbine_availability": (0.0, 1.0)})
    return _out(out, "pred_obs_ws_mean", "pred_obs_turbine_availability", keys=("forecast_ts", "grp"))


@query("cross_farm_pseudo_labels", "M13 U03")
def cross_farm_pseudo_labels(v) -> DataFrame:
    wide = v.fcst.groupBy("ts").agg(*[F.max(F.when(F.col("grp") == g, F.col("actual") / F.col("capacity"))).alias(g) for g in GROUPS])
    at = F.lit("1997-01-01").cast("timestamp_ntz")
    out = M.pseudo_labels(wide, F.col("ts") >= at, F.col("ts") < at, ["g1", "g2"], "g3")
    return out.select("ts", "origin", r6("g3").alias("g3"))


@query("fleet_wind_mapper", "M14")
def fleet_wind_mapper(v) -> DataFrame:
    wind = TE.fleet_mean(v.scada10, ["hour_end"], "ws", 4).where(F.col("fleet_mean").isNotNull())
    weather = v.wx_obs.groupBy("forecast_ts").agg(F.avg("gust").alias("a"), F.avg("u").alias("b"))
    rows = weather.join(wind.withColumnRenamed("hour_end", "forecast_ts"), "forecast_ts")
    train, apply = rows.where(F.day("forecast_ts") <= 20), weather.where(F.day("forecast_ts") > 20)
    hedged = R.shift_hedge(train, apply, ["a", "b"])
    scaler = M.TrainOnlyScaler(train, ["a", "b"])
    model = M.huber(scaler.transform(train), ["a", "b"], "fleet_mean")
    return _out(M.predict(model, scaler.transform(hedged), ["a", "b"], "fleet_wind"), "fleet_wind", keys=("forecast_ts",))


_LIB = """lb AS (SELECT vec_id AS run, embedding::DOUBLE[] AS e FROM embeddings),
pr AS (SELECT q.run, l.run AS neighbour, list_distance(q.e, l.e) AS distance FROM lb q JOIN lb l ON l.run < q.run),
rk AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round(distance, 12), neighbour) AS rank FROM pr),
nn AS (SELECT run, neighbour, distance, rank FROM rk WHERE rank <= 5),
wt AS (SELECT *, (1 / greatest(distance, 1e-6)) / sum(1 / greatest(distance, 1e-6)) OVER (PARTITION BY run) AS weight FROM nn)"""


def _library(v) -> DataFrame:
    return v.table("embeddings").select(F.col("vec_id").alias("run"), F.col("embedding").cast("array<double>").alias("embedding"))


@query("past_run_neighbours", "J10", f"WITH {_LIB} SELECT run, neighbour, CAST(rank AS INTEGER) AS rank, round(distance + 1e-9, 6) AS distance, round(weight + 1e-9, 6) AS weight FROM wt")
def past_run_neighbours(v) -> DataFrame:
    lib = _library(v)
    out = N.neighbour_weights(N.past_neighbours(lib, lib, 5, block=NEIGHBOUR_BLOCK))
    return out.select("run", "neighbour", "rank", r6("distance").alias("distance"), r6("weight").alias("weight"))


@query("analog_trajectories", "M15 J10", f"""
WITH {_LIB}, tj AS (SELECT run, unnest(range(0, 24)) AS hour, unnest(e[1:24]) / 4 + 0.5 AS cf FROM lb)
SELECT wt.run, CAST(hour AS INTEGER) AS hour, round(least(greatest(sum(weight * least(greatest(cf, 0), 1.02)), 0), 1.02) + 1e-9, 6) AS analog_cf, count(*) AS neighbours FROM wt JOIN tj ON tj.run = wt.neighbour GROUP BY 1, 2""")
def analog_trajectories(v) -> DataFrame:
    lib = _library(v)
    near = N.neighbour_weights(N.past_neighbours(lib, lib, 5, block=NEIGHBOUR_BLOCK))
    curves = lib.select("run", F.posexplode(F.slice("embedding", 1, 24)).alias("hour", "x")).select("run", "hour", (F.col("x") / 4 + 0.5).alias("cf"))
    return N.analog_trajectories(near, curves).withColumn("analog_cf", r6("analog_cf"))


@query("analog_run_forecast", "M15 W05 J10")
def analog_run_forecast(v) -> DataFrame:
    rows = v.wx.fillna(0.0, subset=["u", "gust"]).withColumn("run", F.datediff(F.col("run_key").cast("date"), F.lit("2024-01-01").cast("date")))
    emb = N.summary_embedding(rows, ["u", "gust"], ["run", "grid_id", "run_key"])
    library, ask = emb.where(F.day("run_key") <= 20), emb.where(F.day("run_key") > 20)
    library, ask = N.scale_embedding(library, ask, size=2 * len(N.SUMMARY) + 4)
    library, ask = (checkpoint(df) for df in N.reduce_embedding(library, ask, k=6))
    near = N.neighbour_weights(N.past_neighbours(library, ask, 5, member="grid_id", block=16))
    curves = rows.select("run", "grid_id", T.run_position("forecast_ts").alias("hour"), (F.col("gust") / 30).alias("cf"))
    return N.analog_trajectories(near, curves, member="grid_id").withColumn("analog_cf", r6("analog_cf"))


@query("ordinal_class_forecast", "M16 E16 F34")
def ordinal_class_forecast(v) -> DataFrame:
    train, apply = _split(_rows(v))
    pmf = M.class_pmf(train, apply, FEATURES, D.target_class("actual_cf"), D.CLASS_COUNT)
    out = pmf.withColumn("c", D.class_action("pmf", "base_cf", F.lit(_mean_cf(train))))
    return out.select("grp", "site", "ts", r6("c.action").alias("action"), r6("c.utility").alias("utility"))


@query("residual_class_forecast", "M16 E16 E22 F35")
def residual_class_forecast(v) -> DataFrame:
    train, apply = _split(_rows(v))
    label = D.residual_class(F.col("actual_cf") - F.col("base_cf"))
    pmf = M.class_pmf(train, apply, FEATURES, label, D.RESIDUAL_CLASS_COUNT)
    delta, choice = D.residual_action("pmf", "base_cf", F.lit(_mean_cf(train)))
    return pmf.withColumn("c", choice).select("grp", "site", "ts", r6("c.action").alias("action"), r6("c.utility").alias("utility"))


@query("interval_probability_policy", "M17 J20 E20 F24")
def interval_probability_policy(v) -> DataFrame:
    train, apply = _split(_rows(v))
    out = M.interval_policy(train.select(*KEYS, "actual_cf", *FEATURES), apply.select(*KEYS, *FEATURES), FEATURES, "actual_cf", "base_cf", D.ACTION_GRID)
    return _out(out, "action", "utility")


@query("action_uplift_policy", "M18 F19 J20")
def action_uplift_policy(v) -> DataFrame:
    train, apply = _split(_rows(v))
    out = M.uplift_policy(train, apply, FEATURES, "actual_cf", "base_cf", _mean_cf(train))
    return _out(out, "factor", "predicted_gain", "policy_cf")


@query("leaf_empirical_decision", "M19 E19 J11")
def leaf_empirical_decision(v) -> DataFrame:
    rows = _rows(v).withColumn("residual", F.col("actual_cf") - F.col("base_cf"))
    train, apply = _split(rows)
    model = M.forest(train, FEATURES, "residual", leaf="leaf")
    fit, ask = M.leaf_rows(model, train, FEATURES), M.leaf_rows(model, apply, FEATURES)
    out = D.forest_action(fit, ask, "leaves", KEYS, KEYS, "residual", "base_cf", _mean_cf(train))
    return _out(out, "delta", "utility")


@query("target_transform_regressors", "M20 F17")
def target_transform_regressors(v) -> DataFrame:
    train, apply = _split(_rows(v))
    return _out(M.transformed_regressors(train, apply, FEATURES, "actual_cf", ["logit_eps02", "cube_root"]), "logit_eps02", "cube_root")


@query("simplex_huber_stack", "M21 F22")
def simplex_huber_stack(v) -> DataFrame:
    train, apply = _split(_rows(v))
    fit = K.fit_stack(train, ["base_cf", "cand_cf", "third_cf"], "actual_cf", 0.01)
    value = sum((F.col(m) * w for m, w in fit["weights"].items()), F.lit(fit["intercept"]))
    return _out(apply.withColumn("stack_cf", F.least(F.greatest(value, F.lit(0.0)), F.lit(1.02))), "stack_cf")


@query("availability_student", "M22 J13")
def availability_student(v) -> DataFrame:
    weather = v.wx_obs.groupBy(F.col("forecast_ts").alias("hour_end")).agg(*[F.avg(c).alias(c) for c in ("u", "gust", "t2")])
    rows = _hour_states(v).where(F.col("availability_factor").isNotNull()).join(weather, "hour_end")
    train, valid = rows.where(F.day("hour_end") <= 20), rows.where(F.day("hour_end") > 20)
    model = M.boosted(train, ["u", "gust", "t2"], "availability_factor")
    scored = M.predict(model, valid, ["u", "gust", "t2"], "student", (0.0, 1.0))
    scored = TE.median_lookup(train.withColumn("_one", F.lit(1)), scored.withColumn("_one", F.lit(1)), ["_one"], "availability_factor", "constant")
    scored = TE.median_lookup(train.withColumn("month", F.month("hour_end")), scored.withColumn("month", F.month("hour_end")), ["month"], "availability_factor", "monthly")
    out = M.student_report(scored, ["grp"], "availability_factor", "student", ["constant", "monthly"], "normal_hour")
    return out.select("grp", "rows", *[r6(c).alias(c) for c in ("mae_student", "mae_constant", "mae_monthly", "r2", "spearman", "auc", "improvement")], "gate")


@query("channel_redundancy_crossfit", "M23 A33")
def channel_redundancy_crossfit(v) -> DataFrame:
    rows = v.wx_obs.withColumn("fold", F.day("forecast_ts") % 4)
    names = ["u", "v", "u50", "v50", "t2"]
    out = None
    for label, fit in (("ridge", lambda d: M.ridge(d, names, "gust", 1.0)), ("forest", lambda d: M.forest(d, names, "gust"))):
        part = M.crossfit(rows, "fold", [0, 1, 2, 3], fit, names).withColumn("model", F.lit(label))
        out = part if out is None else out.unionByName(part)
    cells = out.join(F.broadcast(R.nrmse_denominators(rows.withColumn("_one", F.lit(1)), ["_one"], "gust").drop("_one")))
    metrics = R.cell_strength(R.regression_metrics(cells, ["model", "grid_id"], "gust", "oof", "denominator"))
    return metrics.select("model", "grid_id", "rows", *[r6(c).alias(c) for c in ("r2", "rmse", "nrmse")], "strict", "weak")


@query("common_factor_forward", "M24 A42 P07 E25")
def common_factor_forward(v) -> DataFrame:
    rows = checkpoint(_design(v).select("ts", *FEATURES, "actual_cf"))  # every fold reads its days, no other column
    daily = rows.groupBy("ts").agg(*[F.avg(c).alias(c) for c in FEATURES], F.count("actual_cf").alias("n"), F.avg("actual_cf").alias("common_cf")).where(F.col("n") >= 2)
    bounds = ["1998-01-01", "1999-01-01", "2000-01-01"]
    at = [F.lit(b).cast("timestamp_ntz") for b in bounds]
    folds = [(F.col("ts") < at[i], (F.col("ts") >= at[i]) & (F.col("ts") < at[i + 1])) for i in range(2)]
    oof = M.fold_predictions(daily, folds, lambda d: M.boosted(checkpoint(d), FEATURES, "common_cf"), FEATURES, "oof_cf", (0.0, 1.02))
    validated = reduce(or_, (valid for _, valid in folds))  # no other row meets a prediction
    rows = attach(v.fcst.where(validated), oof.select("ts", "oof_cf"), ["ts"], "inner").withColumn("raw", F.col("oof_cf") * F.col("capacity"))
    return K.fit_affine(rows, "raw", GROUPS)


@query("multi_seed_bag", "M25")
def multi_seed_bag(v) -> DataFrame:
    train, apply = _split(_rows(v))
    out = M.seed_bag(apply, [42, 43, 44], lambda s: M.boosted(train, FEATURES, "actual_cf", seed=s), FEATURES, "bag_cf")
    return _out(out, "bag_cf")
