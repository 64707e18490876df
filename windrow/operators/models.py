"""Model-backed operators on ``pyspark.ml``: fit and transform run on the executors.

Folds, groups, lead bins and seeds are short registered lists, so a loop over them only builds plans and fits.  Rows never
come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.functions.exprs import clip, edge_bin, finite
from windrow.functions.ranks import exact_quantiles
from windrow.functions.wind import inverse_target_transform, target_transform
from windrow.operators import decisions as D
from windrow.operators import interval_heads as H
from windrow.operators.association import pair_associations, weighted_auc
from windrow.operators.drift import median_fill_values
from windrow.operators.lookups import attach
from windrow.operators.packed_trees import boost
from windrow.operators.runs import bounded_correction
from windrow.operators.settlement import unit_price
from windrow.session import checkpoint

# fixed values
UPPER_CF = 1.02
DOMAIN_FOLDS, DOMAIN_PROBABILITY, DOMAIN_RATIO, DOMAIN_STRENGTH = 5, (0.05, 0.95), (0.25, 4.0), 0.1
RESIDUAL_TARGET_CLIP, RESIDUAL_PREDICTION_CLIP = 0.40, 0.25
PSEUDO_CLIP = (0.0, 1.02)
HUBER_EPSILON = 1.5
INTERVAL_ROUNDS = 140
POLICY_FACTORS = (0.98, 0.95)
STUDENT_GATE = {"r2": 0.02, "spearman": 0.15, "improvement": 0.02, "auc": 0.60}

VECTOR = "_features"
#: leaves of a forest whose quantiles are sent to every task
LEAF_TABLE = 200_000
#: training rows above which boosted trees are grown on packed rows, and the depth up to which they can be
PACKED_ROWS, PACKED_DEPTH = 1_500_000, 8
#: fits that run at the same time; each keeps its binned rows in memory
FITS = 3


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature vector column; a null or not-a-number feature fails the job, so fill before."""
    return VectorAssembler(inputCols=list(features), outputCol=VECTOR, handleInvalid="error").transform(df)


class TrainOnlyScaler:
    """Training medians fill gaps, then training mean and population spread scale; one row per feature is kept."""

    def __init__(self, train: DataFrame, features: Sequence[str], standardise: bool = True, fill: bool = True):
        self.features = list(features)
        self.medians = median_fill_values(train, self.features) if fill else None
        filled = self.fill(train)
        aggs = [a for i, f in enumerate(self.features) for a in (F.avg(f).alias(f"m{i}"), F.stddev_pop(f).alias(f"s{i}"))]
        row = filled.agg(*aggs).first() if standardise else None
        self.centre = [row[f"m{i}"] if row else 0.0 for i in range(len(self.features))]
        self.scale = [(row[f"s{i}"] or 1.0) if row else 1.0 for i in range(len(self.features))]

    def fill(self, df: DataFrame) -> DataFrame:
        if self.medians is None:
            return df
        return df.withColumns({f: F.when(finite(f), F.col(f).cast("double")).otherwise(F.lit(float(self.medians[f]))) for f in self.features})

    def transform(self, df: DataFrame) -> DataFrame:
        return self.fill(df).withColumns({f: (F.col(f) - m) / s for f, m, s in zip(self.features, self.centre, self.scale)})


def ridge(train: DataFrame, features: Sequence[str], target: str, alpha: float, weight: str | None = None) -> Model:
    """Ridge with the penalty ``alpha`` on the summed loss.

    The estimator averages the loss and divides the penalty by the label's spread, so the parameter is alpha times the
    spread over the weight total.  The normal-equation solver aggregates one features x features matrix.
    """
    rows = assemble(train, features)
    w = F.col(weight) if weight else F.lit(1.0)
    y = F.col(target)
    total = rows.agg(F.sum(w).alias("n"), (F.sum(w * y) / F.sum(w)).alias("m"), (F.sum(w * y * y) / F.sum(w)).alias("q")).first()
    spread = max(total["q"] - total["m"] ** 2, 0.0) ** 0.5 or 1.0
    model = LinearRegression(featuresCol=VECTOR, labelCol=target, regParam=alpha * spread / float(total["n"]), elasticNetParam=0.0, standardization=False, solver="normal")
    if weight:
        model = model.setWeightCol(weight)
    return model.fit(rows)


def huber(train: DataFrame, features: Sequence[str], target: str, epsilon: float = HUBER_EPSILON, reg: float = 0.0) -> Model:
    return LinearRegression(featuresCol=VECTOR, labelCol=target, loss="huber", epsilon=epsilon, regParam=reg, maxIter=100).fit(assemble(train, features))


def boosted(train: DataFrame, features: Sequence[str], target: str, weight: str | None = None, loss: str = "absolute", **params) -> Model:
    """Boosted trees; above ``PACKED_ROWS`` rows the same trees are grown on packed rows."""
    settings = {"maxIter": 60, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.85, "minInstancesPerNode": 20, "seed": 42, **params}
    if settings["maxDepth"] <= PACKED_DEPTH and train.limit(PACKED_ROWS + 1).count() > PACKED_ROWS:
        return boost(train, features, target, weight, loss, **settings).setFeaturesCol(VECTOR)
    model = GBTRegressor(featuresCol=VECTOR, labelCol=target, lossType=loss, **settings)
    return (model.setWeightCol(weight) if weight else model).fit(assemble(train, features))


def forest(train: DataFrame, features: Sequence[str], target: str, leaf: str | None = None, **params) -> Model:
    settings = {"numTrees": 60, "maxDepth": 10, "minInstancesPerNode": 8, "featureSubsetStrategy": "sqrt", "seed": 42, **params}
    model = RandomForestRegressor(featuresCol=VECTOR, labelCol=target, **settings)
    return (model.setLeafCol(leaf) if leaf else model).fit(assemble(train, features))


def predict(model: Model, df: DataFrame, features: Sequence[str], name: str, bounds: tuple[float, float] | None = None) -> DataFrame:
    out = model.transform(assemble(df, features)).drop(VECTOR)
    value = clip("prediction", *bounds) if bounds else F.col("prediction")
    return out.withColumn(name, value).drop("prediction")


def side_by_side(fits: Sequence[Callable[[], Model]]) -> list[Model]:
    """Models of independent fits, at most ``FITS`` of them at a time.

    A boosted fit is hundreds of short jobs one after the other; what one leaves idle between two of them, another takes.
    """
    session = SparkSession.getActiveSession()
    inherit = inheritable_thread_target(session) if session else lambda run: run
    with ThreadPool(min(len(fits), FITS)) as pool:
        return pool.map(inherit(lambda fit: fit()), fits, chunksize=1)


def per_group(df: DataFrame, apply: DataFrame, groups: Sequence[str], fit: Callable[[DataFrame], Model], features: Sequence[str], name: str, group: str = "grp",
              bounds: tuple[float, float] | None = (0.0, UPPER_CF)) -> DataFrame:
    """One model per group, predictions stacked again."""
    parts = [predict(fit(df.where(F.col(group) == g)), apply.where(F.col(group) == g), features, name, bounds) for g in groups]
    return reduce(DataFrame.unionByName, parts)


def shared_design(df: DataFrame, groups: Sequence[str], group: str = "grp", name: str = "group_id") -> DataFrame:
    """Group number by the registered order, so that train and application agree without a fitted indexer."""
    mapping = F.create_map(*[x for i, g in enumerate(groups) for x in (F.lit(g), F.lit(float(i)))])
    return df.withColumn(name, F.element_at(mapping, F.col(group)))


def gain_table(model: Model, features: Sequence[str], spark) -> DataFrame:
    """(position, feature, gain) of a tree model."""
    gains = model.featureImportances.toArray().tolist()
    return spark.createDataFrame([(i, f, float(g)) for i, (f, g) in enumerate(zip(features, gains))], "position int, feature string, gain double")


def leaf_rows(model: Model, df: DataFrame, features: Sequence[str], name: str = "leaves") -> DataFrame:
    """Leaf number of every tree as an array."""
    out = model.transform(assemble(df, features))
    return out.withColumn(name, F.transform(vector_to_array(model.getLeafCol()), lambda x: x.cast("bigint"))).drop(VECTOR, "prediction", model.getLeafCol())


def binned_quantile_surface(train: DataFrame, apply: DataFrame, prediction: str, target: str, levels: Sequence[float], bins: int = 20, minimum: int = 30) -> DataFrame:
    """Conditional quantiles: prediction plus residual quantiles of its prediction bin (the pooled ones for thin bins).

    Bin edges are exact quantiles of the training predictions; crossing levels are sorted.
    """
    one = train.withColumn("_one", F.lit(1))
    edges = exact_quantiles(one, ["_one"], prediction, [i / bins for i in range(1, bins)]).select(F.array_distinct("q")).first()[0]  # bins - 1 numbers
    place = lambda df: df.withColumn("_bin", edge_bin(prediction, edges))
    residuals = place(train).withColumn("_r", F.col(target) - F.col(prediction))
    local = exact_quantiles(residuals, ["_bin"], "_r", levels).where(F.col("n") >= minimum).select("_bin", F.col("q").alias("_local"))
    pooled = F.array(*[F.lit(float(q)) for q in exact_quantiles(residuals.withColumn("_one", F.lit(1)), ["_one"], "_r", levels).select("q").first()[0]])
    rows = attach(place(apply), local, ["_bin"])
    rows = rows.withColumn("_spread", F.coalesce("_local", pooled))
    return rows.withColumn("quantiles", F.array_sort(F.transform("_spread", lambda r: r + F.col(prediction)))).drop("_local", "_spread", "_bin")


def leaf_quantile_surface(fit: DataFrame, query: DataFrame, leaves: str, keys: Sequence[str], target: str, levels: Sequence[float]) -> DataFrame:
    """Conditional quantiles as the mean over trees of the leaf's exact quantiles.

    The leaves' quantiles are no larger than the forest, so they go to the queries; a query's trees are neighbours then, and fold before the shuffle.
    """
    q = exact_quantiles(D.leaf_rows(fit, leaves, [target]), ["tree", "leaf"], target, levels)
    rows = attach(D.leaf_rows(query, leaves, keys), q.select("tree", "leaf", "q"), ["tree", "leaf"], "inner", limit=LEAF_TABLE)
    out = rows.groupBy(*keys).agg(*[F.avg(F.element_at("q", i + 1)).alias(f"_q{i}") for i in range(len(levels))])
    return out.select(*keys, F.array_sort(F.array(*[F.col(f"_q{i}") for i in range(len(levels))])).alias("quantiles"))


def tempered_odds(df: DataFrame, probability: str, eligible_rows: Column, name: str) -> DataFrame:
    """Root of the bounded odds of a domain probability, with mean one over the eligible rows."""
    p = clip(probability, *DOMAIN_PROBABILITY)
    rows = df.withColumn("_raw", F.sqrt(clip(p / (1.0 - p), *DOMAIN_RATIO)))
    mean = rows.where(eligible_rows).agg(F.avg("_raw")).scalar()
    return rows.withColumn(name, F.col("_raw") / mean).drop("_raw")


def density_ratio(source: DataFrame, application: DataFrame, features: Sequence[str], run: str, eligible_rows: Column, folds: int = DOMAIN_FOLDS,
                  max_iter: int = 100) -> tuple[DataFrame, DataFrame]:
    """(weighted source rows, one-row audit): out-of-fold domain probabilities by run, tempered odds with mean one over the
    eligible rows, effective sample size and domain AUC.

    A run stays in one fold because the fold is its day number modulo the fold count.
    """
    fold = F.pmod(F.datediff(F.col(run).cast("date"), F.lit("1970-01-01").cast("date")), F.lit(folds))
    cols = [run, *features]
    extra = [c for c in source.columns if c not in cols]
    both = source.select(*cols, F.struct(*extra).alias("_keep"), F.lit(0.0).alias("_y"), eligible_rows.alias("_ok")).unionByName(
        application.select(*cols, F.lit(1.0).alias("_y")), allowMissingColumns=True).withColumn("_fold", fold)
    both = checkpoint(both)  # read by every fold
    parts = []
    for k in range(folds):
        train, held = both.where(F.col("_fold") != k), both.where(F.col("_fold") == k)
        scaler = TrainOnlyScaler(train, features, fill=False)
        counts = {r["_y"]: r["n"] for r in train.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
        total = sum(counts.values())
        weight = F.when(F.col("_y") == 1.0, total / (2.0 * counts[1.0])).otherwise(total / (2.0 * counts[0.0]))
        expand = PolynomialExpansion(degree=2, inputCol=VECTOR, outputCol="_poly")
        design = lambda df: expand.transform(assemble(scaler.transform(df), features))  # noqa: E731,B023
        model = LogisticRegression(featuresCol="_poly", labelCol="_y", weightCol="_w", regParam=1.0 / (DOMAIN_STRENGTH * total), elasticNetParam=0.0, standardization=False, maxIter=max_iter)
        fitted = model.fit(design(train.withColumn("_w", weight)))
        scored = fitted.transform(design(held)).withColumn("probability", F.element_at(vector_to_array("probability"), 2))
        parts.append(scored.select(run, "_keep", "_y", "_ok", "_fold", "probability"))
    oof = reduce(DataFrame.unionByName, parts)
    src = tempered_odds(oof.where(F.col("_y") == 0.0), "probability", F.col("_ok"), "density_weight")
    weighted = src.select(run, "_keep.*", "_fold", "_ok", F.col("probability").alias("domain_probability"), "density_weight")
    w = F.col("density_weight")
    audit = weighted.where("_ok").agg(
        F.count(F.lit(1)).alias("eligible_rows"), F.avg(w).alias("weight_mean"), F.min(w).alias("weight_min"), F.max(w).alias("weight_max"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("ess"))
    auc = weighted_auc(oof.select(F.lit(1).alias("_one"), F.col("probability").alias("x"), F.col("_y").alias("l"), F.lit(1.0).alias("w")), ["_one"], "x", "l", "w")
    return weighted, audit.join(F.broadcast(auc.select(F.col("weighted_auc").alias("domain_auc"))))


def residual_correction(train: DataFrame, apply: DataFrame, features: Sequence[str], baseline_cf: str, actual_cf: str, kind: str = "ridge", alpha: float = 100.0,
                        maximum: float = RESIDUAL_PREDICTION_CLIP, shrinkage: float = 1.0, target_clip: float = RESIDUAL_TARGET_CLIP,
                        scaler: TrainOnlyScaler | None = None, **params) -> DataFrame:
    """Learn the clipped residual of the eligible rows and add the clipped, shrunk prediction to the baseline.

    Calls on the same rows may share one ``scaler`` of the eligible ones.
    """
    rows = train.where(F.col(actual_cf) >= 0.10).withColumn("_target", clip(F.col(actual_cf) - F.col(baseline_cf), -target_clip, target_clip))
    scaler = scaler or TrainOnlyScaler(rows, features)
    fitted = scaler.transform(rows)
    model = {"ridge": lambda: ridge(fitted, features, "_target", alpha), "huber": lambda: huber(fitted, features, "_target"),
             "boosted": lambda: boosted(fitted, features, "_target", **params)}[kind]()
    # scaling happens on copies, so the caller's columns keep their values
    copies = {f"_x{i}": F.col(f) for i, f in enumerate(features)}
    out = apply.withColumns(copies)
    scored = predict(model, scaler.transform(out), features, "_raw")
    restored = scored.withColumns({f: F.col(f"_x{i}") for i, f in enumerate(features)}).drop(*copies)
    return restored.withColumns({"correction_cf": shrinkage * clip("_raw", -maximum, maximum), "corrected_cf": bounded_correction(baseline_cf, "_raw", maximum, shrinkage)}).drop("_raw")


def lead_experts(train: DataFrame, apply: DataFrame, features: Sequence[str], target: str, bins: Sequence[tuple[str, float, float]], lead: str,
                 fit: Callable[[DataFrame], Model]) -> DataFrame:
    """Global control and one expert per lead bin, stitched so that every row has both."""
    inside = [(F.col(lead) >= lo) & (F.col(lead) < hi) for _, lo, hi in bins]
    overall, *experts = side_by_side([partial(fit, rows) for rows in (train, *(train.where(c) for c in inside))])
    control = predict(overall, apply, features, "global_cf", (0.0, UPPER_CF))
    return reduce(DataFrame.unionByName, [predict(m, control.where(c), features, "expert_cf", (0.0, UPPER_CF)) for m, c in zip(experts, inside)])


def fold_predictions(df: DataFrame, folds: Sequence[tuple[Column, Column]], fit: Callable[[DataFrame], Model], features: Sequence[str], name: str,
                     bounds: tuple[float, float] | None = None) -> DataFrame:
    """Out-of-fold predictions for (train condition, validation condition) pairs; rows outside every validation stay out."""
    return reduce(DataFrame.unionByName, [predict(fit(df.where(train)), df.where(valid), features, name, bounds) for train, valid in folds])


def auxiliary_predictions(features_df: DataFrame, targets: DataFrame, keys: Sequence[str], features: Sequence[str], target_names: Sequence[str],
                          folds: Sequence[tuple[Column, Column]], group: str, bounds: Mapping[str, tuple[float | None, float | None]],
                          minimum: int = 50, **params) -> DataFrame:
    """Predicted telemetry targets, out of fold in time, for any number of groups: one regressor per fold and target.

    A group's level, the exact median of its training rows that have the target, is a feature beside the weather, so groups
    differ without a fit of their own.  A group with fewer than ``minimum`` such rows is given its level, one without any the
    median of all groups; a target no training row has stays null.
    """
    joined = checkpoint(features_df.join(targets.select(*keys, *target_names), list(keys), "left"))  # read by every fit
    out = []
    for train, valid in folds:
        rows = joined.where(train)
        scaler = TrainOnlyScaler(rows, features, standardise=False)
        part = scaler.fill(joined.where(valid))
        for t in target_names:
            known = scaler.fill(rows.where(F.col(t).isNotNull()))
            lo, hi = bounds.get(t, (None, None))
            if known.isEmpty():
                part = part.withColumn(f"pred_{t}", F.lit(None).cast("double"))
                continue
            levels = checkpoint(exact_quantiles(known, [group], t, [0.5]).select(group, F.col("n").alias("_n"), F.element_at("q", 1).alias("_own")))
            pooled = exact_quantiles(known.withColumn("_one", F.lit(1)), ["_one"], t, [0.5]).select(F.element_at("q", 1)).first()[0]
            with_level = lambda df: attach(df, levels, [group]).withColumn("_level", F.coalesce("_own", F.lit(pooled)))  # noqa: E731,B023
            design = [*features, "_level"]
            model = boosted(with_level(known), design, t, loss="absolute", **params)
            scored = predict(model, with_level(part), design, "_p")
            value = F.when(F.coalesce("_n", F.lit(0)) >= minimum, F.col("_p")).otherwise(F.col("_level"))
            part = scored.withColumn(f"pred_{t}", clip(value, lo, hi)).drop("_n", "_own", "_level", "_p")
        out.append(part.select(*keys, *[f"pred_{t}" for t in target_names]))
    return features_df.join(reduce(DataFrame.unionByName, out), list(keys), "left")


def pseudo_labels(wide_cf: DataFrame, known: Column, unknown: Column, inputs: Sequence[str], target: str, **params) -> DataFrame:
    """Learn one farm from the others where all are known, apply where it is not, and stack: actual rows first, then
    pseudo rows, marked by origin."""
    complete = wide_cf.where(known)
    for c in (*inputs, target):
        complete = complete.where(finite(c))
    model = boosted(complete, list(inputs), target, loss="squared", **params)
    ready = wide_cf.where(unknown)
    for c in inputs:
        ready = ready.where(finite(c))
    return stack_labels(wide_cf.where(known), predict(model, ready.drop(target), list(inputs), target), target)


def stack_labels(actual: DataFrame, pseudo: DataFrame, target: str) -> DataFrame:
    """Rows with a finite actual target, then rows with a bounded pseudo target, marked by origin; eligible rows only."""
    real = actual.where(finite(target)).withColumn("origin", F.lit("actual"))
    made = pseudo.withColumns({target: clip(target, *PSEUDO_CLIP), "origin": F.lit("pseudo")})
    return real.unionByName(made.select(*real.columns)).where(F.col(target) >= 0.10)


def class_pmf(train: DataFrame, apply: DataFrame, features: Sequence[str], label: Column, classes: int, **params) -> DataFrame:
    """Class probabilities scattered to the fixed class list: a class that never occurred in training has zero mass."""
    rows = train.withColumn("_class", label)
    seen = [r["_class"] for r in rows.select("_class").distinct().orderBy("_class").limit(classes + 1).collect()]
    index = F.create_map(*[x for i, c in enumerate(seen) for x in (F.lit(int(c)), F.lit(float(i)))])
    settings = {"numTrees": 30, "maxDepth": 5, "minInstancesPerNode": 20, "seed": 42, **params}
    model = RandomForestClassifier(featuresCol=VECTOR, labelCol="_y", **settings).fit(assemble(rows.withColumn("_y", F.element_at(index, F.col("_class").cast("int"))), features))
    position = {int(c): i for i, c in enumerate(seen)}
    scored = model.transform(assemble(apply, features)).withColumn("_p", vector_to_array("probability"))
    pmf = F.array(*[F.element_at("_p", position[c] + 1) if c in position else F.lit(0.0) for c in range(classes)])
    return scored.withColumn("pmf", pmf).drop(VECTOR, "rawPrediction", "probability", "prediction", "_p")


def expand_actions(df: DataFrame, actions: Sequence[float], name: str = "action") -> DataFrame:
    """Rows x fixed actions."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(a)) for a in actions])))


def interval_policy(train: DataFrame, apply: DataFrame, features: Sequence[str], actual_cf: str, base_cf: str, grid: Sequence[float], **params) -> DataFrame:
    """P(error <= 6 %), P(error <= 8 %) and expected error per action, repaired, turned into utilities, best action chosen.

    The three heads see the action as a feature beside the others; rows are not multiplied by the actions.
    """
    settings = {"maxIter": INTERVAL_ROUNDS, "maxDepth": 4, "stepSize": 0.1, "seed": 42, **params}
    rows = checkpoint(train.where(F.col(actual_cf) >= 0.10).select(*dict.fromkeys([*features, actual_cf])))  # read by every renewed round
    return H.choose(apply, features, base_cf, grid, H.fit(rows, features, actual_cf, grid, **settings))


def uplift_policy(train: DataFrame, apply: DataFrame, features: Sequence[str], actual_cf: str, base_cf: str, mean_actual_cf: float,
                  factors: Sequence[float] = POLICY_FACTORS, **params) -> DataFrame:
    """Predict the utility change of fixed scale factors and apply the best one where it is positive."""
    rows = expand_actions(train.where(F.col(actual_cf) >= 0.10), factors, "factor")
    b = clip(base_cf, 0.0, UPPER_CF)
    moved = clip(F.col("factor") * b, 0.0, UPPER_CF)
    e0, e1, y = F.abs(b - F.col(actual_cf)), F.abs(moved - F.col(actual_cf)), F.col(actual_cf)
    gain = 0.5 * (e0 - e1) + 0.5 * (y / mean_actual_cf) * (unit_price(e1) - unit_price(e0)) / 4.0
    shape = {"proposed": moved, "step": moved - b}
    design = [*features, "factor", "proposed", "step"]
    model = boosted(rows.withColumn("_gain", gain).withColumns(shape), design, "_gain", loss="squared", **params)
    out = apply
    for i, f in enumerate(factors):
        one = out.withColumn("factor", F.lit(float(f))).withColumns(shape)
        out = predict(model, one, design, f"_g{i}").drop("factor", "proposed", "step")
    options = F.array(F.struct(F.lit(0.0).alias("g"), F.lit(0).alias("o"), F.lit(1.0).alias("f")),
                      *[F.struct(F.col(f"_g{i}").alias("g"), F.lit(-1 - i).alias("o"), F.lit(float(f)).alias("f")) for i, f in enumerate(factors)])
    best = F.array_max(options)
    return out.withColumns({"factor": best["f"], "predicted_gain": best["g"]}).withColumn("policy_cf", clip(F.col("factor") * b, 0.0, UPPER_CF)).drop(*[f"_g{i}" for i in range(len(factors))])


def transformed_regressors(train: DataFrame, apply: DataFrame, features: Sequence[str], target: str, kinds: Sequence[str], **params) -> DataFrame:
    """For every transform fit on the transformed target, predict, transform back; one column each."""
    rows = train.where(F.col(target) >= 0.10)
    models = side_by_side([partial(boosted, rows.withColumn("_t", target_transform(target, kind)), features, "_t", **params) for kind in kinds])
    out = apply
    for kind, model in zip(kinds, models):
        out = predict(model, out, features, "_p").withColumn(kind, inverse_target_transform("_p", kind)).drop("_p")
    return out


def seed_bag(apply: DataFrame, seeds: Sequence[int], fit: Callable[[int], Model], features: Sequence[str], name: str, bounds: tuple[float, float] | None = (0.0, UPPER_CF)) -> DataFrame:
    """Mean prediction over seeds; members stand side by side, so nothing is joined."""
    out = apply
    for s, model in zip(seeds, side_by_side([partial(fit, s) for s in seeds])):
        out = predict(model, out, features, f"_b{s}", bounds)
    mean = reduce(lambda a, b: a + b, [F.col(f"_b{s}") for s in seeds]) / float(len(seeds))
    return out.withColumn(name, mean).drop(*[f"_b{s}" for s in seeds])


def student_report(scored: DataFrame, keys: Sequence[str], actual: str, model: str, baselines: Sequence[str], binary: str) -> DataFrame:
    """MAE of the model and the baselines, R2, Spearman, AUC and the gate per group."""
    y = F.col(actual)
    mae = {c: F.avg(F.abs(F.col(c) - y)) for c in (model, *baselines)}
    basic = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *[e.alias(f"mae_{c}") for c, e in mae.items()],
        (1.0 - F.sum((y - F.col(model)) * (y - F.col(model))) / F.regr_syy(y, y)).alias("r2"))
    rho = pair_associations(scored.withColumn("_w", F.lit(1.0)), keys, model, actual, "_w").select(*keys, "spearman")
    auc = weighted_auc(scored.select(*keys, model, F.col(binary).cast("double").alias("_l"), F.lit(1.0).alias("_w")), keys, model, "_l", "_w").select(*keys, F.col("weighted_auc").alias("auc"))
    out = basic.join(rho, list(keys), "left").join(auc, list(keys), "left")
    best = F.least(*[F.col(f"mae_{b}") for b in baselines])
    out = out.withColumn("improvement", (best - F.col(f"mae_{model}")) / best)
    g = STUDENT_GATE
    ok = (F.col("r2") >= g["r2"]) & (F.col("spearman") >= g["spearman"]) & (F.col("improvement") >= g["improvement"]) & (F.col("auc").isNull() | (F.col("auc") >= g["auc"]))
    return out.withColumn("gate", F.coalesce(ok, F.lit(False)))


def crossfit(df: DataFrame, fold: str, folds: Sequence[int], fit: Callable[[DataFrame], Model], features: Sequence[str], name: str = "oof") -> DataFrame:
    """Every fold predicted by a model that never saw it."""
    pairs = [(F.col(fold) != k, F.col(fold) == k) for k in folds]
    return fold_predictions(df, pairs, fit, features, name)
