"""Composition, decision, search and gate queries."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.functions.exprs import r6, rounded, total
from windrow.operators import calibrate as K
from windrow.operators import compose as E
from windrow.operators import decisions as D
from windrow.operators import gates as G
from windrow.operators import meta as A
from windrow.operators import settlement as S
from windrow.operators import slices as L
from windrow.operators.decisions import ACTION_GRID, interval_utilities
from windrow.plans.digest import row_values, row_values_sql
from windrow.plans.registry import query
from windrow.plans.scoring import _DELTA_COLUMNS, _ELIG, _PAIRED_SQL, _TRIPLE
from windrow.plans.weather import PI

WEIGHTS = {"g1": {"base": 0.5, "cand": 0.3, "third": 0.2}, "g2": {"base": 0.25, "cand": 0.25, "third": 0.5}, "g3": {"base": 0.0, "cand": 0.8, "third": 0.2}}


def _case(values: dict) -> str:
    return "CASE grp " + " ".join(f"WHEN '{g}' THEN {v}" for g, v in values.items()) + " END"


def _lit(values) -> str:
    return "[" + ", ".join(f"CAST('{v!r}' AS DOUBLE)" for v in values) + "]"


@query("simplex_blend", "E01", f"""
SELECT grp, site, ts, round(sum(CASE model WHEN 'base' THEN {_case({g: w['base'] for g, w in WEIGHTS.items()})} WHEN 'cand' THEN
  {_case({g: w['cand'] for g, w in WEIGHTS.items()})} ELSE {_case({g: w['third'] for g, w in WEIGHTS.items()})} END * kwh) + 1e-9, 6) AS blend
FROM components GROUP BY 1, 2, 3""")
def simplex_blend(v) -> DataFrame:
    return rounded(E.blend_long(v.components, WEIGHTS, ["grp", "site", "ts"]), ["grp", "site", "ts"], ["blend"])


RECIPES = {
    "g1": E.GroupRecipe(WEIGHTS["g1"], 1.05, -1.2, 0.0, 1.02, (0.0, 0.25, 0.5, 0.75, 1.02), (0.4, -0.2, 0.3, -0.5)),
    "g2": E.GroupRecipe(WEIGHTS["g2"], 1.025, -0.6),
    "g3": E.GroupRecipe(WEIGHTS["g3"], 1.075, -1.8, 0.02, 1.0, (0.0, 0.3, 0.6, 1.02), (0.1, 0.2, -0.3)),
}


def _recipe_sql(g: str) -> str:
    r = RECIPES[g]
    mix = " + ".join(f"{w} * {m}" for m, w in r.weights.items())
    cal = f"least(greatest({r.scale} * ({mix}) + ({r.bias}), {r.lower} * capacity), {r.upper} * capacity)"
    if r.bin_edges is None:
        return cal
    steps = "CASE " + " ".join(f"WHEN {cal} / capacity >= {e} THEN {d}" for e, d in reversed(list(zip(r.bin_edges[1:-1], r.bin_deltas[1:])))) + f" ELSE {r.bin_deltas[0]} END"
    return f"least(greatest({cal} + {steps}, {r.lower} * capacity), {r.upper} * capacity)"


_CHAIN = "CASE grp " + " ".join(f"WHEN '{g}' THEN {_recipe_sql(g)}" for g in RECIPES) + " END"


@query("locked_forecast_chain", "E05 E02 E03 E04 E06", f"""
WITH c AS (SELECT *, {_CHAIN} AS locked, CASE grp WHEN 'g1' THEN least(greatest(1.1 * (0.8 * cand + 0.2 * third) - 0.7, 0), 1.02 * capacity)
   WHEN 'g2' THEN least(greatest(1.025 * base - 0.1, 0), 1.02 * capacity)
   ELSE least(greatest(0.5 * {_recipe_sql('g3')} + 0.5 * least(greatest(1.075 * (0.7 * cand + 0.3 * base) - 0.3, 0), 1.02 * capacity), 0), 1.02 * capacity) END AS recent FROM fcst),
h AS (SELECT *, CASE WHEN grp = 'g3' THEN recent ELSE least(greatest(0.5 * locked + 0.5 * recent, 0), 1.02 * capacity) END AS hybrid FROM c)
SELECT grp, site, ts, round(locked + 1e-9, 6) AS locked, round(recent + 1e-9, 6) AS recent, round(hybrid + 1e-9, 6) AS hybrid FROM h""")
def locked_forecast_chain(v) -> DataFrame:
    rows = E.assemble(v.fcst, RECIPES, "locked")
    recent = E.by_group("grp", {
        "g1": E.capped(1.1 * E.weighted({"cand": 0.8, "third": 0.2}) - 0.7), "g2": E.capped(1.025 * F.col("base") - 0.1),
        "g3": E.convex("locked", E.capped(1.075 * E.weighted({"cand": 0.7, "base": 0.3}) - 0.3), 0.5, 1.02 * F.col("capacity"))})
    rows = rows.withColumn("recent", recent)
    hybrid = F.when(F.col("grp") == "g3", F.col("recent")).otherwise(E.capped(0.5 * F.col("locked") + 0.5 * F.col("recent")))
    return rounded(rows.withColumn("hybrid", hybrid), ["grp", "site", "ts"], ["locked", "recent", "hybrid"])


_CAP = lambda e: f"least(greatest({e}, 0), 1.02 * capacity)"
_CF = lambda e: f"least(greatest({e}, 0), 1.02)"
_INC = {
    "bounded": "least(greatest(0.98 * base + 0.01 * capacity, 0.05 * capacity), 0.9 * capacity)",
    "delta_transfer": f"CASE WHEN grp IN ('g1', 'g3') THEN {_CAP('base + (cand - third)')} ELSE base END",
    "paired": _CAP(f"base + 0.25 * capacity * ({_CF('cand / capacity')} - {_CF('third / capacity')})"),
    "consensus_base": _CAP("0.97 * base"),
    "consensus": f"CASE WHEN grp = 'g1' THEN {_CAP('0.97 * base')} ELSE {_CAP(_CAP('0.97 * base') + ' + 0.25 * capacity * ((cand - base) / capacity + (third - base) / capacity + (cand - third) / capacity) / 3.0')} END",
    "scaled_all": _CAP("base * 0.95"), "scaled_g2": f"CASE WHEN grp = 'g2' THEN {_CAP('base * 0.92')} ELSE base END",
    "low_output_scaled": "CASE WHEN base / capacity <= 0.25 THEN 0.95 * base ELSE base END",
    "long_lead_scaled": "CASE WHEN (hour(ts + (site % 24) * INTERVAL 1 HOUR) + 23) % 24 + 12 >= 24 THEN 0.95 * base ELSE base END",
    "regime": _CAP("base + 0.2 * CASE WHEN third / 4 <= 6 OR third / 4 >= 12 THEN 1.0 ELSE 0.0 END * (cand - base)"),
    "anti_ensemble": _CAP("base + (-0.5) * (cand - base)"), "half": _CAP("base + 0.5 * (cand - base)"),
    "shrunk": f"{_CF('base / capacity + 0.5 * ((cand - base) / capacity)')} * capacity",
    "transferred": f"{_CF('0.9 * (base / capacity) + 0.1 * (cand / capacity)')} * capacity",
    "iqr_centre": "0.5 * (list_aggregate([base, cand, third], 'quantile_cont', 0.25) + list_aggregate([base, cand, third], 'quantile_cont', 0.75))",
}


@query("composition_rules", "E03 E07 E08 E09 E10 E11 E12 E13 E15 E22 E23 P21", f"""
WITH x AS (SELECT grp, site, ts, {', '.join(f'{e} AS {n}' for n, e in _INC.items())} FROM fcst) {row_values_sql('x', ['grp', 'site', 'ts'], _INC)}""")
def composition_rules(v) -> DataFrame:
    cap, base = F.col("capacity"), F.col("base")
    cf = lambda c: F.col(c) / cap
    incs = [(F.col("cand") - base) / cap, (F.col("third") - base) / cap, (F.col("cand") - F.col("third")) / cap]
    cbase, consensus = E.consensus_increment("base", incs, 0.25, "grp", ["g1"], scale=0.97)
    shifted = F.timestamp_add("HOUR", F.col("site") % 24, F.col("ts"))
    rules = {
        "bounded": E.bounded("base", "capacity", F.lit(0.98), F.lit(0.01), F.lit(0.05), F.lit(0.9)),
        "delta_transfer": E.delta_transfer("base", "third", "cand", "grp", ["g1", "g3"]),
        "paired": E.paired_increment("base", cf("third"), cf("cand"), 0.25), "consensus_base": cbase, "consensus": consensus,
        "scaled_all": E.scaled("base", 0.95), "scaled_g2": E.scaled("base", 0.92, group="grp", only="g2"),
        "low_output_scaled": E.conditional_scale("base", E.low_output("base", "capacity"), 0.95),
        "long_lead_scaled": E.conditional_scale("base", E.long_lead(shifted), 0.95),
        "regime": E.regime_blend("base", "cand", F.col("third") / 4, 0.2), "anti_ensemble": E.extrapolate("base", "cand", -0.5),
        "half": E.convex("base", "cand", 0.5, 1.02 * cap), "shrunk": E.action_shrink("base", (F.col("cand") - base) / cap, 0.5),
        "transferred": E.action_transfer("base", cf("cand")), "iqr_centre": E.interquartile_centre(["base", "cand", "third"]),
    }
    return row_values(v.fcst.select("grp", "site", "ts", *[c.alias(n) for n, c in rules.items()]), ["grp", "site", "ts"], list(_INC))


@query("scale_separability", "E10", f"""
WITH c AS (SELECT grp, actual, capacity, unnest(['base', 'all', 'g1', 'g2', 'g3']) AS variant, base FROM fcst WHERE {_ELIG}),
p AS (SELECT *, CASE WHEN variant = 'all' OR variant = grp THEN {_CAP('base * 0.95')} ELSE base END AS p FROM c),
e AS (SELECT *, abs(p - actual) / capacity AS e FROM p),
g AS (SELECT variant, grp, 1 - avg(e) AS om, sum(actual * CASE WHEN e <= 0.06 THEN 4.0 WHEN e <= 0.08 THEN 3.0 ELSE 0.0 END) / (4 * sum(actual)) AS f FROM e GROUP BY 1, 2),
m AS (SELECT variant, avg(om) AS om, avg(f) AS f, 0.5 * avg(om) + 0.5 * avg(f) AS s FROM g GROUP BY 1)
SELECT round(max(s) FILTER (variant = 'all') - max(s) FILTER (variant = 'base') + 1e-9, 6) AS global_delta,
       round(sum(s) FILTER (variant IN ('g1', 'g2', 'g3')) - 3 * max(s) FILTER (variant = 'base') + 1e-9, 6) AS sum_group_deltas,
       round(max(s) FILTER (variant = 'all') - max(s) FILTER (variant = 'base') - (sum(s) FILTER (variant IN ('g1', 'g2', 'g3')) - 3 * max(s) FILTER (variant = 'base')) + 1e-9, 6) + 0 AS residual FROM m""")
def scale_separability(v) -> DataFrame:
    variants = {"base": F.col("base"), "all": E.scaled("base", 0.95), **{g: E.scaled("base", 0.95, group="grp", only=g) for g in ("g1", "g2", "g3")}}
    wide = v.fcst.select("grp", "actual", "capacity", F.explode(F.array(*[
        F.struct(F.lit(n).alias("variant"), c.alias("p")) for n, c in variants.items()])).alias("v")).select("grp", "actual", "capacity", "v.*")
    macro = S.macro_score(S.group_metrics(wide, ["variant", "grp"], "p"), ["variant"])
    one = macro.agg(*[F.max(F.when(F.col("variant") == n, F.col("total_score"))).alias(n) for n in variants])
    groups = [F.col(g) for g in ("g1", "g2", "g3")]
    total = sum((g - F.col("base") for g in groups[1:]), groups[0] - F.col("base"))
    return one.select(r6(F.col("all") - F.col("base")).alias("global_delta"), r6(total).alias("sum_group_deltas"),
                      r6(E.separability_residuals(dict(zip("123", groups)), F.col("base"), F.col("all"))).alias("residual"))


_COR = """sc AS (SELECT grp, site, ts, capacity, [base, cand, third] AS s, list_aggregate([base, cand, third], 'median') AS med FROM fcst),
ac AS (SELECT *, unnest(list_sort(list_transform(flatten(list_transform(s, lambda m: list_transform([-0.08e0, -0.06e0, 0.0e0, 0.06e0, 0.08e0], lambda o: m + o * capacity))), lambda a: least(greatest(a, 0), capacity)))) AS a FROM sc),
ut AS (SELECT *, list_avg(list_transform(s, lambda y: (y / capacity) * (CASE WHEN abs(a - y) / capacity <= 0.06 THEN 4.0 WHEN abs(a - y) / capacity <= 0.08 THEN 3.0 ELSE 0.0 END) / 4.0 - abs(a - y) / capacity)) AS u FROM ac),
mx AS (SELECT *, max(u) OVER (PARTITION BY grp, site, ts) AS mu FROM ut)"""


@query("corridor_action", "E14 E15", f"""
WITH {_COR}, rk AS (SELECT *, row_number() OVER (PARTITION BY grp, site, ts ORDER BY CASE WHEN u >= mu - 1e-12 THEN 0 ELSE 1 END, round(abs(a - med), 12), a) AS rn FROM mx)
SELECT rk.grp, rk.site, rk.ts, round(rk.a + 1e-9, 6) AS action, round(least(greatest(0.75 * base + 0.25 * rk.a, 0), rk.capacity) + 1e-9, 6) AS candidate
FROM rk JOIN fcst g ON g.grp = rk.grp AND g.site = rk.site AND g.ts = rk.ts WHERE rn = 1""")
def corridor_action(v) -> DataFrame:
    rows = v.fcst.withColumn("action", D.corridor_action(["base", "cand", "third"], "capacity"))
    rows = rows.withColumn("candidate", E.convex("base", "action", 0.25, "capacity"))
    return rounded(rows, ["grp", "site", "ts"], ["action", "candidate"])


def _choice_sql(source: str, keys: str, order: str) -> str:
    return (f"mx AS (SELECT *, max(u) OVER (PARTITION BY {keys}) AS mu FROM {source}), "
            f"rk AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY CASE WHEN u >= mu - 1e-12 THEN 0 ELSE 1 END, {order}) AS rn FROM mx)")


_PMF = lambda centres, at: f"list_transform({_lit(centres)}, lambda c: greatest(1 - 4 * abs(c - ({at})), 0) + 0.01)"
_PRICE = lambda g: f"(CASE WHEN {g} <= 0.06 THEN 4.0 WHEN {g} <= 0.08 THEN 3.0 ELSE 0.0 END)"


def _mean_cf(train: DataFrame) -> float:
    """Mean capacity factor of the scored rows: one number."""
    return train.where(F.col("actual") >= 0.10 * F.col("capacity")).agg(F.avg(F.col("actual") / F.col("capacity"))).first()[0]


@query("ordinal_class_action", "E16 F34", f"""
WITH mc AS (SELECT avg(actual / capacity) AS m FROM fcst WHERE {_ELIG}),
r AS (SELECT grp, site, ts, base / capacity AS b, {_PMF(D.CLASS_CENTRES, 'cand / capacity')} AS p0 FROM fcst),
p AS (SELECT *, list_sum(p0) AS tp FROM r),
a AS (SELECT *, unnest(list_distinct(list_transform({_lit(D.ACTION_DELTAS)}, lambda d: least(greatest(b + d, 0), 1.02)))) AS a FROM p),
k AS (SELECT grp, site, ts, b, a, unnest(p0) / tp AS w, unnest({_lit(D.CLASS_CENTRES)}) AS y FROM a),
ut AS (SELECT grp, site, ts, b, a, sum(w * (y * {_PRICE('abs(a - y)')} / (4 * (SELECT m FROM mc)) - abs(a - y))) AS u FROM k GROUP BY ALL),
{_choice_sql('ut', 'grp, site, ts', 'round(abs(a - b), 15), a')}
SELECT grp, site, ts, round(a + 1e-9, 6) AS action, round(u + 1e-9, 6) AS utility FROM rk WHERE rn = 1""")
def ordinal_class_action(v) -> DataFrame:
    rows = _pmf(v.fcst, D.CLASS_CENTRES, F.col("cand") / F.col("capacity"))
    rows = rows.withColumn("c", D.class_action("pmf", F.col("base") / F.col("capacity"), F.lit(_mean_cf(v.fcst))))
    return rows.select("grp", "site", "ts", r6("c.action").alias("action"), r6("c.utility").alias("utility"))


def _pmf(df: DataFrame, centres, at) -> DataFrame:
    names = [f"_p{i}" for i in range(len(centres))]
    rows = df.withColumn("_at", at).withColumns({n: F.greatest(1 - 4 * F.abs(F.lit(c) - F.col("_at")), F.lit(0.0)) + 0.01 for n, c in zip(names, centres)})
    rows = rows.withColumn("_t", total([F.lit(0.0), *[F.col(n) for n in names]]))  # a column, so it is added up once a row
    return rows.withColumn("pmf", F.array(*[F.col(n) / F.col("_t") for n in names])).drop("_at", "_t", *names)


@query("residual_class_action", "E16 E22", f"""
WITH mc AS (SELECT avg(actual / capacity) AS m FROM fcst WHERE {_ELIG}),
r AS (SELECT grp, site, ts, base, capacity, base / capacity AS b, {_PMF(D.RESIDUAL_CENTRES, '(cand - base) / capacity')} AS p0 FROM fcst),
p AS (SELECT *, list_sum(p0) AS tp FROM r),
a AS (SELECT *, unnest({_lit(D.ACTION_DELTAS)}) AS d FROM p),
k AS (SELECT grp, site, ts, base, capacity, d, least(greatest(b + d, 0), 1.02) AS a, unnest(p0) / tp AS w, unnest(list_transform({_lit(D.RESIDUAL_CENTRES)}, lambda q: least(greatest(b + q, 0.10e0), 1.2e0))) AS y FROM a),
ut AS (SELECT grp, site, ts, base, capacity, d, sum(w * (y * {_PRICE('abs(a - y)')} / (4 * (SELECT m FROM mc)) - abs(a - y))) AS u FROM k GROUP BY ALL),
{_choice_sql('ut', 'grp, site, ts', 'round(abs(d), 15), d')}
SELECT grp, site, ts, round(d + 1e-9, 6) AS delta, round(u + 1e-9, 6) AS utility, round(least(greatest(base / capacity + 0.25 * d, 0), 1.02) * capacity + 1e-9, 6) AS shrunk FROM rk WHERE rn = 1""")
def residual_class_action(v) -> DataFrame:
    rows = _pmf(v.fcst, D.RESIDUAL_CENTRES, (F.col("cand") - F.col("base")) / F.col("capacity"))
    delta, choice = D.residual_action("pmf", F.col("base") / F.col("capacity"), F.lit(_mean_cf(v.fcst)))
    rows = rows.withColumn("_c", choice).withColumn("delta", F.element_at(D.literal_array(D.ACTION_DELTAS), F.col("_c.position") + 1))
    return rows.select("grp", "site", "ts", r6("delta").alias("delta"), r6("_c.utility").alias("utility"), r6(E.action_shrink("base", "delta", 0.25)).alias("shrunk"))


_Q5 = ["0.8 * base / capacity", "base / capacity", "cand / capacity", "third / capacity", "1.15 * cand / capacity"]


def _outcome_sql() -> str:
    parts = []
    lv = D.QUANTILE_LEVELS
    for i in range(33):
        p = lv[0] + (lv[-1] - lv[0]) * i / 32
        k = max(j for j in range(4) if lv[j] <= p + 1e-15)
        t = min(max((p - lv[k]) / (lv[k + 1] - lv[k]), 0.0), 1.0)
        parts.append(f"least(greatest(q[{k + 1}] + (q[{k + 2}] - q[{k + 1}]) * CAST('{t!r}' AS DOUBLE), 0.1e0), 1.2e0)")
    return "[" + ", ".join(parts) + "]"


@query("quantile_action", "E17 F24", f"""
WITH mc AS (SELECT avg(actual / capacity) AS m FROM fcst WHERE {_ELIG}),
r AS (SELECT grp, site, ts, base / capacity AS b, list_sort([{', '.join(_Q5)}]) AS q FROM fcst),
o AS (SELECT *, {_outcome_sql()} AS ys FROM r),
a AS (SELECT *, unnest(list_sort(list_distinct(list_transform(list_concat(list_concat({_lit([round(0.01 * i, 12) for i in range(103)])}, [b]), q), lambda x: least(greatest(x, 0.0e0), 1.02e0))))) AS a FROM o),
k AS (SELECT grp, site, ts, b, a, unnest(ys) AS y FROM a),
ut AS (SELECT grp, site, ts, b, a, avg(y * {_PRICE('abs(a - y)')} / (4 * (SELECT m FROM mc)) - abs(a - y)) AS u FROM k GROUP BY ALL),
{_choice_sql('ut', 'grp, site, ts', 'round(abs(a - b), 15), a')}
SELECT grp, site, ts, round(a + 1e-9, 6) AS action, round(u + 1e-9, 6) AS utility FROM rk WHERE rn = 1""")
def quantile_action(v) -> DataFrame:
    cap = F.col("capacity")
    quantiles, _ = D.repaired_quantiles([0.8 * F.col("base") / cap, F.col("base") / cap, F.col("cand") / cap, F.col("third") / cap, 1.15 * F.col("cand") / cap])
    rows = v.fcst.withColumns({"q": quantiles, "b": F.col("base") / cap})
    rows = rows.withColumn("c", D.quantile_action("q", "b", F.lit(_mean_cf(v.fcst))))
    return rows.select("grp", "site", "ts", r6("c.action").alias("action"), r6("c.utility").alias("utility"))


@query("residual_quantile_action", "E17", f"""
WITH mc AS (SELECT avg(actual / capacity) AS m FROM fcst WHERE {_ELIG}),
r AS (SELECT grp, site, ts, base / capacity AS b, list_sort(list_transform([{', '.join(_Q5)}], lambda x: x - base / capacity)) AS q FROM fcst),
o AS (SELECT *, {_outcome_sql().replace('least(greatest(q', 'least(greatest(b + (q').replace(', 0.1e0)', '), 0.1e0)')} AS ys FROM r),
a AS (SELECT *, unnest(list_sort(list_distinct(list_transform(list_concat(list_concat({_lit([round(0.01 + 0.01 * i, 12) for i in range(102)])}, [b]), list_transform(q, lambda x: x + b)), lambda x: least(greatest(x, 0.0e0), 1.02e0))))) AS a FROM o),
k AS (SELECT grp, site, ts, b, a, unnest(ys) AS y FROM a),
ut AS (SELECT grp, site, ts, b, a, avg(y * {_PRICE('abs(a - y)')} / (4 * (SELECT m FROM mc)) - abs(a - y)) AS u FROM k GROUP BY ALL),
{_choice_sql('ut', 'grp, site, ts', 'round(abs(a - b), 15), a')}
SELECT grp, site, ts, round(a + 1e-9, 6) AS action, round(u + 1e-9, 6) AS utility FROM rk WHERE rn = 1""")
def residual_quantile_action(v) -> DataFrame:
    cap = F.col("capacity")
    b = F.col("base") / cap
    quantiles, _ = D.repaired_quantiles([0.8 * F.col("base") / cap - b, b - b, F.col("cand") / cap - b, F.col("third") / cap - b, 1.15 * F.col("cand") / cap - b])
    rows = v.fcst.withColumns({"q": quantiles, "b": b})
    rows = rows.withColumn("c", D.quantile_action("q", "b", F.lit(_mean_cf(v.fcst)), residual=True, first_grid=0.01))
    return rows.select("grp", "site", "ts", r6("c.action").alias("action"), r6("c.utility").alias("utility"))


_THIN = [0.5 / 41 + (1 - 1 / 41) * i / 40 for i in range(41)]


@query("residual_sample_decision", "E18 T09", f"""
WITH mc AS (SELECT avg(actual / capacity) AS m FROM fcst WHERE {_ELIG} AND ts < TIMESTAMP '1999-01-01'),
f AS (SELECT (actual - base) / capacity AS r, base / capacity AS b FROM fcst WHERE {_ELIG} AND ts < TIMESTAMP '1999-01-01'),
ed AS (SELECT unnest([0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95]) AS e),
fb AS (SELECT *, (SELECT count(*) FROM ed WHERE e <= b) AS bin FROM f),
s0 AS (SELECT bin, count(*) AS n, quantile_cont(r, {_THIN}) AS c, stddev_samp(r) AS sd, (quantile_cont(r, 0.75) - quantile_cont(r, 0.25)) / 1.349 AS rb FROM fb GROUP BY ALL
       UNION ALL SELECT -1, count(*), quantile_cont(r, {_THIN}), stddev_samp(r), (quantile_cont(r, 0.75) - quantile_cont(r, 0.25)) / 1.349 FROM fb),
s1 AS (SELECT *, least(greatest(0.9 * greatest(CASE WHEN rb > 0 THEN least(sd, rb) ELSE sd END, 1e-12) * pow(n, -0.2), 0.003), 0.03) AS h FROM s0),
s2 AS (SELECT bin, n, list_concat(list_concat(list_transform(c, lambda x: x - h), c), list_concat(c, list_transform(c, lambda x: x + h))) AS sm FROM s1),
q AS (SELECT grp, site, ts, base / capacity AS b, (SELECT count(*) FROM ed WHERE e <= base / capacity) AS bin FROM fcst WHERE ts >= TIMESTAMP '1999-01-01'),
m AS (SELECT q.*, l.sm AS ls, coalesce(l.n / (l.n + 500.0), 0) AS al, g.sm AS gs FROM q LEFT JOIN s2 l ON l.bin = q.bin AND l.n >= 250 JOIN s2 g ON g.bin = -1),
a AS (SELECT *, unnest(list_distinct(list_transform({_lit(D.SAMPLE_OFFSETS)}, lambda o: least(greatest(b + o, 0), 1.02)))) AS a FROM m),
k AS (SELECT grp, site, ts, b, a, unnest(ls) AS r, al / 164.0 AS w FROM a UNION ALL SELECT grp, site, ts, b, a, unnest(gs), (1 - al) / 164.0 FROM a),
y AS (SELECT *, least(greatest(b + r, 0.1), 1.2) AS y FROM k),
ut AS (SELECT grp, site, ts, b, a, sum(w * (y * {_PRICE('abs(a - y)')} / (4 * (SELECT m FROM mc)) - abs(a - y))) AS u FROM y GROUP BY ALL),
{_choice_sql('ut', 'grp, site, ts', 'round(abs(a - b), 15), a')}
SELECT grp, site, ts, round(a + 1e-9, 6) AS raw_action, round(least(greatest(b + 0.65 * (a - b), 0), 1.02) + 1e-9, 6) AS decision_cf FROM rk WHERE rn = 1""")
def residual_sample_decision(v) -> DataFrame:
    rows = v.fcst.withColumns({"base_cf": F.col("base") / F.col("capacity"), "residual": (F.col("actual") - F.col("base")) / F.col("capacity")})
    split = F.lit("1999-01-01").cast("timestamp_ntz")
    fit = rows.where((F.col("ts") < split) & (F.col("actual") >= 0.10 * F.col("capacity")))
    out = D.binned_sample_decisions(fit, rows.where(F.col("ts") >= split), _mean_cf(fit))
    return rounded(out, ["grp", "site", "ts"], ["raw_action", "decision_cf"])


_LEAF = "[day(ts) * 3 + site % 3, month(ts) * 2 + site % 2, CAST(floor(base / 5) AS BIGINT)]"


def _leaves(df: DataFrame) -> DataFrame:
    """Leaf numbers of three trees, as a forest model would attach them."""
    return df.withColumn("leaves", F.array((F.day("ts") * 3 + F.col("site") % 3).cast("long"), (F.month("ts") * 2 + F.col("site") % 2).cast("long"), F.floor(F.col("base") / 5)))


@query("forest_weighted_mean", "J11", f"""
WITH f AS (SELECT actual / capacity AS y, unnest([0, 1, 2]) AS tree, unnest({_LEAF}) AS leaf FROM fcst WHERE ts < TIMESTAMP '1999-01-01'),
l AS (SELECT tree, leaf, count(*) AS n, avg(y) AS m FROM f GROUP BY 1, 2),
q AS (SELECT grp, site, ts, unnest([0, 1, 2]) AS tree, unnest({_LEAF}) AS leaf FROM fcst WHERE ts >= TIMESTAMP '1999-01-01')
SELECT grp, site, ts, count(*) AS trees, CAST(sum(n) AS BIGINT) AS members, round(avg(m) + 1e-9, 6) AS forest_y FROM q JOIN l ON l.tree = q.tree AND l.leaf = q.leaf GROUP BY 1, 2, 3""")
def forest_weighted_mean(v) -> DataFrame:
    rows = _leaves(v.fcst).withColumn("y", F.col("actual") / F.col("capacity"))
    split = F.lit("1999-01-01").cast("timestamp_ntz")
    out = D.forest_means(rows.where(F.col("ts") < split), rows.where(F.col("ts") >= split), "leaves", ["grp", "site", "ts"], ["y"])
    return out.select("grp", "site", "ts", "trees", "members", r6("forest_y").alias("forest_y"))


_GLEAF = "[day(ts) * 12 + month(ts), (site % 25) * 100 + month(ts) * 2 + year(ts) % 2, CAST(floor(base / 2) AS BIGINT) * 31 + day(ts)]"


@query("forest_empirical_action", "E19 J11", f"""
WITH mc AS (SELECT avg(actual / capacity) AS m FROM fcst WHERE {_ELIG} AND ts < TIMESTAMP '2000-01-01'),
f AS (SELECT (actual - base) / capacity AS r, unnest([0, 1, 2]) AS tree, unnest({_GLEAF}) AS leaf FROM fcst WHERE ts < TIMESTAMP '2000-01-01'),
n AS (SELECT tree, leaf, count(*) AS n FROM f GROUP BY ALL),
q AS (SELECT grp, site, ts, base / capacity AS b, unnest([0, 1, 2]) AS tree, unnest({_GLEAF}) AS leaf FROM fcst WHERE ts >= TIMESTAMP '2000-01-01'),
k AS (SELECT q.grp, q.site, q.ts, q.b, d, least(greatest(b + d, 0), 1.02) AS a, least(greatest(b + r, 0.1), 1.2) AS y, 1.0 / (3 * n.n) AS w
      FROM q JOIN f ON f.tree = q.tree AND f.leaf = q.leaf JOIN n ON n.tree = q.tree AND n.leaf = q.leaf, (SELECT unnest({_lit(D.ACTION_DELTAS)}) AS d)),
ut AS (SELECT grp, site, ts, d, sum(w * (y * {_PRICE('abs(a - y)')} / (4 * (SELECT m FROM mc)) - abs(a - y))) AS u FROM k GROUP BY ALL),
{_choice_sql('ut', 'grp, site, ts', 'round(abs(d), 15), d')}
SELECT grp, site, ts, round(d + 1e-9, 6) AS delta, round(u + 1e-9, 6) AS utility FROM rk WHERE rn = 1""")
def forest_empirical_action(v) -> DataFrame:
    rows = v.fcst.withColumns({"base_cf": F.col("base") / F.col("capacity"), "residual": (F.col("actual") - F.col("base")) / F.col("capacity"),
                               "leaves": F.array((F.day("ts") * 12 + F.month("ts")).cast("long"), (F.col("site") % 25 * 100 + F.month("ts") * 2 + F.year("ts") % 2).cast("long"), F.floor(F.col("base") / 2) * 31 + F.day("ts"))})
    fit = rows.where(F.col("ts") < F.lit("2000-01-01").cast("timestamp_ntz"))
    ask = rows.where(F.col("ts") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    out = D.forest_action(fit, ask, "leaves", ["grp", "site", "ts"], ["grp", "site", "ts"], "residual", "base_cf", _mean_cf(fit), part_rows=64)
    return rounded(out, ["grp", "site", "ts"], ["delta", "utility"])


_P6 = "greatest(1 - abs(a - cand / capacity) * 9, 0)"
_P8 = "greatest(0.9 - abs(a - third / capacity) * 6, 0)"
_IU = f"""s AS (SELECT grp, site, ts, base, capacity, unnest(range(0, 103)) / 100.0 AS a, cand, third FROM fcst),
p AS (SELECT *, {_P6} AS p6, {_P8} AS p8 FROM s),
u AS (SELECT *, -0.5 * least(greatest(abs(a - cand / capacity), 0), 1.2) + 0.5 * (0.25 * CASE WHEN p6 > p8 THEN 0.5 * (p6 + p8) ELSE p6 END
       + 0.75 * CASE WHEN p6 > p8 THEN 0.5 * (p6 + p8) ELSE p8 END) AS u FROM p)"""


def _interval_surface(cand_cf: np.ndarray, third_cf: np.ndarray) -> np.ndarray:
    """Utility of every action of the grid; without ``third_cf`` its probability is zero, without ``cand_cf`` there is none."""
    near, far = np.abs(np.asarray(ACTION_GRID) - cand_cf[:, None]), np.abs(np.asarray(ACTION_GRID) - third_cf[:, None])
    return interval_utilities(np.fmax(1 - near * 9, 0.0), np.fmax(0.9 - far * 6, 0.0), near)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _interval_lists(cand_cf: pa.Array, third_cf: pa.Array) -> pa.Array:
    u = _interval_surface(*(x.to_numpy(zero_copy_only=False) for x in (cand_cf, third_cf)))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, u.size + 1, u.shape[1]), pa.int32()), pa.array(u.ravel(), from_pandas=True))


def _surface(v) -> DataFrame:
    cap = F.col("capacity")
    return v.fcst.withColumn("utilities", _interval_lists(F.col("cand") / cap, F.col("third") / cap))


@query("interval_probability_action", "E20 F24 J20", f"""
WITH {_IU}, {_choice_sql('u', 'grp, site, ts', 'round(abs(a - base / capacity), 15), a')}
SELECT grp, site, ts, round(a + 1e-9, 6) AS action, round(u + 1e-9, 6) AS utility FROM rk WHERE rn = 1""")
def interval_probability_action(v) -> DataFrame:
    cap = F.col("capacity")
    rows = v.fcst.withColumn("c", D.choose_on_grid(_interval_surface, F.col("base") / cap, inputs=[F.col("cand") / cap, F.col("third") / cap]))
    return rows.select("grp", "site", "ts", r6("c.action").alias("action"), r6("c.utility").alias("utility"))


@query("selective_scale", "E21 F25", f"""
WITH {_IU}, l AS (SELECT grp, site, ts, any_value(base) AS base, any_value(capacity) AS capacity, list(u ORDER BY a) AS us FROM u GROUP BY ALL),
x AS (SELECT *, 100 * least(greatest(base / capacity, 0), 1.02) AS c0, 100 * least(greatest(0.98 * (base / capacity), 0), 1.02) AS c1 FROM l),
y AS (SELECT *, (1 - (c1 - floor(c1))) * us[floor(c1)::INT + 1] + (c1 - floor(c1)) * us[least(floor(c1)::INT + 2, 103)]
              - ((1 - (c0 - floor(c0))) * us[floor(c0)::INT + 1] + (c0 - floor(c0)) * us[least(floor(c0)::INT + 2, 103)]) AS adv FROM x)
SELECT grp, site, ts, round(adv + 1e-9, 6) + 0 AS utility_advantage, adv > 0.01 AS gate,
       round(least(greatest(CASE WHEN adv > 0.01 THEN 0.98 * (base / capacity) ELSE base / capacity END * capacity, 0), 1.02 * capacity) + 1e-9, 6) AS candidate FROM y""")
def selective_scale(v) -> DataFrame:
    rows = _surface(v).withColumns(D.selective_scale("base", "utilities", "capacity"))
    return rows.select("grp", "site", "ts", r6("utility_advantage").alias("utility_advantage"), "gate", r6("candidate").alias("candidate"))


def _affine_sql() -> str:
    lo, hi, n = *K.AFFINE_SCALES, K.AFFINE_GRID
    scales = sorted({*K.line(*K.AFFINE_SCALES, n), 1.0})
    biases = sorted({*K.line(*K.AFFINE_BIAS, n), 0.0})

    def scored(k: int) -> str:
        return f"""t{k} AS (SELECT c.grp, c.scale, c.bias, c.ord, 1 - avg(e) AS om, sum(actual * {_PRICE('e')}) / (4 * sum(actual)) AS f FROM
 (SELECT c.*, actual, abs(round(c.scale * base + c.bias * capacity, 9) - actual) / capacity AS e FROM el JOIN c{k} c ON c.grp = el.grp) c GROUP BY 1, 2, 3, 4),
b{k} AS (SELECT grp, scale, bias, om, f FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(0.5 * om + 0.5 * f, 12) DESC, round(om, 12) DESC,
       round(abs(scale - 1) + abs(bias), 12), ord) AS rn FROM t{k}) WHERE rn = 1)"""

    parts = [f"el AS (SELECT * FROM fcst WHERE {_ELIG})",
             f"c0 AS (SELECT g.grp, s.scale, b.bias, s.i * 1000 + b.j AS ord FROM (SELECT unnest(['g1', 'g2', 'g3']) AS grp) g, (SELECT unnest({_lit(scales)}) AS scale, unnest(range(0, {len(scales)})) AS i) s,"
             f" (SELECT unnest({_lit(biases)}) AS bias, unnest(range(0, {len(biases)})) AS j) b)", scored(0)]
    ds, db = (scales[-1] - scales[0]) / (len(scales) - 1), (biases[-1] - biases[0]) / (len(biases) - 1)
    parts.append(f"w1 AS (SELECT grp, scale, bias, greatest(CAST('{lo!r}' AS DOUBLE), scale - CAST('{ds!r}' AS DOUBLE)) AS s0, least(CAST('{hi!r}' AS DOUBLE), scale + CAST('{ds!r}' AS DOUBLE)) AS s1,"
                 f" greatest(CAST('-0.1' AS DOUBLE), bias - CAST('{db!r}' AS DOUBLE)) AS b0, least(CAST('0.1' AS DOUBLE), bias + CAST('{db!r}' AS DOUBLE)) AS b1 FROM b0)")
    for k in (1, 2):
        parts.append(f"c{k} AS (SELECT grp, s0 + (s1 - s0) * i / 10 AS scale, b0 + (b1 - b0) * j / 10 AS bias, i * 1000 + j AS ord FROM w{k}, range(11) a(i), range(11) b(j)"
                     f" UNION ALL SELECT grp, scale, bias, -1 FROM w{k})")
        parts.append(scored(k))
        if k == 1:
            parts.append("w2 AS (SELECT b1.grp, b1.scale, b1.bias, greatest(CAST('0.85' AS DOUBLE), b1.scale - (w1.s1 - w1.s0) / 10) AS s0, least(CAST('1.25' AS DOUBLE), b1.scale + (w1.s1 - w1.s0) / 10) AS s1,"
                         " greatest(CAST('-0.1' AS DOUBLE), b1.bias - (w1.b1 - w1.b0) / 10) AS b0, least(CAST('0.1' AS DOUBLE), b1.bias + (w1.b1 - w1.b0) / 10) AS b1 FROM b1 JOIN w1 ON w1.grp = b1.grp)")
    return "WITH " + ",\n".join(parts) + """
SELECT grp, round(scale + 1e-9, 6) AS scale, round(bias + 1e-9, 6) + 0 AS bias_fraction, round(0.5 * om + 0.5 * f + 1e-9, 6) AS score,
       round(om + 1e-9, 6) AS one_minus_nmae, round(f + 1e-9, 6) AS ficr FROM b2"""


@query("affine_calibration", "E25 E02 T03", _affine_sql())
def affine_calibration(v) -> DataFrame:
    return rounded(K.fit_affine(v.fcst, "base", ["g1", "g2", "g3"]), ["grp"], ["scale", "bias_fraction", "score", "one_minus_nmae", "ficr"])


_BC = K.bounded_candidates()


@query("bounded_calibration", "E25 E03 T03", f"""
WITH c AS (SELECT unnest(range(0, {len(_BC)})) AS ord, unnest({_lit([c.scale for c in _BC])}) AS s, unnest({_lit([c.bias_fraction for c in _BC])}) AS b, unnest({_lit([c.lower for c in _BC])}) AS lo,
  unnest({_lit([c.upper for c in _BC])}) AS hi, unnest({_lit([c.distance for c in _BC])}) AS dist),
t AS (SELECT grp, ord, s, b, lo, hi, dist, 1 - avg(e) AS om, sum(actual * {_PRICE('e')}) / (4 * sum(actual)) AS f FROM
  (SELECT c.*, grp, actual, abs(round(least(greatest(s * base + b * capacity, lo * capacity), hi * capacity), 9) - actual) / capacity AS e FROM fcst, c WHERE {_ELIG}) GROUP BY ALL)
SELECT grp, round(s + 1e-9, 6) AS scale, round(b + 1e-9, 6) + 0 AS bias_fraction, round(hi + 1e-9, 6) AS upper, round(0.5 * om + 0.5 * f + 1e-9, 6) AS score FROM
 (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(0.5 * om + 0.5 * f, 12) DESC, round(om, 12) DESC, round(dist, 12), ord) AS rn FROM t) WHERE rn = 1""")
def bounded_calibration(v) -> DataFrame:
    return rounded(K.fit_bounded(v.fcst, "base"), ["grp"], ["scale", "bias_fraction", "upper", "score"])


_DRAWS = 200
_SP = K.simplex_start(3, K.simplex_draws(3, _DRAWS))
_EXPO = "-ln((CAST('0x' || substr(md5('42-' || i || '-{}'), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"


@query("simplex_candidate_scores", "E26", f"""
WITH e AS (SELECT i, {', '.join(f'{_EXPO.format(m)} AS e{m}' for m in range(3))} FROM range(0, {_DRAWS}) t(i)),
w AS (SELECT i, round(e0 / (e0 + e1 + e2), 9) AS a, round(e1 / (e0 + e1 + e2), 9) AS b FROM e),
c AS (SELECT unnest([0, 1, 2, 3]) AS candidate, unnest({_lit([c.weights[0] for c in _SP[:4]])}) AS a, unnest({_lit([c.weights[1] for c in _SP[:4]])}) AS b, unnest({_lit([c.weights[2] for c in _SP[:4]])}) AS d
      UNION ALL SELECT 4 + i, a, b, round(1.0 - (a + b), 9) FROM w)
SELECT grp, candidate, round(0.5 * (1 - avg(e)) + 0.5 * sum(actual * {_PRICE('e')}) / (4 * sum(actual)) + 1e-9, 6) AS score FROM
  (SELECT c.candidate, grp, actual, abs(round(a * base + b * cand + d * third, 9) - actual) / capacity AS e FROM fcst, c WHERE {_ELIG}) GROUP BY 1, 2""")
def simplex_candidate_scores(v) -> DataFrame:
    out = K.candidate_scores(K.candidate_totals(v.fcst, ["grp"], ["base", "cand", "third"], _SP))
    return out.select("grp", F.col("candidate").cast("long").alias("candidate"), r6("score").alias("score"))


@query("simplex_weight_search", "E26 T03")
def simplex_weight_search(v) -> DataFrame:
    return K.fit_simplex(v.fcst, ["base", "cand", "third"], ["g1", "g2", "g3"], extra=K.simplex_draws(3, 64))


_PROBE = [round(0.80 + 0.01 * i, 12) for i in range(41)]


@query("scale_probe", "T10 E10", f"""
WITH c AS (SELECT unnest({_lit(_PROBE)}) AS scale),
g AS (SELECT scale, grp, 1 - avg(e) AS om, sum(actual * {_PRICE('e')}) / (4 * sum(actual)) AS f FROM (SELECT scale, grp, actual, abs(round(base * scale, 9) - actual) / capacity AS e FROM fcst, c WHERE {_ELIG}) GROUP BY 1, 2),
m AS (SELECT scale, avg(om) AS om, avg(f) AS f, sqrt(pow(avg(om) - 0.86, 2) + pow(avg(f) - 0.36, 2)) AS l2 FROM g GROUP BY 1)
SELECT 'joint' AS match, round(arg_min(scale, round(l2, 12)) + 1e-9, 6) AS scale FROM m
UNION ALL SELECT 'one_minus_nmae', round(arg_min(scale, round(abs(om - 0.86), 12)) + 1e-9, 6) FROM m
UNION ALL SELECT 'ficr', round(arg_min(scale, round(abs(f - 0.36), 12)) + 1e-9, 6) FROM m""")
def scale_probe(v) -> DataFrame:
    probe = K.scale_probe(v.fcst, "base", _PROBE, (0.86, 0.36))
    return K.nearest_scales(probe).select("match", r6("scale").alias("scale"))


_FAM = K.perturbation_family([0.5, 0.3, 0.2], 1.02, -0.01, 0.0, 1.02, (0.0, 0.04, 0.08), (-0.015, 0.0, 0.015), (-0.0075, 0.0, 0.0075))


@query("perturbation_maximin", "E27 T11", f"""
WITH c AS (SELECT unnest(range(0, {len(_FAM)})) AS k, unnest({_lit([c.weights[0] for c, _ in _FAM])}) AS wa, unnest({_lit([c.weights[1] for c, _ in _FAM])}) AS wb, unnest({_lit([c.weights[2] for c, _ in _FAM])}) AS wc,
  unnest({_lit([c.scale for c, _ in _FAM])}) AS s, unnest({_lit([c.bias_fraction for c, _ in _FAM])}) AS b, unnest({_lit([p for _, p in _FAM])}) AS pen),
e AS (SELECT c.k, pen, grp, actual, quarter(ts - INTERVAL 1 HOUR) AS q, abs(round(least(greatest((wa * base + wb * cand + wc * third) * s + b * capacity, 0), 1.02 * capacity), 9) - actual) / capacity AS e FROM fcst, c WHERE {_ELIG}),
t AS (SELECT k, pen, grp, q, count(*) AS n, sum(actual) AS en, sum(e) AS er, sum(actual * {_PRICE('e')}) AS ea FROM e GROUP BY ALL),
sl AS (SELECT *, unnest(['full', CASE WHEN q <= 2 THEN 'H1' ELSE 'H2' END, 'Q' || q]) AS slice FROM t),
sc AS (SELECT k, pen, grp, slice, 0.5 * (1 - sum(er) / sum(n)) + 0.5 * sum(ea) / (4 * sum(en)) AS s FROM sl GROUP BY ALL),
d AS (SELECT a.k, a.pen, a.grp, a.s - z.s AS d FROM sc a JOIN sc z ON z.k = 0 AND z.grp = a.grp AND z.slice = a.slice)
SELECT grp, k AS candidate, round(min(d) + 1e-9, 6) + 0 AS minimum_delta, round(avg(d) + 1e-9, 6) + 0 AS mean_delta, round(min(d) + 0.25 * avg(d) - any_value(pen) + 1e-9, 6) + 0 AS objective FROM d GROUP BY 1, 2""")
def perturbation_maximin(v) -> DataFrame:
    rows = v.fcst.withColumn("quarter", L.quarter_number("ts"))
    out = K.maximin_scores(rows, ["base", "cand", "third"], _FAM, "quarter")
    return out.select("grp", F.col("candidate").cast("long").alias("candidate"), *[r6(c).alias(c) for c in ("minimum_delta", "mean_delta", "objective")])


# candidates as mixes of the two models, compared with the baseline over the slices of each year
_MIX = {"w05": 0.05, "w10": 0.10, "w20": 0.20}
_GATE_CTE = f"""mixes AS (SELECT grp, ts, actual, capacity, base, unnest(['w05', 'w10', 'w20']) AS candidate, base + unnest([0.05, 0.1, 0.2]) * (cand - base) AS c FROM fcst WHERE {_ELIG}),
me AS (SELECT *, abs(base - actual) / capacity AS eb, abs(c - actual) / capacity AS ec, date_trunc('day', ts - INTERVAL 1 HOUR) AS day FROM mixes),
mp AS (SELECT *, {_PRICE('eb')} AS pb, {_PRICE('ec')} AS pc, unnest(['full', CASE WHEN month(day) <= 6 THEN 'H1' ELSE 'H2' END, 'Q' || quarter(day)]) AS slice FROM me),
gq AS (SELECT candidate, grp, slice, {_TRIPLE} FROM mp GROUP BY 1, 2, 3),
gd AS (SELECT candidate, grp, slice, 0.5 * (co - bo) + 0.5 * (cf - bf) AS ds, co - bo AS dom, cf - bf AS df FROM gq
       UNION ALL SELECT candidate, 'mixed', slice, avg(0.5 * (co - bo) + 0.5 * (cf - bf)), avg(co - bo), avg(cf - bf) FROM gq GROUP BY 1, 3)"""


def _comparisons(v) -> DataFrame:
    out = None
    for name, w in _MIX.items():
        rows = v.fcst.withColumn("mix", F.col("base") + w * (F.col("cand") - F.col("base")))
        scores = L.compare_year_slices(rows, "base", "mix", by_year=False)
        mixed = L.deltas(L.macro_of_groups(scores, ["slice"]))
        cols = ["grp", "slice", "delta_score", "delta_one_minus_nmae", "delta_ficr"]
        both = scores.select(*cols).unionByName(mixed.withColumn("grp", F.lit("mixed")).select(*cols)).withColumn("candidate", F.lit(name))
        out = both if out is None else out.unionByName(both)
    return out


@query("all_positive_selection", "T04", f"""
WITH {_GATE_CTE},
s AS (SELECT grp, candidate, min(ds) AS mn, avg(ds) AS av, bool_and(ds > 0) AS ok FROM gd GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(mn, 12) DESC, round(av, 12) DESC, candidate) AS rn FROM s WHERE ok)
SELECT s.grp, s.candidate, round(s.mn + 1e-9, 6) AS minimum_delta, round(s.av + 1e-9, 6) AS mean_delta, s.ok AS passed, coalesce(p.rn = 1, false) AS winner
FROM s LEFT JOIN p ON p.grp = s.grp AND p.candidate = s.candidate""")
def all_positive_selection(v) -> DataFrame:
    s = G.summary(_comparisons(v), ["grp", "candidate"], required=["full", "H1", "H2", "Q1", "Q2", "Q3", "Q4"])
    order = F.when(F.col("candidate") == "w05", 3).when(F.col("candidate") == "w10", 2).otherwise(1)
    won = G.choose(s, ["grp"], [order]).select("grp", "candidate", F.lit(True).alias("winner"))
    out = s.join(won, ["grp", "candidate"], "left")
    return out.select("grp", "candidate", r6("minimum_delta").alias("minimum_delta"), r6("mean_delta").alias("mean_delta"), "passed",
                      F.coalesce("winner", F.lit(False)).alias("winner"))


@query("full_period_gate", "T05", f"""
WITH {_GATE_CTE}
SELECT grp, candidate, bool_and(ds > 0) AS all_scores_rise, bool_or(slice = 'full' AND dom >= 0 AND df >= 0 AND (dom > 0 OR df > 0)) AS full_components_hold,
       bool_and(ds > 0) AND bool_or(slice = 'full' AND dom >= 0 AND df >= 0 AND (dom > 0 OR df > 0)) AS promoted FROM gd GROUP BY 1, 2""")
def full_period_gate(v) -> DataFrame:
    return G.full_period_gate(_comparisons(v), ["grp", "candidate"])


_RULES = [("*", "H2", "score", 0.0), ("*", "H2", "ficr", 0.0), ("*", "H2", "one_minus_nmae", -0.0015), ("*", "Q3", "score", -0.0005), ("*", "Q4", "score", -0.0005),
          ("mixed", "H2", "score", 0.001), ("mixed", "H2", "ficr", 0.002), ("mixed", "H2", "one_minus_nmae", -0.001), ("mixed", "Q3", "score", 0.0), ("mixed", "Q4", "score", 0.0)]


def _rules_sql() -> str:
    short = {"score": "ds", "ficr": "df", "one_minus_nmae": "dom"}
    tests = [f"coalesce(min({short[m]}) FILTER (slice = '{s}' AND {'grp <> ' + chr(39) + 'mixed' + chr(39) if g == '*' else f'grp = {chr(39)}{g}{chr(39)}'}) >= {f}, false)" for g, s, m, f in _RULES]
    fails = ", ".join(f"CASE WHEN NOT {t} THEN '{g}/{s} {m}' END" for t, (g, s, m, _) in zip(tests, _RULES))
    return f"""WITH {_GATE_CTE} SELECT candidate, {' AND '.join(tests)} AS eligible, concat_ws(';', {fails}) AS failures,
 round(min(df) FILTER (grp <> 'mixed' AND slice IN ('Q3', 'Q4')) + 1e-9, 6) AS worst_ficr, round(avg(df) FILTER (grp <> 'mixed' AND slice IN ('Q3', 'Q4')) + 1e-9, 6) AS mean_ficr,
 round(min(ds) FILTER (grp <> 'mixed' AND slice IN ('Q3', 'Q4')) + 1e-9, 6) AS worst_score, round(max(ds) FILTER (grp = 'mixed' AND slice = 'H2') + 1e-9, 6) AS mixed_h2_score FROM gd GROUP BY 1"""


@query("numeric_floor_gate", "T06", _rules_sql())
def numeric_floor_gate(v) -> DataFrame:
    table = _comparisons(v)
    out = G.floor_gate(table, _RULES, ["candidate"]).join(G.lexicographic_objective(table, ["candidate"]), "candidate")
    return out.select("candidate", "eligible", "failures", *[r6(c).alias(c) for c in ("worst_ficr", "mean_ficr", "worst_score", "mixed_h2_score")])


@query("dual_baseline_gate", "T06 A06", f"""
WITH {_PAIRED_SQL.replace('base - actual', 'bb - actual').replace('FROM fcst', "FROM (SELECT *, unnest(['base', 'third']) AS baseline_name, unnest([base, third]) AS bb FROM fcst)")},
s AS (SELECT *, unnest(['full', CASE WHEN month(day) <= 6 THEN 'H1' ELSE 'H2' END, 'Q' || quarter(day)]) AS slice FROM pr),
g AS (SELECT baseline_name, grp, slice, {_TRIPLE} FROM s GROUP BY 1, 2, 3),
d AS (SELECT baseline_name, grp, slice, 0.5 * (co - bo) + 0.5 * (cf - bf) AS ds, co - bo AS dom, cf - bf AS df FROM g
      UNION ALL SELECT baseline_name, 'mixed', slice, avg(0.5 * (co - bo) + 0.5 * (cf - bf)), avg(co - bo), avg(cf - bf) FROM g GROUP BY 1, 3),
r AS (SELECT baseline_name, min(ds) FILTER (grp <> 'mixed') AS mg, min(ds) FILTER (grp = 'mixed') AS mm, max(dom) FILTER (grp = 'mixed' AND slice = 'H2') AS ho, max(df) FILTER (grp = 'mixed' AND slice = 'H2') AS hf,
        count(*) FILTER (grp <> 'mixed') = 21 AND count(*) FILTER (grp = 'mixed') = 7 AS whole FROM d GROUP BY 1)
SELECT baseline_name, round(mg + 1e-9, 6) AS minimum_group_delta, round(mm + 1e-9, 6) AS minimum_mixed_delta, round(ho + 1e-9, 6) AS h2_one_minus_nmae, round(hf + 1e-9, 6) AS h2_ficr,
       whole AND mg > 0 AND mm > 0 AND ho >= 0 AND hf >= 0 AS passed, bool_and(whole AND mg > 0 AND mm > 0 AND ho >= 0 AND hf >= 0) OVER () AS dual_pass FROM r""")
def dual_baseline_gate(v) -> DataFrame:
    table = None
    for name in ("base", "third"):
        scores = L.compare_year_slices(v.fcst, name, "cand", by_year=False)
        mixed = L.deltas(L.macro_of_groups(scores, ["slice"])).withColumn("grp", F.lit("mixed"))
        cols = ["grp", "slice", "delta_score", "delta_one_minus_nmae", "delta_ficr"]
        both = scores.select(*cols).unionByName(mixed.select(*cols)).withColumns({"baseline_name": F.lit(name), "family": F.lit("time")})
        table = both if table is None else table.unionByName(both)
    out = G.dual_gate(table, cells_group=21, cells_mixed=7)
    return out.select("baseline_name", *[r6(c).alias(c) for c in ("minimum_group_delta", "minimum_mixed_delta", "h2_one_minus_nmae", "h2_ficr")], "passed", "dual_pass")


@query("template_fill", "E28 S05", """
WITH t AS (SELECT DISTINCT ts, 'f' || strftime(ts, '%Y%m%d') AS forecast_id FROM gday WHERE ts >= TIMESTAMP '2000-01-01')
SELECT t.forecast_id, t.ts, round(max(base) FILTER (grp = 'g1') + 1e-9, 6) AS g1, round(max(base) FILTER (grp = 'g2') + 1e-9, 6) AS g2, round(max(base) FILTER (grp = 'g3') + 1e-9, 6) AS g3
FROM t JOIN gday ON gday.ts = t.ts GROUP BY 1, 2 HAVING count(DISTINCT grp) = 3""")
def template_fill(v) -> DataFrame:
    rows = v.gday.where(F.col("ts") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    whole = rows.groupBy("ts").agg(F.countDistinct("grp").alias("n")).where(F.col("n") == 3).select("ts")
    template = whole.withColumn("forecast_id", F.concat(F.lit("f"), F.date_format("ts", "yyyyMMdd")))
    out = E.fill_template(template, rows.withColumnRenamed("base", "kwh"), ["g1", "g2", "g3"])
    return out.select("forecast_id", "ts", *[r6(g).alias(g) for g in ("g1", "g2", "g3")])


@query("sample_weights_and_classes", "P18 P17 F34 P01", f"""
WITH x AS (SELECT grp, site, ts, actual / capacity AS cf, (actual - base) / capacity AS r, 0.5 + 2.0 * least(greatest(actual / capacity, 0), 1.5) AS w FROM fcst WHERE {_ELIG}),
c AS (SELECT *, least((SELECT count(*) FROM (SELECT unnest({_lit(D.CLASS_EDGES)}) AS e) WHERE e <= cf), 41) AS k FROM x),
d AS (SELECT *, least(greatest(ceil((r + 0.525) / 0.025 - 0.5 - 1e-12), 0), 42) AS m FROM c)
SELECT grp, site, ts, round(w + 1e-9, 6) AS weight, CAST(k AS BIGINT) AS target_class, CAST(m AS BIGINT) AS residual_class FROM d""")
def sample_weights_and_classes(v) -> DataFrame:
    rows = v.fcst.where(F.col("actual") >= 0.10 * F.col("capacity"))
    cap = F.col("capacity")
    return rows.select("grp", "site", "ts", r6(E.sample_weight("actual", "capacity", 0.5, 2.0)).alias("weight"), D.target_class(F.col("actual") / cap).cast("long").alias("target_class"),
                       D.residual_class((F.col("actual") - F.col("base")) / cap).cast("long").alias("residual_class"))


_META = {"base_cf": "base / capacity", "cand_cf": "cand / capacity", "third_cf": "third / capacity", "component_mean_cf": "(cand / capacity + third / capacity) / 2.0",
         "component_std_cf": "abs(cand / capacity - third / capacity) / 2.0", "component_min_cf": "least(cand / capacity, third / capacity)",
         "component_max_cf": "greatest(cand / capacity, third / capacity)", "component_range_cf": "abs(cand / capacity - third / capacity)",
         "cand_minus_third_cf": "cand / capacity - third / capacity", "lead_fraction": "((hour(ts) + 23) % 24) / 23.0",
         "lead_sin": f"sin(2 * {PI} * ((hour(ts) + 23) % 24) / 24.0)", "lead_cos": f"cos(2 * {PI} * ((hour(ts) + 23) % 24) / 24.0)",
         "day_of_year_sin": f"sin(2 * {PI} * (dayofyear(ts) - 1) / 365.2425)", "day_of_year_cos": f"cos(2 * {PI} * (dayofyear(ts) - 1) / 365.2425)"}


@query("meta_features", "F35 F36", f"""
WITH x AS (SELECT grp, site, ts, {', '.join(f'{e} AS {n}' for n, e in _META.items())} FROM fcst) {row_values_sql('x', ['grp', 'site', 'ts'], _META)}""")
def meta_features(v) -> DataFrame:
    features = A.meta_features("base", ["cand", "third"], [("cand", "third")], "ts", "capacity")
    return row_values(v.fcst.select("grp", "site", "ts", *[c.alias(n) for n, c in features.items()]), ["grp", "site", "ts"], list(_META))


_DAILY = ["baseline_daily_mean_cf", *[f"{p}_{s}" for p in ("a_ws", "b_ws", "a_minus_b") for s in ("mean", "std", "q25", "q50", "q75")], "doy_sin1", "doy_cos1", "doy_sin2", "doy_cos2"]


def _daily_sql() -> str:
    ser = {"a_ws": "u", "b_ws": "gust", "a_minus_b": "u - gust"}
    parts = [f"avg({e}) AS {p}_mean, stddev_pop({e}) AS {p}_std, quantile_cont({e}, 0.25) AS {p}_q25, quantile_cont({e}, 0.5) AS {p}_q50, quantile_cont({e}, 0.75) AS {p}_q75" for p, e in ser.items()]
    ang = f"(2 * {PI} * (dayofyear(run_key) - 1) / 365.2425)"
    return f"""d AS (SELECT grid_id, run_key, avg(gust) / 30 AS baseline_daily_mean_cf, {', '.join(parts)}, sin({ang}) AS doy_sin1, cos({ang}) AS doy_cos1, sin(2 * {ang}) AS doy_sin2, cos(2 * {ang}) AS doy_cos2
     FROM wx WHERE u IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 24)"""


@query("daily_run_features", "A23 F06", f"WITH {_daily_sql()} SELECT grid_id, run_key, {', '.join(f'round({c} + 1e-9, 6) + 0 AS {c}' for c in _DAILY)} FROM d")
def daily_run_features(v) -> DataFrame:
    rows = v.wx.where(F.col("u").isNotNull())
    out = A.daily_features(rows, ["grid_id", "run_key"], F.col("gust") / 30, {"a_ws": F.col("u"), "b_ws": F.col("gust"), "a_minus_b": F.col("u") - F.col("gust")}, "run_key")
    return out.select("grid_id", "run_key", *[r6(c).alias(c) for c in _DAILY])


@query("daily_energy_ratio", "A24 E24 J14", """
WITH r AS (SELECT grid_id, run_key, sum(u) / sum(gust) AS ratio FROM wx WHERE u IS NOT NULL GROUP BY 1, 2 HAVING count(u) = 24 AND sum(gust) > 0)
SELECT w.grid_id, w.forecast_ts, round(ratio + 1e-9, 6) AS ratio, round(gust * (1 + 0.25 * (least(greatest(ratio, 0.9), 1.05) - 1)) + 1e-9, 6) AS adjusted
FROM wx w JOIN r ON r.grid_id = w.grid_id AND r.run_key = w.run_key""")
def daily_energy_ratio(v) -> DataFrame:
    rows = v.wx.where(F.col("u").isNotNull())
    ratio = A.daily_ratio(rows, ["grid_id", "run_key"], "u", "gust")
    out = rows.join(ratio, ["grid_id", "run_key"]).withColumn("adjusted", F.col("gust") * E.daily_factor("ratio"))
    return rounded(out, ["grid_id", "forecast_ts"], ["ratio", "adjusted"])


@query("common_capacity_factor", "A42", """
SELECT ts, count(*) AS groups, CASE WHEN count(*) >= 2 THEN round(avg(actual / capacity) + 1e-9, 6) END AS common_mean,
       CASE WHEN count(*) >= 2 THEN round(quantile_cont(actual / capacity, 0.5) + 1e-9, 6) END AS common_median FROM gday GROUP BY 1""")
def common_capacity_factor(v) -> DataFrame:
    out = A.common_target(v.gday.withColumn("cf", F.col("actual") / F.col("capacity")), "ts", "cf")
    return out.select("ts", "groups", r6("common_mean").alias("common_mean"), r6("common_median").alias("common_median"))
