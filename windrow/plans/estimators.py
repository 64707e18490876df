"""Model operators under estimators with a closed form, and the joins, stacks and name rules around the models, so that
SQL can state every row of their results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.functions.exprs import r6
from windrow.operators import checks as C
from windrow.operators import models as M
from windrow.plans.learning import GROUPS, SPLIT
from windrow.plans.registry import query
from windrow.session import checkpoint
from windrow.sources import manifests as MF

ALPHA = 2.0
KEYS = ["grp", "site", "ts"]

#: rows of the design, their training part, and the part forecasts are asked for
DESIGN_SQL = f"""d AS (SELECT grp, site, ts, capacity, base / capacity AS x, actual / capacity AS y, day(ts) % 24 + 12 AS lead FROM fcst),
fit AS (SELECT * FROM d WHERE ts < TIMESTAMP '{SPLIT}' AND y >= 0.10), ask AS (SELECT * FROM d WHERE ts >= TIMESTAMP '{SPLIT}')"""


def _line_sql(alpha: float) -> str:
    """Aggregates of a ridge line: mean of x, mean of y, slope."""
    return f"avg(x) AS mx, avg(y) AS my, covar_pop(y, x) * count(*) / (var_pop(x) * count(*) + {alpha}) AS b"


def _at(line: str, x: str = "x") -> str:
    return f"least(greatest({line}.my + {line}.b * ({x} - {line}.mx), 0), 1.02)"


def _design(v) -> tuple[DataFrame, DataFrame]:
    rows = checkpoint(v.fcst.select(*KEYS, "capacity", (F.col("base") / F.col("capacity")).alias("x"), (F.col("actual") / F.col("capacity")).alias("y"),
                                    (F.dayofmonth("ts") % 24 + 12).alias("lead")))
    at = F.lit(SPLIT).cast("timestamp_ntz")
    return rows.where((F.col("ts") < at) & (F.col("y") >= 0.10)), rows.where(F.col("ts") >= at)


def _line(alpha: float = ALPHA):
    return lambda train: M.ridge(train, ["x"], "y", alpha)


@query("ridge_line", "M06", f"WITH {DESIGN_SQL}, l AS (SELECT {_line_sql(ALPHA)} FROM fit) SELECT grp, site, ts, round({_at('l')} + 1e-9, 6) + 0 AS cf FROM ask, l")
def ridge_line(v) -> DataFrame:
    train, apply = _design(v)
    return M.predict(_line()(train), apply, ["x"], "cf", (0.0, M.UPPER_CF)).select(*KEYS, r6("cf").alias("cf"))


@query("group_lines", "M01", f"""
WITH {DESIGN_SQL}, l AS (SELECT grp, {_line_sql(ALPHA)} FROM fit GROUP BY 1)
SELECT grp, site, ts, round({_at('l')} * capacity + 1e-9, 6) + 0 AS kwh FROM ask JOIN l USING (grp)""")
def group_lines(v) -> DataFrame:
    train, apply = _design(v)
    out = M.per_group(train, apply, GROUPS, _line(), ["x"], "cf")
    return out.select(*KEYS, r6(F.col("cf") * F.col("capacity")).alias("kwh"))


@query("lead_lines", "M11", f"""
WITH {DESIGN_SQL}, g AS (SELECT {_line_sql(ALPHA)} FROM fit), e AS (SELECT floor(lead / 6) AS bin, {_line_sql(ALPHA)} FROM fit GROUP BY 1)
SELECT grp, site, ts, round({_at('g')} + 1e-9, 6) + 0 AS global_cf, round({_at('e')} + 1e-9, 6) + 0 AS expert_cf FROM ask JOIN e ON e.bin = floor(lead / 6), g""")
def lead_lines(v) -> DataFrame:
    train, apply = _design(v)
    bins = [(f"lead_{lo}", lo, lo + 6) for lo in (12, 18, 24, 30)]
    out = M.lead_experts(train, apply, ["x"], "y", bins, "lead", _line())
    return out.select(*KEYS, r6("global_cf").alias("global_cf"), r6("expert_cf").alias("expert_cf"))


@query("forward_fold_lines", "M24", f"""
WITH {DESIGN_SQL}, f AS (SELECT unnest([1997, 1998]) AS yr), l AS (SELECT f.yr, {_line_sql(ALPHA)} FROM f JOIN d ON year(d.ts) < f.yr GROUP BY 1)
SELECT grp, site, ts, round({_at('l')} + 1e-9, 6) + 0 AS oof FROM d JOIN l ON l.yr = year(d.ts)""")
def forward_fold_lines(v) -> DataFrame:
    rows = v.fcst.select(*KEYS, (F.col("base") / F.col("capacity")).alias("x"), (F.col("actual") / F.col("capacity")).alias("y"))
    folds = [(F.year("ts") < y, F.year("ts") == y) for y in (1997, 1998)]
    out = M.fold_predictions(checkpoint(rows), folds, _line(), ["x"], "oof", (0.0, M.UPPER_CF))
    return out.select(*KEYS, r6("oof").alias("oof"))


@query("bagged_lines", "M25", f"""
WITH {DESIGN_SQL}, a AS (SELECT {_line_sql(2)} FROM fit), b AS (SELECT {_line_sql(20)} FROM fit), c AS (SELECT {_line_sql(200)} FROM fit)
SELECT grp, site, ts, round(({_at('a')} + {_at('b')} + {_at('c')}) / 3 + 1e-9, 6) + 0 AS bag_cf FROM ask, a, b, c""")
def bagged_lines(v) -> DataFrame:
    train, apply = _design(v)
    out = M.seed_bag(apply, [2, 20, 200], lambda alpha: _line(float(alpha))(train), ["x"], "bag_cf")
    return out.select(*KEYS, r6("bag_cf").alias("bag_cf"))


@query("leaf_quantiles", "M03", f"""
WITH {DESIGN_SQL}, t AS (SELECT unnest(['m', 'l']) AS tree), k AS (SELECT *, CASE tree WHEN 'm' THEN month(ts) ELSE lead END AS leaf FROM fit, t),
q AS (SELECT tree, leaf, quantile_cont(y, 0.1) AS a, quantile_cont(y, 0.5) AS b, quantile_cont(y, 0.9) AS c FROM k GROUP BY 1, 2)
SELECT grp, site, ts, round(avg(a) + 1e-9, 6) AS q0, round(avg(b) + 1e-9, 6) AS q1, round(avg(c) + 1e-9, 6) AS q2
FROM (SELECT *, CASE tree WHEN 'm' THEN month(ts) ELSE lead END AS leaf FROM ask, t) JOIN q USING (tree, leaf) GROUP BY 1, 2, 3""")
def leaf_quantiles(v) -> DataFrame:
    fit, ask = (df.withColumn("leaves", F.array(F.month("ts").cast("bigint"), F.col("lead").cast("bigint"))) for df in _design(v))
    out = M.leaf_quantile_surface(fit, ask, "leaves", KEYS, "y", [0.1, 0.5, 0.9])
    return out.select(*KEYS, *[r6(F.element_at("quantiles", i + 1)).alias(f"q{i}") for i in range(3)])


@query("tempered_weights", "M05", f"""
WITH {DESIGN_SQL}, p AS (SELECT *, least(greatest(x / (x + y), 0.05), 0.95) AS p FROM d), r AS (SELECT *, sqrt(least(greatest(p / (1 - p), 0.25), 4.0)) AS raw FROM p),
m AS (SELECT avg(raw) AS mean FROM r WHERE y >= 0.10)
SELECT grp, site, ts, round(raw / mean + 1e-9, 6) AS density_weight FROM r, m""")
def tempered_weights(v) -> DataFrame:
    x, y = F.col("base") / F.col("capacity"), F.col("actual") / F.col("capacity")
    rows = v.fcst.withColumns({"p": x / (x + y), "y": y})
    return M.tempered_odds(rows, "p", F.col("y") >= 0.10, "density_weight").select(*KEYS, r6("density_weight").alias("density_weight"))


@query("shared_design_stack", "U02 M02", """
SELECT grp, site, ts, CASE grp WHEN 'g1' THEN 0.0e0 WHEN 'g2' THEN 1.0e0 ELSE 2.0e0 END AS group_id, round(actual / capacity + 1e-9, 6) + 0 AS target_cf FROM fcst""")
def shared_design_stack(v) -> DataFrame:
    out = M.shared_design(v.fcst.withColumn("target_cf", F.col("actual") / F.col("capacity")), GROUPS)
    return out.select(*KEYS, "group_id", r6("target_cf").alias("target_cf"))


@query("pseudo_label_stack", "U03 M13", """
WITH w AS (SELECT ts, max(actual / capacity) FILTER (grp = 'g1') AS g1, max(actual / capacity) FILTER (grp = 'g2') AS g2, max(actual / capacity) FILTER (grp = 'g3') AS g3 FROM fcst GROUP BY 1),
s AS (SELECT ts, 'actual' AS origin, g3 FROM w WHERE ts >= TIMESTAMP '1997-01-01' AND g3 IS NOT NULL
      UNION ALL SELECT ts, 'pseudo', least(greatest((g1 + g2) * 0.75 - 0.2, 0), 1.02) FROM w WHERE ts < TIMESTAMP '1997-01-01' AND g1 IS NOT NULL AND g2 IS NOT NULL)
SELECT ts, origin, round(g3 + 1e-9, 6) AS g3 FROM s WHERE g3 >= 0.10""")
def pseudo_label_stack(v) -> DataFrame:
    wide = v.fcst.groupBy("ts").agg(*[F.max(F.when(F.col("grp") == g, F.col("actual") / F.col("capacity"))).alias(g) for g in GROUPS])
    at = F.lit("1997-01-01").cast("timestamp_ntz")
    pseudo = wide.where((F.col("ts") < at) & F.col("g1").isNotNull() & F.col("g2").isNotNull()).withColumn("g3", (F.col("g1") + F.col("g2")) * 0.75 - 0.2)
    return M.stack_labels(wide.where(F.col("ts") >= at), pseudo, "g3").select("ts", "origin", r6("g3").alias("g3"))


@query("telemetry_target_join", "J03", """
WITH t AS (SELECT hour_end AS forecast_ts, grp, avg(ws) AS obs_ws FROM scada10 GROUP BY 1, 2)
SELECT forecast_ts, grid_id, round(gust + 1e-9, 6) + 0 AS gust, round(obs_ws + 1e-9, 6) + 0 AS obs_ws
FROM (SELECT *, concat('f', CAST(CAST(floor(grid_id / 3) AS INTEGER) AS VARCHAR)) AS grp FROM wx_obs) LEFT JOIN t USING (forecast_ts, grp)""")
def telemetry_target_join(v) -> DataFrame:
    features = v.wx_obs.withColumn("grp", F.concat(F.lit("f"), F.floor(F.col("grid_id") / 3).cast("int").cast("string")))
    targets = v.scada10.groupBy(F.col("hour_end").alias("forecast_ts"), "grp").agg(F.avg("ws").alias("obs_ws"))
    out = C.many_to_one(features, targets, ["forecast_ts", "grp"])
    return out.select("forecast_ts", "grid_id", r6("gust").alias("gust"), r6("obs_ws").alias("obs_ws"))


@query("feature_name_rules", "P02 P03", f"""
WITH n AS (SELECT p_partkey, concat(['wx__', 'cross__', 'Target_group_', 'SCADA_', 'run__'][p_partkey % 5 + 1], replace(lower(p_name), ' ', '_'), '_', lower(p_brand)) AS feature FROM part)
SELECT p_partkey, feature, (starts_with(feature, 'wx__') OR starts_with(feature, 'run__') OR contains(feature, 'brand#1')) AND NOT contains(lower(feature), 'target') AS selected,
       regexp_matches(feature, '{C.FORBIDDEN_FEATURE_PATTERN}', 'i') AS refused FROM n""")
def feature_name_rules(v) -> DataFrame:
    first = F.element_at(F.array(*[F.lit(p) for p in ("wx__", "cross__", "Target_group_", "SCADA_", "run__")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    names = v.table("part").select("p_partkey", F.concat(first, F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.lower("p_brand")).alias("feature"))
    return C.name_rules(names, "feature", prefixes=["wx__", "run__"], tokens=["brand#1"], forbidden=["target"])


@query("text_manifest", "S18", """
WITH f AS (SELECT doc_id, concat('doc/', CAST(doc_id AS VARCHAR)) AS path, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size_bytes, sha256(coalesce(text, '')) AS sha256 FROM documents)
SELECT path, size_bytes, sha256, CASE doc_id % 7 WHEN 0 THEN 'UNDECLARED' WHEN 1 THEN 'FOUND_HASH_MISMATCH' WHEN 2 THEN 'FOUND_HASH_MISMATCH' ELSE 'FOUND_HASH_MATCH' END AS status FROM f
UNION ALL SELECT concat('gone/', CAST(doc_id AS VARCHAR)), NULL, NULL, 'MISSING' FROM f WHERE doc_id % 11 = 0""")
def text_manifest(v) -> DataFrame:
    docs = v.table("documents")
    d = F.col("doc_id")
    found = MF.describe_texts(docs, F.concat(F.lit("doc/"), d.cast("string")), "text")
    own = docs.select(d, F.coalesce("text", F.lit("")).alias("t")).where(d % 7 != 0).select(
        F.concat(F.lit("doc/"), d.cast("string")).alias("path"), (F.octet_length("t") + F.when(d % 7 == 1, 1).otherwise(0)).cast("long").alias("size_bytes"),
        F.upper(F.sha2(F.concat("t", F.when(d % 7 == 2, "x").otherwise("")), 256)).alias("sha256"))
    gone = docs.where(d % 11 == 0).select(F.concat(F.lit("gone/"), d.cast("string")).alias("path"), F.lit(1).cast("long").alias("size_bytes"), F.lit("0").alias("sha256"))
    return MF.verify_manifest(own.unionByName(gone), found).select("path", "size_bytes", "sha256", "status")
