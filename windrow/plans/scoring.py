"""Settlement metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.functions.exprs import r6, rounded, sum_when
from windrow.functions.timekeys import run_key
from windrow.operators import bootstrap as B
from windrow.operators import settlement as S
from windrow.operators import slices as L
from windrow.operators import utility as U
from windrow.plans.registry import query

_ELIG = "actual IS NOT NULL AND actual >= capacity * 0.10"
_PRICE = "CASE WHEN rate <= 0.06 THEN 4.0 WHEN rate <= 0.08 THEN 3.0 ELSE 0.0 END"


@query("settlement_by_group", "A01 P01 F18", f"""
WITH r AS (SELECT *, abs(base - actual) / capacity AS rate FROM fcst WHERE {_ELIG})
SELECT grp, count(*) AS n_evaluated, round(sum(actual) + 1e-9, 6) AS actual_energy, round(avg(rate) + 1e-9, 6) AS nmae,
       round(1 - avg(rate) + 1e-9, 6) AS one_minus_nmae, round(sum(actual * {_PRICE}) / (4 * sum(actual)) + 1e-9, 6) AS ficr,
       count(*) FILTER (rate <= 0.06) AS within_6_count, count(*) FILTER (rate > 0.06 AND rate <= 0.08) AS within_8_count,
       count(*) FILTER (rate > 0.08) AS over_8_count,
       round(coalesce(sum(actual) FILTER (rate <= 0.06), 0) / sum(actual) + 1e-9, 6) AS within_6_energy_share,
       round(coalesce(sum(actual) FILTER (rate > 0.06 AND rate <= 0.08), 0) / sum(actual) + 1e-9, 6) AS within_8_energy_share,
       round(coalesce(sum(actual) FILTER (rate > 0.08), 0) / sum(actual) + 1e-9, 6) AS over_8_energy_share
FROM r GROUP BY grp""")
def settlement_by_group(v) -> DataFrame:
    out = S.group_metrics(v.fcst, ["grp"], "base")
    return out.select(
        "grp", "n_evaluated", *[r6(c).alias(c) for c in ("actual_energy", "nmae", "one_minus_nmae", "ficr")],
        "within_6_count", "within_8_count", "over_8_count",
        *[r6(f"{b}_energy_share").alias(f"{b}_energy_share") for b in ("within_6", "within_8", "over_8")],
    )


@query("settlement_macro", "A02", f"""
WITH r AS (SELECT *, abs(base - actual) / capacity AS rate FROM fcst WHERE {_ELIG}),
g AS (SELECT grp, avg(rate) AS nmae, sum(actual * {_PRICE}) / (4 * sum(actual)) AS ficr FROM r GROUP BY grp)
SELECT round(0.5 * (1 - avg(nmae)) + 0.5 * avg(ficr) + 1e-9, 6) AS total_score, round(1 - avg(nmae) + 1e-9, 6) AS one_minus_nmae,
       round(avg(ficr) + 1e-9, 6) AS ficr FROM g""")
def settlement_macro(v) -> DataFrame:
    out = S.macro_score(S.group_metrics(v.fcst, ["grp"], "base"))
    return rounded(out, [], ["total_score", "one_minus_nmae", "ficr"])


@query("metric_parity", "A03", f"""
WITH r AS (SELECT *, abs(base - actual) / capacity AS rate FROM fcst WHERE {_ELIG}),
g AS (SELECT grp, avg(rate) AS nmae, sum(actual * {_PRICE}) / (4 * sum(actual)) AS ficr FROM r GROUP BY grp),
m AS (SELECT 1 - avg(nmae) AS om, avg(ficr) AS ficr FROM g)
SELECT unnest(['total_score', 'one_minus_nmae', 'ficr']) AS metric,
       round(unnest([0.5 * (om + ficr), om, ficr]) + 1e-9, 6) AS independent,
       round(unnest([0.5 * om + 0.5 * ficr, om, ficr]) + 1e-9, 6) AS official, true AS within_tolerance FROM m""")
def metric_parity(v) -> DataFrame:
    return S.parity_report(v.fcst, "base").select("metric", r6("independent").alias("independent"),
                                                  r6("official").alias("official"), "within_tolerance")


@query("boundary_energy_census", "A04", f"""
WITH r AS (SELECT *, abs(cand - actual) / capacity AS rate FROM fcst WHERE {_ELIG}),
b AS (SELECT grp, CASE WHEN rate <= 0.06 THEN 'within_6' WHEN rate <= 0.08 THEN 'within_8' ELSE 'over_8' END AS band,
             count(*) AS n, sum(actual) AS energy FROM r GROUP BY 1, 2)
SELECT grp, band, n, energy, round(energy / sum(energy) OVER (PARTITION BY grp) + 1e-9, 6) AS energy_share FROM b""")
def boundary_energy_census(v) -> DataFrame:
    return S.boundary_energy_census(v.fcst, ["grp"], "cand").withColumn("energy_share", r6("energy_share"))


_PAIRED_SQL = f"""
pr AS (SELECT *, CASE WHEN eb <= 0.06 THEN 4.0 WHEN eb <= 0.08 THEN 3.0 ELSE 0.0 END AS pb,
              CASE WHEN ec <= 0.06 THEN 4.0 WHEN ec <= 0.08 THEN 3.0 ELSE 0.0 END AS pc
       FROM (SELECT *, abs(base - actual) / capacity AS eb, abs(cand - actual) / capacity AS ec,
                    date_trunc('day', ts - INTERVAL 1 HOUR) AS day FROM fcst WHERE {_ELIG}))"""
_TRIPLE = """count(*) AS n, 1 - avg(eb) AS bo, sum(actual * pb) / (4 * sum(actual)) AS bf,
       1 - avg(ec) AS co, sum(actual * pc) / (4 * sum(actual)) AS cf"""
_DELTAS_SQL = """round(0.5 * bo + 0.5 * bf + 1e-9, 6) AS baseline_score, round(0.5 * co + 0.5 * cf + 1e-9, 6) AS candidate_score,
       round(0.5 * (co - bo) + 0.5 * (cf - bf) + 1e-9, 6) AS delta_score, round(co - bo + 1e-9, 6) AS delta_one_minus_nmae,
       round(cf - bf + 1e-9, 6) AS delta_ficr"""
_DELTA_COLUMNS = ["baseline_score", "candidate_score", "delta_score", "delta_one_minus_nmae", "delta_ficr"]


@query("year_slice_comparison", "A05 W01", f"""
WITH {_PAIRED_SQL},
s AS (SELECT *, unnest(['full', CASE WHEN month(day) <= 6 THEN 'H1' ELSE 'H2' END, 'Q' || quarter(day)]) AS slice FROM pr),
g AS (SELECT grp, CAST(year(day) AS INTEGER) AS year, slice, {_TRIPLE} FROM s GROUP BY 1, 2, 3)
SELECT grp, year, slice, n, {_DELTAS_SQL} FROM g""")
def year_slice_comparison(v) -> DataFrame:
    return rounded(L.compare_year_slices(v.fcst, "base", "cand"), ["grp", "year", "slice", "n"], _DELTA_COLUMNS)


# closed intervals that overlap
_SEGMENTS = {
    "full": ("1995-01-01", "2001-12-31"), "early": ("1995-01-01", "1997-12-31"), "late": ("1998-01-01", "2001-12-31"),
    "middle": ("1996-07-01", "1999-06-30"),
}


@query("segment_comparison", "A05", f"""
WITH {_PAIRED_SQL},
seg(segment, a, b) AS (VALUES {', '.join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n, (a, b) in _SEGMENTS.items())}),
g AS (SELECT grp, segment, {_TRIPLE} FROM pr JOIN seg ON ts BETWEEN a AND b GROUP BY 1, 2)
SELECT grp, segment, n, {_DELTAS_SQL} FROM g""")
def segment_comparison(v) -> DataFrame:
    return rounded(L.compare_segments(v.fcst, "base", "cand", _SEGMENTS), ["grp", "segment", "n"], _DELTA_COLUMNS)


@query("time_regime_comparison", "A06", f"""
WITH {_PAIRED_SQL},
dr AS (SELECT grp, ts, round(avg(third) / 4, 9) AS driver FROM fcst GROUP BY 1, 2),
cell AS (SELECT pr.*, dr.driver FROM pr JOIN dr ON dr.grp = pr.grp AND dr.ts = pr.ts),
present AS (SELECT DISTINCT grp, ts, driver FROM cell),
mx AS (SELECT ts, round(avg(driver), 9) AS mixed FROM present GROUP BY ts),
r AS (SELECT cell.*, CASE WHEN driver < 4 THEN 'low' WHEN driver < 8 THEN 'mid' ELSE 'high' END AS own_regime,
             CASE WHEN mixed < 4 THEN 'low' WHEN mixed < 8 THEN 'mid' ELSE 'high' END AS mixed_regime
      FROM cell JOIN mx ON mx.ts = cell.ts),
t AS (SELECT *, unnest(['full', CASE WHEN month(day) <= 6 THEN 'H1' ELSE 'H2' END, 'Q' || quarter(day)]) AS slice FROM r),
g AS (SELECT grp, 'time' AS family, slice, true AS own, true AS mx, {_TRIPLE} FROM t GROUP BY 1, 2, 3
      UNION ALL SELECT grp, 'regime', own_regime, true, false, {_TRIPLE} FROM r GROUP BY 1, 2, 3
      UNION ALL SELECT grp, 'regime', mixed_regime, false, true, {_TRIPLE} FROM r GROUP BY 1, 2, 3),
u AS (SELECT grp, family, slice, n, bo, bf, co, cf FROM g WHERE own
      UNION ALL SELECT 'mixed', family, slice, CAST(sum(n) AS BIGINT), avg(bo), avg(bf), avg(co), avg(cf) FROM g WHERE mx
      GROUP BY 2, 3)
SELECT grp, family, slice, n, {_DELTAS_SQL} FROM u""")
def time_regime_comparison(v) -> DataFrame:
    out = L.compare_time_and_regime(v.fcst, "base", "cand", F.avg("third") / 4)
    return rounded(out, ["grp", "family", "slice", "n"], _DELTA_COLUMNS)


_MEANS_SQL = f"ma AS (SELECT grp, count(*) AS ng, avg(actual) AS mean_actual FROM fcst WHERE {_ELIG} GROUP BY grp)"


def _u(forecast: str) -> str:
    e = f"abs({forecast} - actual) / capacity"
    return (f"(0.5 * (1 - {e}) + 0.5 * (actual / mean_actual) * (CASE WHEN {e} <= 0.06 THEN 4.0 WHEN {e} <= 0.08 THEN 3.0 "
            f"ELSE 0.0 END / 4.0))")


def _gain(forecast: str) -> str:
    e = f"abs({forecast} - actual) / capacity"
    return (f"(-0.5 * ({e}) * (CAST(1 AS DOUBLE) / ng) + 0.5 * actual * (CASE WHEN {e} <= 0.06 THEN 4.0 WHEN {e} <= 0.08 THEN 3.0 "
            f"ELSE 0.0 END) / (4.0 * ng * mean_actual))")


@query("rowwise_oracle", "T07", f"""
WITH {_MEANS_SQL},
x AS (SELECT f.*, {_ELIG} AS ok, {_gain('base')} AS u0, {_gain('cand')} AS u1, {_gain('third')} AS u2
      FROM fcst f JOIN ma ON ma.grp = f.grp),
s AS (SELECT *, CASE WHEN NOT ok THEN 'base' WHEN u0 >= u1 AND u0 >= u2 THEN 'base' WHEN u1 >= u2 THEN 'cand' ELSE 'third' END
             AS selected FROM x)
SELECT grp, site, ts, selected, ok AS scored, round(CASE selected WHEN 'base' THEN base WHEN 'cand' THEN cand ELSE third END + 1e-9, 6) AS kwh FROM s""")
def rowwise_oracle(v) -> DataFrame:
    best = U.rowwise_best(v.fcst, ["base", "cand", "third"], "base")
    return best.select("grp", "site", "ts", "selected", S.eligible("actual", "capacity").alias("scored"), r6("oracle").alias("kwh"))


_TARGETS = ("eligible", "actual_cf", "signed_residual_cf", "absolute_error_cf", "within_6", "within_8", "margin_6",
            "margin_8", "plus_vs_minus_utility", "best_one_percent_utility_gain")


@query("score_aware_targets", "F20 F19", f"""
WITH {_MEANS_SQL},
x AS (SELECT f.*, {_ELIG} AS ok, abs((actual - base) / capacity) AS e, {_u('base')} AS u0,
             {_u('(base + 0.01 * capacity)')} AS up, {_u('(base - 0.01 * capacity)')} AS um
      FROM fcst f JOIN ma ON ma.grp = f.grp)
SELECT grp, site, round(sum(CASE WHEN ok THEN 1.0 ELSE 0.0 END) + 1e-9, 6) AS eligible,
       round(sum(actual / capacity) FILTER (ok) + 1e-9, 6) AS actual_cf,
       round(sum((actual - base) / capacity) FILTER (ok) + 1e-9, 6) AS signed_residual_cf,
       round(sum(e) FILTER (ok) + 1e-9, 6) AS absolute_error_cf,
       round(sum(CASE WHEN e <= 0.06 THEN 1.0 ELSE 0.0 END) FILTER (ok) + 1e-9, 6) AS within_6,
       round(sum(CASE WHEN e <= 0.08 THEN 1.0 ELSE 0.0 END) FILTER (ok) + 1e-9, 6) AS within_8,
       round(sum(0.06 - e) FILTER (ok) + 1e-9, 6) AS margin_6, round(sum(0.08 - e) FILTER (ok) + 1e-9, 6) AS margin_8,
       round(sum(up - um) FILTER (ok) + 1e-9, 6) AS plus_vs_minus_utility,
       round(sum(greatest(up, um) - u0) FILTER (ok) + 1e-9, 6) AS best_one_percent_utility_gain
FROM x GROUP BY grp, site""")
def score_aware_targets(v) -> DataFrame:
    out = U.score_aware_targets(v.fcst)
    return out.groupBy("grp", "site").agg(*[r6(F.sum(t)).alias(t) for t in _TARGETS])


@query("action_utility_deltas", "F19 J20", f"""
WITH {_MEANS_SQL},
x AS (SELECT f.grp, site, ts, actual / capacity AS y, least(greatest(base / capacity, 0), 1.02) AS b, mean_actual / capacity AS m,
             unnest([0.98, 0.95]) AS factor FROM fcst f JOIN ma ON ma.grp = f.grp WHERE {_ELIG}),
e AS (SELECT *, abs(b - y) AS e0, abs(least(greatest(CAST(factor AS DOUBLE) * b, 0), 1.02) - y) AS e1 FROM x),
d AS (SELECT *, 0.5 * (e0 - e1) + 0.5 * (y / m) * ((CASE WHEN e1 <= 0.06 THEN 4.0 WHEN e1 <= 0.08 THEN 3.0 ELSE 0.0 END)
             - (CASE WHEN e0 <= 0.06 THEN 4.0 WHEN e0 <= 0.08 THEN 3.0 ELSE 0.0 END)) / 4.0 AS delta FROM e)
SELECT grp, site, ts, CAST(factor AS DOUBLE) AS factor, round(delta + 1e-9, 6) + 0 AS utility_delta FROM d""")
def action_utility_deltas(v) -> DataFrame:
    out = U.action_utility_deltas(v.fcst)
    return out.select("grp", "site", "ts", "factor", r6("utility_delta").alias("utility_delta"))


def _smooth_sql() -> str:
    p6 = "(1 / (1 + exp(-least(greatest((0.06 - radius) / 0.005, -40), 40))))"
    p8 = "(1 / (1 + exp(-least(greatest((0.08 - radius) / 0.005, -40), 40))))"
    return f"""
WITH {_MEANS_SQL},
x AS (SELECT f.grp, site, ts, base / capacity - actual / capacity AS err, (actual / capacity) / (8 * (mean_actual / capacity)) AS sc
      FROM fcst f JOIN ma ON ma.grp = f.grp WHERE {_ELIG}),
r AS (SELECT *, sqrt(err * err + 0.0025 * 0.0025) AS radius FROM x),
p AS (SELECT *, {p6} AS p6, {p8} AS p8 FROM r),
v AS (SELECT *, 0.5 * radius - sc * (p6 + 3 * p8) AS loss,
             0.5 + sc * (p6 * (1 - p6) + 3 * p8 * (1 - p8)) / 0.005 AS slope,
             -sc * (p6 * (1 - p6) * (1 - 2 * p6) + 3 * p8 * (1 - p8) * (1 - 2 * p8)) / (0.005 * 0.005) AS bend FROM p)
SELECT grp, site, ts, round(loss + 1e-9, 6) + 0 AS loss, round(slope * err / radius + 1e-9, 6) + 0 AS gradient,
       round(least(greatest(abs(slope * 0.0025 * 0.0025 / pow(radius, 3) + bend * (err / radius) * (err / radius)), 0.001), 200) + 1e-9, 6) AS curvature,
       round(0.04 * 0.04 * (sqrt(1 + (err / 0.04) * (err / 0.04)) - 1) + 1e-9, 6) AS pseudo_huber
FROM v"""


@query("smooth_settlement_loss", "F21 F22", _smooth_sql())
def smooth_settlement_loss(v) -> DataFrame:
    rows = U.with_mean_actual(v.fcst).where(S.eligible("actual", "capacity"))
    cap = F.col("capacity")
    loss, grad, curve = U.smooth_settlement_loss(F.col("base") / cap, F.col("actual") / cap, F.col("mean_actual") / cap)
    huber = U.pseudo_huber(F.col("base") / cap - F.col("actual") / cap)
    return rows.select("grp", "site", "ts", r6(loss).alias("loss"), r6(grad).alias("gradient"), r6(curve).alias("curvature"), r6(huber).alias("pseudo_huber"))


_BOOT_CTE = f"""
rw AS (SELECT *, {_ELIG} AS ok, date_trunc('day', ts - INTERVAL 1 HOUR) AS day,
              year(ts - INTERVAL 1 HOUR) % 2 AS fold,
              abs(base - actual) / capacity AS eb, abs(cand - actual) / capacity AS ec, abs(third - actual) / capacity AS et FROM fcst),
dl AS (SELECT fold, grp, day, count(*) FILTER (ok) AS n, coalesce(sum(actual) FILTER (ok), 0) AS energy,
              {', '.join(f"coalesce(sum({e}) FILTER (ok), 0) AS {e}, coalesce(sum(actual * CASE WHEN {e} <= 0.06 THEN 4.0 WHEN {e} <= 0.08 THEN 3.0 ELSE 0.0 END) FILTER (ok), 0) AS p{e}" for e in ('eb', 'ec', 'et'))}
       FROM rw GROUP BY 1, 2, 3),
cal AS (SELECT fold, day, row_number() OVER (PARTITION BY fold ORDER BY day) - 1 AS pos, count(*) OVER (PARTITION BY fold) AS days
        FROM (SELECT DISTINCT fold, day FROM dl)),
fl AS (SELECT DISTINCT fold, days FROM cal),
dr AS (SELECT fold, replicate, block, days,
              CAST('0x' || substr(md5(fold || '-' || replicate || '-' || block), 1, 8) AS BIGINT) % days AS start
       FROM (SELECT *, unnest(range(0, CAST(ceil(days / 7.0) AS BIGINT))) AS block FROM fl), range(10000) t(replicate)),
blocks AS (SELECT s.fold, s.start, k.last, d.grp, sum(n) AS n, sum(energy) AS energy,
              {', '.join(f'sum({c}) AS {c}' for e in ('eb', 'ec', 'et') for c in (e, 'p' + e))}
       FROM (SELECT fold, pos AS start, days FROM cal) s CROSS JOIN (VALUES (true), (false)) k(last)
       CROSS JOIN range(7) o(ofs) JOIN cal c ON c.fold = s.fold AND c.pos = (s.start + o.ofs) % s.days
       JOIN dl d ON d.fold = c.fold AND d.day = c.day
       WHERE NOT k.last OR o.ofs < s.days - 7 * (ceil(s.days / 7.0) - 1) GROUP BY 1, 2, 3, 4),
rg AS (SELECT dr.replicate, b.grp, sum(n) AS n, sum(energy) AS energy,
              {', '.join(f'sum({c}) AS {c}' for e in ('eb', 'ec', 'et') for c in (e, 'p' + e))}
       FROM dr JOIN blocks b ON b.fold = dr.fold AND b.start = dr.start AND b.last = (dr.block = ceil(dr.days / 7.0) - 1) GROUP BY 1, 2),
boot AS (SELECT replicate, avg(0.5 * (eb - ec) / n + 0.5 * (pec - peb) / (4 * energy)) AS delta_cand,
              avg(0.5 * (eb - et) / n + 0.5 * (pet - peb) / (4 * energy)) AS delta_third FROM rg GROUP BY replicate)"""


def _bootstrap(v) -> DataFrame:
    fold = F.year(run_key("ts")) % 2
    return B.block_bootstrap(B.daily_totals(v.fcst, "base", ["cand", "third"], fold), "base", ["cand", "third"])


@query("bootstrap_score_deltas", "A44", f"""
WITH {_BOOT_CTE}
SELECT replicate, round(delta_cand + 1e-9, 6) AS delta_cand, round(delta_third + 1e-9, 6) AS delta_third FROM boot""")
def bootstrap_score_deltas(v) -> DataFrame:
    return rounded(_bootstrap(v), ["replicate"], ["delta_cand", "delta_third"])


@query("risk_adjusted_score", "A45", f"""
WITH {_BOOT_CTE},
tr AS (SELECT candidate, grp, 1 - avg(e) AS om, sum(actual * p) / (4 * sum(actual)) AS f FROM (
        SELECT grp, actual, candidate, e, CASE WHEN e <= 0.06 THEN 4.0 WHEN e <= 0.08 THEN 3.0 ELSE 0.0 END AS p FROM (
          SELECT grp, actual, unnest(['base', 'cand', 'third']) AS candidate, unnest([eb, ec, et]) AS e FROM rw WHERE ok))
       GROUP BY 1, 2),
dg AS (SELECT c.candidate, c.grp, 0.5 * b.om + 0.5 * b.f AS b, 0.5 * (c.om - b.om) + 0.5 * (c.f - b.f) AS d, c.om - b.om AS dom, c.f - b.f AS df
       FROM tr c JOIN tr b ON b.grp = c.grp AND b.candidate = 'base' WHERE c.candidate <> 'base'),
ob AS (SELECT candidate, avg(b) AS baseline_score, avg(d) AS raw_delta, min(d) AS minimum_cell_delta, avg(df) AS delta_ficr,
              avg(dom) AS dom FROM dg GROUP BY 1),
cr AS (SELECT quantile_cont(greatest(delta_cand - (SELECT raw_delta FROM ob WHERE candidate = 'cand'),
                                     delta_third - (SELECT raw_delta FROM ob WHERE candidate = 'third')), 0.9) AS c FROM boot),
pn AS (SELECT *, raw_delta - c AS lcb, greatest(0, -minimum_cell_delta) + 0.5 * greatest(0, -delta_ficr) + 0.5 * greatest(0, -(dom + 0.0002)) AS pen
       FROM ob, cr)
SELECT candidate, round(raw_delta + 1e-9, 6) AS raw_delta, round(lcb + 1e-9, 6) AS simultaneous_lcb, round(pen + 1e-9, 6) AS instability_penalty,
       round(lcb - pen + 1e-9, 6) AS risk_adjusted_increment, round(baseline_score + lcb - pen + 1e-9, 6) AS local_virtual_score FROM pn""")
def risk_adjusted_score(v) -> DataFrame:
    names = ["cand", "third"]
    totals = {c: L.paired_scores(L.paired_totals(v.fcst, ["grp"], "base", c)) for c in names}
    parts = None
    for c, scores in totals.items():
        row = L.deltas(scores).agg(
            F.lit(c).alias("candidate"), F.avg("baseline_score").alias("baseline_score"),
            F.min("delta_score").alias("minimum_cell_delta"), F.avg("delta_score").alias("raw"),
            F.avg("delta_ficr").alias("delta_ficr"), F.avg("delta_one_minus_nmae").alias("delta_one_minus_nmae"),
        )
        parts = row if parts is None else parts.unionByName(row)
    observed = parts.agg(*[F.max(F.when(F.col("candidate") == c, F.col("raw"))).alias(f"delta_{c}") for c in names])
    bounds = B.simultaneous_bounds(_bootstrap(v), observed, names)
    out = B.risk_adjusted(bounds.join(parts.drop("raw"), "candidate"))
    return rounded(out, ["candidate"], ["raw_delta", "simultaneous_lcb", "instability_penalty", "risk_adjusted_increment",
                                        "local_virtual_score"])
