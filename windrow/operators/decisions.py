"""Decisions under uncertain outcomes: expected-utility actions from samples, classes, quantiles and leaves.

The work per row (actions x outcomes) is a dense product, so it runs in one vectorised kernel on Arrow batches.  Rows
are never multiplied and nothing is shuffled for the choice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.functions.exprs import ColumnLike, clip, col, edge_bin
from windrow.functions.ranks import exact_quantiles
from windrow.operators.lookups import attach

# fixed values
CLASS_COUNT, CLASS_START, CLASS_WIDTH = 42, 0.10, 0.025
RESIDUAL_CLASS_COUNT, RESIDUAL_FIRST, RESIDUAL_STEP = 43, -0.525, 0.025
ACTION_STEP, ACTION_REACH = 0.005, 0.150
OUTCOME_BOUNDS = (0.10, 1.20)
ACTION_BOUNDS = (0.0, 1.02)
QUANTILE_LEVELS = (0.10, 0.25, 0.50, 0.75, 0.90)
INTERPOLATION_COUNT = 33
ABSOLUTE_STEP = 0.01
SAMPLE_OFFSETS = (-0.12, -0.10, -0.08, -0.06, -0.04, -0.03, -0.02, -0.01, 0.0, 0.01, 0.02, 0.03, 0.04, 0.06, 0.08, 0.10, 0.12)
SAMPLE_BIN_EDGES = (0.10, 0.20, 0.35, 0.50, 0.65, 0.80, 0.95)
SAMPLE_COUNT, MIN_BIN_SAMPLES, BIN_SHRINKAGE = 41, 250, 500.0
BANDWIDTH_BOUNDS = (0.003, 0.030)
DECISION_SHRINKAGE = 0.65
CORRIDOR_OFFSETS = (-0.08, -0.06, 0.0, 0.06, 0.08)
SELECTIVE_FACTOR, SELECTIVE_MARGIN = 0.98, 0.01

TIE = 1e-12
#: differences of capacity factors that rounding may hide, a thousand times their error
ROUNDING = 1e-12
#: members or queries of one leaf that a task takes: smaller cuts multiply the tasks of a leaf with the square of its size
TASK_ROWS = 32_768
#: of an action: sorts last, and is what the kernel reads a null as
MISSING = float("nan")
CLASS_CENTRES = tuple(round(CLASS_START + CLASS_WIDTH * (i + 0.5), 12) for i in range(CLASS_COUNT))
CLASS_EDGES = tuple(round(CLASS_START + CLASS_WIDTH * (i + 1), 12) for i in range(CLASS_COUNT))
RESIDUAL_CENTRES = tuple(round(RESIDUAL_FIRST + RESIDUAL_STEP * i, 12) for i in range(RESIDUAL_CLASS_COUNT))
ACTION_DELTAS = tuple(round(-ACTION_REACH + ACTION_STEP * i, 12) for i in range(int(round(2 * ACTION_REACH / ACTION_STEP)) + 1))
ACTION_GRID = tuple(i / 100.0 for i in range(103))


def literal_array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def target_class(cf: ColumnLike) -> Column:
    """Class 0 ... 41 of an eligible capacity factor; the last class takes the tail."""
    return F.least(edge_bin(cf, CLASS_EDGES), F.lit(CLASS_COUNT - 1))


def residual_class(residual: ColumnLike) -> Column:
    """Nearest residual centre, a midpoint going to the lower one; the end classes take the tails."""
    at = (col(residual) - RESIDUAL_FIRST) / RESIDUAL_STEP
    return clip(F.ceil(at - 0.5 - TIE), 0.0, float(RESIDUAL_CLASS_COUNT - 1)).cast("int")


_CHOICE = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("action", T.DoubleType()),
                        T.StructField("utility", T.DoubleType()), T.StructField("ties", T.IntegerType())])
_GRID_CHOICE = T.StructType([T.StructField("action", T.DoubleType()), T.StructField("utility", T.DoubleType())])
_BLOCK_CELLS = 4_000_000
#: cells of rows x actions x outcomes a block of the dense kernel holds, so that its tables stay in a core's cache
_DENSE_CELLS = 40_000


def _expected(actions: np.ndarray, outcomes: np.ndarray, weights: np.ndarray, mean: np.ndarray, unit: np.ndarray | None = None) -> np.ndarray:
    """(rows, actions): weighted mean of -|a - y| + y price / (4 mean), in capacity factors.  Actions and outcomes in kWh
    come with their capacity as ``unit``, because the price edges are meant for the difference in kWh over capacity."""
    (n, na), no = actions.shape, outcomes.shape[1]
    earned = weights * outcomes / (4.0 * mean[:, None])
    if unit is not None:
        earned /= unit[:, None]
    out, step = np.empty((n, na)), max(1, _DENSE_CELLS // max(na * no, 1))
    gap, price, near, nearer = (np.empty((min(step, n), na, no), kind) for kind in (float, float, bool, bool))  # every block writes the same memory
    for start in range(0, n, step):
        part = slice(start, min(start + step, n))
        g, p, wide, tight = (x[:part.stop - start] for x in (gap, price, near, nearer))
        np.subtract(actions[part, :, None], outcomes[part, None, :], out=g)
        np.abs(g, out=g)
        if unit is not None:
            g /= unit[part, None, None]
        np.less_equal(g, 0.08, out=wide)
        np.less_equal(g, 0.06, out=tight)
        paid = wide.view(np.int8)
        paid *= 3
        paid += tight.view(np.int8)
        np.copyto(p, paid)
        out[part] = (p @ earned[part, :, None] - g @ weights[part, :, None])[:, :, 0]
    return out


def _lists(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every row's list, and the values of all; a missing value is not a number."""
    if array.null_count:
        raise ValueError("actions, preferences, outcomes and weights must be lists")
    ends = array.offsets.to_numpy()
    return ends[:-1], np.diff(ends), array.values.cast(pa.float64()).to_numpy(zero_copy_only=False)


@F.arrow_udf(_CHOICE)
def _choose(actions: pa.Array, preference: pa.Array, outcomes: pa.Array, weights: pa.Array, mean: pa.Array, unit: pa.Array) -> pa.Array:
    lists = [_lists(x) for x in (actions, preference, outcomes, weights)]
    if any((lists[i][1] != lists[i + 1][1]).any() for i in (0, 2)):
        raise ValueError("every action needs a preference, every outcome a weight")
    mean, unit = (x.cast(pa.float64()).to_numpy(zero_copy_only=False) for x in (mean, unit))
    position = np.zeros(len(mean), dtype=np.int32)
    action, utility, ties = np.full(len(mean), np.nan), np.full(len(mean), np.nan), np.zeros(len(mean), dtype=np.int32)
    shapes, kind = np.unique(np.stack([lists[0][1], lists[2][1]]), axis=1, return_inverse=True)
    kind = kind.ravel()
    for i, (na, no) in enumerate(shapes.T):
        rows = np.flatnonzero(kind == i)
        step = max(1, _BLOCK_CELLS // max(na * no, 1))
        for start in range(0, len(rows), step):
            part = rows[start:start + step]
            a, prefer, y, w = (values[starts[part][:, None] + np.arange(n)] for (starts, _, values), n in zip(lists, (na, na, no, no)))
            size = unit[part]
            u = _expected(a, y, w, mean[part], None if (size == 1.0).all() else size)
            tied = u >= u.max(axis=1, keepdims=True) - TIE
            distance = np.where(tied, prefer, np.inf)
            pick = np.argmax(distance <= distance.min(axis=1, keepdims=True) + 1e-15, axis=1)
            at = np.arange(len(part))
            position[part], action[part], utility[part], ties[part] = pick, a[at, pick], u[at, pick], tied.sum(axis=1)
    return pa.StructArray.from_arrays([pa.array(x, from_pandas=True) for x in (position, action, utility, ties)], names=["position", "action", "utility", "ties"])


def best_action(actions: ColumnLike, preference: ColumnLike, outcomes: ColumnLike, weights: ColumnLike, mean: ColumnLike,
                unit: ColumnLike | None = None) -> Column:
    """Struct (position, action, utility, ties) of the action with the largest expected utility.

    ``actions`` must ascend: among ties the smallest ``preference`` wins, then the lower action.
    """
    return _choose(col(actions), col(preference), col(outcomes), col(weights), col(mean).cast("double"),
                   F.lit(1.0) if unit is None else col(unit).cast("double"))


def _uniform(n: int) -> Column:
    return literal_array([1.0 / n] * n)


def corridor_action(models: Sequence[ColumnLike], capacity: ColumnLike) -> Column:
    """Scenarios are the row's models, actions the scenarios shifted by 0, 6 % and 8 %; ties go to the one nearest the
    median, then the lower.  Returned in kWh."""
    cap = col(capacity)
    scenarios = F.array(*[col(m) for m in models])
    actions = F.sort_array(F.array(*[F.coalesce(clip(col(m) + o * cap, 0.0, cap), F.lit(MISSING)) for m in models for o in CORRIDOR_OFFSETS]))
    ordered = F.array_sort(scenarios)
    n = len(models)
    median = (F.element_at(ordered, (n + 1) // 2) + F.element_at(ordered, n // 2 + 1)) / 2.0
    prefer = F.transform(actions, lambda a: F.round(F.abs(a - median), 12))
    return best_action(actions, prefer, scenarios, _uniform(n), F.lit(1.0), cap)["action"]


def class_action(probabilities: ColumnLike, base_cf: ColumnLike, mean: ColumnLike, deltas: Sequence[float] = ACTION_DELTAS) -> Column:
    """Absolute outcome classes; actions lie around the baseline."""
    actions = F.transform(literal_array(deltas), lambda d: clip(col(base_cf) + d, *ACTION_BOUNDS))
    prefer = F.transform(actions, lambda a: F.abs(a - col(base_cf)))
    return best_action(actions, prefer, literal_array(CLASS_CENTRES), probabilities, mean)


def residual_action(probabilities: ColumnLike, base_cf: ColumnLike, mean: ColumnLike, deltas: Sequence[float] = ACTION_DELTAS,
                    centres: Sequence[float] = RESIDUAL_CENTRES) -> tuple[Column, Column]:
    """Residual outcome classes; returns (chosen delta, choice struct).  Ties go to the smallest |delta|, then the lower."""
    steps = literal_array(deltas)
    actions = F.transform(steps, lambda d: clip(col(base_cf) + d, *ACTION_BOUNDS))
    outcomes = F.transform(literal_array(centres), lambda r: clip(col(base_cf) + r, *OUTCOME_BOUNDS))
    choice = best_action(actions, F.transform(steps, lambda d: F.abs(d)), outcomes, probabilities, mean)
    return F.element_at(steps, choice["position"] + 1), choice


def repaired_quantiles(values: Sequence[ColumnLike]) -> tuple[Column, Column]:
    """(sorted quantiles, whether any pair had crossed)."""
    raw = [col(v) for v in values]
    crossed = F.lit(False)
    for a, b in zip(raw, raw[1:]):
        crossed = crossed | (b < a)
    return F.array_sort(F.array(*raw)), crossed


def interpolated_outcomes(quantiles: ColumnLike, levels: Sequence[float] = QUANTILE_LEVELS, count: int = INTERPOLATION_COUNT,
                          shift: ColumnLike | None = None) -> Column:
    """Equally spaced probability points between the outer levels, linear between quantiles, bounded."""
    q = col(quantiles)
    points = []
    for i in range(count):
        p = levels[0] + (levels[-1] - levels[0]) * i / (count - 1)
        k = max(j for j in range(len(levels) - 1) if levels[j] <= p + 1e-15)
        t = min(max((p - levels[k]) / (levels[k + 1] - levels[k]), 0.0), 1.0)
        lo, hi = F.element_at(q, k + 1), F.element_at(q, k + 2)
        value = lo + (hi - lo) * t
        points.append(clip(value if shift is None else col(shift) + value, *OUTCOME_BOUNDS))
    return F.array(*points)


def quantile_action(quantiles: ColumnLike, base_cf: ColumnLike, mean: ColumnLike, residual: bool = False, first_grid: float = 0.0) -> Column:
    """Conditional quantiles -> outcomes -> action among the absolute grid, the baseline and the quantiles themselves."""
    q, b = col(quantiles), col(base_cf)
    steps = int(round((ACTION_BOUNDS[1] - first_grid) / ABSOLUTE_STEP)) + 1
    grid = literal_array([round(first_grid + ABSOLUTE_STEP * i, 12) for i in range(steps)])
    own = F.transform(q, lambda x: x + b) if residual else q
    raw = F.concat(grid, F.array(b), own)
    actions = F.sort_array(F.array_distinct(F.transform(raw, lambda a: F.coalesce(clip(a, *ACTION_BOUNDS), F.lit(MISSING)))))
    prefer = F.transform(actions, lambda a: F.abs(a - b))
    outcomes = interpolated_outcomes(q, shift=b if residual else None)
    return best_action(actions, prefer, outcomes, _uniform(INTERPOLATION_COUNT), mean)


def residual_samples(residuals: DataFrame, keys: Sequence[str], residual: str = "residual", count: int = SAMPLE_COUNT) -> DataFrame:
    """Per key: n, thinned residual quantiles and the 3-point kernel samples (centre - h, centre twice, centre + h) with a
    robust bandwidth.  Quantiles are exact and distributed; moments aggregate partially."""
    probs = [0.5 / count + (1.0 - 1.0 / count) * i / (count - 1) for i in range(count)]
    q = exact_quantiles(residuals, keys, residual, [*probs, 0.25, 0.75])
    s = residuals.groupBy(*keys).agg(F.stddev_samp(residual).alias("_sd"))
    rows = q.join(s, list(keys)) if keys else q.withColumn("_sd", s.scalar())
    robust = (F.element_at("q", count + 2) - F.element_at("q", count + 1)) / 1.349
    scale = F.when(robust > 0, F.least(F.col("_sd"), robust)).otherwise(F.col("_sd"))
    width = clip(0.9 * F.greatest(scale, F.lit(1e-12)) * F.pow(F.col("n").cast("double"), F.lit(-0.2)), *BANDWIDTH_BOUNDS)
    rows = rows.withColumns({"bandwidth": width, "centres": F.slice("q", 1, count)})
    return rows.select(
        *keys, "n", "bandwidth", "centres",
        F.concat(F.transform("centres", lambda c: c - F.col("bandwidth")), F.col("centres"), F.col("centres"),
                 F.transform("centres", lambda c: c + F.col("bandwidth"))).alias("samples"))


def sample_action(base_cf: ColumnLike, local: ColumnLike, n_local: ColumnLike, pooled: ColumnLike, mean: ColumnLike,
                  shrink: float = BIN_SHRINKAGE) -> Column:
    """Action from local residual samples mixed with the pooled ones by n / (n + shrink); no local samples means pooled."""
    b = col(base_cf)
    share = F.when(col(local).isNull(), 0.0).otherwise(col(n_local) / (col(n_local) + shrink))
    near = F.coalesce(col(local), F.array().cast("array<double>"))
    outcomes = F.transform(F.concat(near, col(pooled)), lambda r: clip(b + r, *OUTCOME_BOUNDS))
    weights = F.concat(F.transform(near, lambda _: share / F.size(near)), F.transform(col(pooled), lambda _: (1.0 - share) / F.size(col(pooled))))
    actions = F.transform(literal_array(SAMPLE_OFFSETS), lambda o: clip(b + o, *ACTION_BOUNDS))
    return best_action(actions, F.transform(actions, lambda a: F.abs(a - b)), outcomes, weights, mean)


def binned_sample_decisions(fit: DataFrame, apply: DataFrame, mean: float | Column, residual: str = "residual", base_cf: str = "base_cf",
                            minimum: int = MIN_BIN_SAMPLES) -> DataFrame:
    """Residual samples per baseline bin, shrunk to the pooled ones, then the bounded and shrunk decision."""
    binned = fit.withColumn("bin", edge_bin(base_cf, SAMPLE_BIN_EDGES))
    local = residual_samples(binned, ["bin"], residual).where(F.col("n") >= minimum).select(
        "bin", F.col("n").alias("n_local"), F.col("samples").alias("local"))
    pooled = residual_samples(fit.withColumn("_k", F.lit(1)), ["_k"], residual).select("samples")
    rows = attach(apply.withColumn("bin", edge_bin(base_cf, SAMPLE_BIN_EDGES)), local, ["bin"])
    rows = rows.withColumn("pooled", pooled.scalar())
    level = F.lit(mean) if isinstance(mean, float) else mean
    rows = rows.withColumn("_c", sample_action(base_cf, "local", "n_local", "pooled", level))
    moved = clip(F.col(base_cf) + DECISION_SHRINKAGE * (F.col("_c.action") - F.col(base_cf)), *ACTION_BOUNDS)
    return rows.withColumns({"raw_action": F.col("_c.action"), "decision_cf": moved}).drop("local", "n_local", "pooled", "_c", "bin")


def repair_interval(p6: ColumnLike, p8: ColumnLike) -> tuple[Column, Column, Column]:
    """(p6, p8, violated) with 0 <= p6 <= p8 <= 1; a violating pair meets in the middle."""
    a, b = clip(p6, 0.0, 1.0), clip(p8, 0.0, 1.0)
    bad, middle = a > b, 0.5 * (a + b)
    return F.when(bad, middle).otherwise(a), F.when(bad, middle).otherwise(b), bad


def interval_utility(p6: ColumnLike, p8: ColumnLike, expected_error: ColumnLike) -> Column:
    return -0.5 * clip(expected_error, 0.0, 1.20) + 0.5 * (0.25 * col(p6) + 0.75 * col(p8))


def interval_utilities(p6: np.ndarray, p8: np.ndarray, expected_error: np.ndarray) -> np.ndarray:
    """:func:`repair_interval` and :func:`interval_utility` on whole arrays, for kernels that hold rows x actions."""
    a, b = np.clip(p6, 0.0, 1.0), np.clip(p8, 0.0, 1.0)
    bad, middle = a > b, 0.5 * (a + b)
    return -0.5 * np.clip(expected_error, 0.0, 1.20) + 0.5 * (0.25 * np.where(bad, middle, a) + 0.75 * np.where(bad, middle, b))


def on_grid(utilities: np.ndarray, known: np.ndarray, base_cf: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, action, utility) of rows x actions: best within the tie tolerance, nearest to the baseline, then lower.

    As in Spark, not-a-number is the largest utility, an unknown one is left out, and without a baseline the lower action stands.
    """
    odd = known & np.isnan(utilities)
    top = np.where(known & ~odd, utilities, -np.inf).max(axis=1, keepdims=True)
    tied = np.where(odd.any(axis=1, keepdims=True), odd, known & (utilities >= top - TIE))
    gap = np.abs(grid - base_cf[:, None])
    gap = np.where(tied, np.where(np.isnan(gap), 0.0, gap), np.inf)
    tied &= gap <= gap.min(axis=1, keepdims=True)
    action = np.where(tied, grid, np.inf).min(axis=1)
    at = (tied & (grid == action[:, None])).argmax(axis=1)
    return tied.any(axis=1), action, utilities[np.arange(len(at)), at]


def choose_on_grid(utilities: ColumnLike | Callable[..., np.ndarray], base_cf: ColumnLike, grid: Sequence[float] = ACTION_GRID, inputs: Sequence[ColumnLike] = ()) -> Column:
    """Struct (action, utility) on a fixed grid: best within the tie tolerance, nearest to the baseline, then lower.

    ``utilities`` is a list column, or a kernel that forms them (rows x actions, not-a-number where there is none) from blocks of the
    ``inputs``, so that no list leaves the task's cache.
    """
    actions, kernel = np.asarray(grid, float), utilities if callable(utilities) and not isinstance(utilities, Column) else None
    step = max(1, _DENSE_CELLS // len(grid))

    @F.arrow_udf(_GRID_CHOICE)
    def choose(given: pa.Array, base: pa.Array) -> pa.Array:
        numbers = lambda x: x.cast(pa.float64()).to_numpy(zero_copy_only=False)
        places, b = np.arange(len(given)), numbers(base)
        if kernel is None:
            places = np.flatnonzero(given.is_valid())
            flat = given.flatten()
            if len(flat) != len(actions) * len(places):
                raise ValueError("every action of the grid needs a utility")
            u, known = (x.reshape(-1, len(actions)) for x in (numbers(flat), np.asarray(flat.is_valid())))
        else:
            parts = [numbers(x) for x in given.flatten()]
        found, action, utility = np.zeros(len(given), bool), np.full(len(given), np.nan), np.full(len(given), np.nan)
        for start in range(0, len(places), step):
            at, block = places[start:start + step], slice(start, start + step)
            if kernel is None:
                rows, there = u[block], known[block]
            else:
                rows = kernel(*(x[block] for x in parts))
                there = ~np.isnan(rows)
            found[at], action[at], utility[at] = on_grid(rows, there, b[at], actions)
        return pa.StructArray.from_arrays([pa.array(action), pa.array(utility)], names=["action", "utility"], mask=pa.array(~found))

    given = F.struct(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(inputs)]) if kernel else col(utilities)
    return choose(given, col(base_cf).cast("double"))


def interpolate_utility(utilities: ColumnLike, cf: ColumnLike) -> Column:
    """Linear value of a utility row on the fixed 0.01 grid."""
    at = 100.0 * clip(cf, *ACTION_BOUNDS)
    lower = F.floor(at).cast("int")
    upper = F.least(lower + 1, F.lit(len(ACTION_GRID) - 1))
    share = at - lower
    return (1.0 - share) * F.element_at(col(utilities), lower + 1) + share * F.element_at(col(utilities), upper + 1)


def selective_scale(baseline: ColumnLike, utilities: ColumnLike, capacity: ColumnLike) -> dict[str, Column]:
    """Apply the 0.98 action only where it gains more than the margin."""
    cf = col(baseline) / col(capacity)
    gain = interpolate_utility(utilities, SELECTIVE_FACTOR * cf) - interpolate_utility(utilities, cf)
    gate = gain > SELECTIVE_MARGIN
    kwh = clip(F.when(gate, SELECTIVE_FACTOR * cf).otherwise(cf) * col(capacity), 0.0, ACTION_BOUNDS[1] * col(capacity))
    return {"utility_advantage": gain, "gate": gate, "candidate": kwh}


def leaf_rows(df: DataFrame, leaves: str, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, F.posexplode(leaves).alias("tree", "leaf"))


def forest_means(fit: DataFrame, query: DataFrame, leaves: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Forest-weighted mean of fit values for every query row.

    The weight of a fit row is the mean over trees of 1 / leaf size where both share the leaf, so the weighted mean is
    the mean over trees of the leaf mean: leaves are averaged once and query rows join leaves, never fit rows.
    """
    per_leaf = leaf_rows(fit, leaves, values).groupBy("tree", "leaf").agg(
        F.count(F.lit(1)).alias("leaf_size"), *[F.avg(v).alias(f"_l_{v}") for v in values])
    rows = leaf_rows(query, leaves, keys).join(per_leaf, ["tree", "leaf"])
    trees = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(
        trees.alias("trees"), F.sum("leaf_size").alias("members"),
        *[(F.sum(f"_l_{v}") / trees).alias(f"forest_{v}") for v in values])


def _leaf_utility(residuals: np.ndarray, base: np.ndarray, steps: np.ndarray, mean: float) -> np.ndarray:
    """(queries, steps): sum over ascending residuals of -|a - y| + y price / (4 mean), a and y clipped around each base.

    Outcomes ascend with the residuals, so the members within a price edge of an action are one stretch.  Its ends are looked up among the
    residuals; where some lie so near an end that rounding decides, the comparison itself does.  Sums over stretches come from running totals.
    """
    n, b = len(residuals), base[:, None]
    low, high = OUTCOME_BOUNDS
    action = np.clip(b + steps, *ACTION_BOUNDS)

    def first(holds: Callable[[np.ndarray, np.ndarray], np.ndarray], edge: float) -> np.ndarray:
        """Number of the first outcome for which ``holds``, which is false below action + edge and true above; n if none."""
        near = action - b + edge
        start = np.searchsorted(residuals, near - ROUNDING)
        unsure = residuals[np.minimum(start, n - 1)] <= near + ROUNDING
        never, always = ~holds(high, action), holds(low, action)
        start[never], start[always] = n, 0
        if missing := np.isnan(residuals[-1]):  # missing residuals stand last and hold nothing
            start[:], unsure[:] = 0, True
        at = np.nonzero(unsure if missing else unsure & ~never & ~always & (start < n))
        if len(at[0]):  # bisection between the places surely below and surely above
            own, acted = base[at[0]], action[at]
            lo, hi = start[at], np.full(len(at[0]), n) if missing else np.searchsorted(residuals, near[at] + ROUNDING, side="right")
            while (lo < hi).any():
                middle = (lo + hi) // 2
                yes = (lo >= hi) | holds(np.clip(own + residuals[np.minimum(middle, n - 1)], low, high), acted)
                lo, hi = np.where(yes, lo, middle + 1), np.where(yes & (lo < hi), middle, hi)
            start[at] = lo
        return start

    if n == 0:
        return np.zeros(action.shape)
    running = np.r_[0.0, np.cumsum(residuals)]
    under, over = np.searchsorted(residuals, low - base)[:, None], np.searchsorted(residuals, high - base, side="right")[:, None]

    def upto(i: np.ndarray) -> np.ndarray:
        """Sum of the first ``i`` outcomes."""
        inner = np.clip(i, under, over)
        return low * np.minimum(i, under) + running[inner] - running[under] + b * (inner - under) + high * np.maximum(i - over, 0)

    paid = [upto(first(lambda y, a: y - a > edge, edge)) - upto(first(lambda y, a: a - y <= edge, -edge)) for edge in (0.06, 0.08)]
    above = first(lambda y, a: y >= a, 0.0)
    distance = action * (2 * above - n) + upto(np.full_like(above, n)) - 2 * upto(above)
    return (3.0 * paid[1] + paid[0]) / (4.0 * mean) - distance


def run_parts(part_rows: int) -> int:
    """Parts of a leaf that one task takes."""
    return max(1, TASK_ROWS // part_rows)


def leaf_cuts(part_rows: int) -> dict[str, Column]:
    """Parts of a leaf's members, runs of parts and slices of its queries, by ``size`` and ``asked``."""
    return {"parts": F.ceil(F.col("size") / part_rows).cast("int"), "runs": F.ceil(F.ceil(F.col("size") / part_rows) / run_parts(part_rows)).cast("int"),
            "slices": F.ceil(F.col("asked") / max(part_rows, TASK_ROWS)).cast("int")}


def forest_action(fit: DataFrame, query: DataFrame, leaves: str, fit_keys: Sequence[str], keys: Sequence[str], residual: str,
                  base_cf: str, mean: float, deltas: Sequence[float] = ACTION_DELTAS, part_rows: int = 32_768) -> DataFrame:
    """Action under the forest's empirical residuals.

    Each leaf is cut into parts of bounded size by a hash of the row keys; a task meets a run of parts of a leaf, of TASK_ROWS rows or so, with
    the queries of one slice of it and returns one partial utility vector per query.  Residuals are sorted once and summed up to every
    place, so an action costs a few searches whatever the number of members; only where residuals are missing does each part stand for itself.
    """
    sizes = leaf_rows(fit, leaves, []).groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("size"))
    asked = leaf_rows(query, leaves, []).groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("asked"))
    plan = sizes.join(asked, ["tree", "leaf"]).withColumns(leaf_cuts(part_rows))
    run = F.floor(F.col("part") / run_parts(part_rows)).cast("int")
    members = leaf_rows(fit, leaves, [residual, *fit_keys]).join(plan, ["tree", "leaf"]).select(
        "tree", "leaf", residual, F.col("size").alias("leaf_size"), F.pmod(F.xxhash64(*fit_keys), F.col("parts")).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")).withColumn("run", run)
    queries = leaf_rows(query, leaves, [*keys, base_cf]).join(plan, ["tree", "leaf"]).select(
        "tree", "leaf", *keys, base_cf, F.pmod(F.xxhash64(*keys), F.col("slices")).cast("int").alias("slice"),
        F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"))
    cols = ["tree", "leaf", "run", "slice"]
    steps = np.asarray(deltas)

    def partial(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = right[list(keys)].copy()
        r, part = left[residual].to_numpy(float), left["part"].to_numpy()
        cut = [np.sort(r[part == p]) for p in np.unique(part)] if np.isnan(r).any() else [np.sort(r)]
        rows = []
        block = max(1, _DENSE_CELLS // len(steps))
        base = right[base_cf].to_numpy(float)
        for start in range(0, len(base), block):
            total = sum(_leaf_utility(c, base[start:start + block], steps, mean) for c in cut)
            rows.append(total / left["leaf_size"].iloc[0] if len(r) else total)
        out["u"] = list(np.concatenate(rows)) if rows else []
        return out

    schema = T.StructType([query.schema[k] for k in keys] + [T.StructField("u", T.ArrayType(T.DoubleType()))])
    parts = members.groupBy(*cols).cogroup(queries.groupBy(*cols)).applyInPandas(partial, schema)
    trees = F.size(leaves)
    summed = parts.groupBy(*keys).agg(*[F.sum(F.element_at("u", i + 1)).alias(f"_u{i}") for i in range(len(deltas))])
    rows = summed.join(query.select(*keys, base_cf, trees.alias("_t")), list(keys))
    utilities = F.array(*[F.col(f"_u{i}") / F.col("_t") for i in range(len(deltas))])
    rows = rows.select(*keys, base_cf, utilities.alias("_u"))
    top = F.array_max("_u")
    options = F.zip_with(literal_array(deltas), F.col("_u"), lambda d, u: F.struct(F.abs(d).alias("d"), d.alias("delta"), u.alias("utility")))
    best = F.array_min(F.filter(options, lambda o: o["utility"] >= top - TIE))
    return rows.select(*keys, base_cf, best["delta"].alias("delta"), best["utility"].alias("utility"))
