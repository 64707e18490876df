"""Nearest cells, inverse-distance weights, turbine aggregation, layout, wake, terrain and grid sampling."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add, and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.functions.exprs import ColumnLike, col
from windrow.functions.geo import EARTH_KM, EARTH_M, bearing, displacement_m, haversine_km, local_xy_km
from windrow.functions.ranks import exact_quantiles
from windrow.functions.wind import sector, upwind_bearing
from windrow.operators.lookups import attach
from windrow.session import checkpoint, spread

# fixed values
DISTANCE_FLOOR_KM = 0.05
IDW_POWER = 2.0
WAKE_EXPANSION = 0.05
WAKE_LOSS_SCALE = 0.08
WAKE_ACTIVE = 0.10
SECTORS = 16
SECTOR_HALF_WIDTH = 11.25
HORIZON_RADII_M = (500.0, 1000.0, 2000.0, 5000.0)
MIN_HORIZON_DISTANCE_M = 100.0
#: cells a tile of the nearest-cell pyramid holds at most, halvings of the tiles to get there, kilometres added to a bound before it rules a tile out
TILE_CELLS, TILE_HALVINGS, TILE_SLACK_KM = 32, 12, 1e-6
#: sites that interpolation keeps in one block
SITE_BLOCK = 64
#: turbine values the wake kernel holds at a time
WAKE_CELLS = 250_000


def _tile(value: ColumnLike, size: float) -> Column:
    return F.floor(col(value) / size).cast("bigint")


def tile_pyramid(cells: DataFrame, tile: float, levels: int) -> DataFrame:
    """(level, ty, tx, n): how many cells lie in every occupied tile; a level's tiles are twice as wide as those below."""
    base = cells.groupBy(_tile("lat", tile).alias("ty"), _tile("lon", tile).alias("tx")).agg(F.count(F.lit(1)).alias("n"))
    every = base.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).cast("bigint").alias(c)
    return every.select("level", up("ty"), up("tx"), "n").groupBy("level", "ty", "tx").agg(F.sum("n").alias("n"))


def _tile_bounds(size: float) -> tuple[Column, Column]:
    """No point of tile (ty, tx) is nearer to (lat, lon) than the first or farther than the second, in kilometres: the distance to its
    middle less or more than the way from there to a corner along meridian and parallel."""
    lat, lon = (F.col("ty") + 0.5) * size, (F.col("tx") + 0.5) * size
    widest = F.greatest(F.abs(lat) - size / 2, F.lit(0.0))
    radius = EARTH_KM * math.radians(size / 2) * (1.0 + F.cos(F.radians(F.least(widest, F.lit(90.0)))))
    middle = haversine_km("lat", "lon", lat, lon)
    return middle - radius, middle + radius


def opened_cells(sites: DataFrame, cells: DataFrame, k: int, site: str, cell: str, tile: float | None = None, exclude_self: bool = False) -> DataFrame:
    """(site, lat, lon, cell, _lat, _lon): cells among which the k nearest of every site are; all but these are ruled out by tiles.

    A descent of a pyramid of tiles: on each level the counts and farthest points of a site's tiles bound its k-th distance, and
    only tiles that begin within it are divided further, so a site far from all cells opens as few as one among them.
    """
    need = k + exclude_self
    extent = cells.agg((F.max("lat") - F.min("lat")).alias("dlat"), (F.max("lon") - F.min("lon")).alias("dlon"), F.count(F.lit(1)).alias("n")).first()
    side = max(extent["dlat"] or 0.0, extent["dlon"] or 0.0, 1e-6)
    tile = tile or max(2.0 * side / max(extent["n"], 1) ** 0.5, 1e-6)
    for _ in range(TILE_HALVINGS):  # crowded places get smaller tiles
        most = tile_pyramid(cells, tile, 0).agg(F.max("n")).first()[0] or 0
        if most <= max(TILE_CELLS, need):
            break
        tile /= 2.0
    levels = max(0, math.ceil(math.log2(side / tile))) + 1 if side > tile else 0
    counts = checkpoint(tile_pyramid(cells, tile, levels))
    tops = [(r["ty"], r["tx"], r["n"]) for r in counts.where(F.col("level") == levels).collect()]  # two by two at most
    kinds = "array<struct<ty:bigint,tx:bigint,n:bigint>>"
    rows = sites.select(site, "lat", "lon", F.inline(F.array(*[F.struct(*map(F.lit, t)) for t in tops]).cast(kinds)))
    for level in range(levels, -1, -1):
        near, far = _tile_bounds(tile * 2**level)
        # a site has few tiles on a level
        order = Window.partitionBy(site).orderBy("_far", "ty", "tx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        enough = F.min(F.when(F.col("_sum") >= need, F.col("_far"))).over(Window.partitionBy(site))
        ranked = rows.withColumns({"_near": near, "_far": far}).withColumn("_sum", F.sum("n").over(order)).withColumn("_most", enough)
        kept = ranked.where(F.col("_most").isNull() | (F.col("_near") <= F.col("_most") + TILE_SLACK_KM)).select(site, "lat", "lon", "ty", "tx")
        if level:
            split = kept.withColumn("_dy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_dx", F.explode(F.array(F.lit(0), F.lit(1))))
            below = split.select(site, "lat", "lon", (2 * F.col("ty") + F.col("_dy")).alias("ty"), (2 * F.col("tx") + F.col("_dx")).alias("tx"))
            rows = below.join(counts.where(F.col("level") == level - 1).drop("level"), ["ty", "tx"])
            if level % 4 == 0:
                rows = checkpoint(rows)
    grid = cells.select(F.col(cell).alias("_cell"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), _tile("lat", tile).alias("ty"), _tile("lon", tile).alias("tx"))
    found = kept.join(grid, ["ty", "tx"]).drop("ty", "tx")
    return found.where(F.col("_cell") != F.col(site)) if exclude_self else found


def nearest_cells(sites: DataFrame, cells: DataFrame, k: int, site: str = "turbine_id", cell: str = "grid_id",
                  tile: float | None = None, exclude_self: bool = False) -> DataFrame:
    """The exact k nearest cells of every site: (site, cell, distance_km, rank).

    Cells and sites meet on the tiles that :func:`opened_cells` leaves, not by a cross join.  Ties go to the smaller cell id.
    """
    found = opened_cells(sites, cells, k, site, cell, tile, exclude_self).withColumn("distance_km", haversine_km("lat", "lon", "_lat", "_lon"))
    w = Window.partitionBy(site).orderBy(F.round("distance_km", 9), "_cell")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(site, F.col("_cell").alias(cell), "distance_km", "rank")


def idw_weights(near: DataFrame, site: str = "turbine_id", floor_km: float = DISTANCE_FLOOR_KM, power: float = IDW_POWER,
                bounded: bool = False) -> DataFrame:
    """Weights that sum to one per site: 1 / (d + floor)^p, or 1 / max(d, floor)^p with ``bounded``."""
    d = F.greatest(F.col("distance_km"), F.lit(floor_km)) if bounded else F.col("distance_km") + floor_km
    raw = near.withColumn("_w", 1.0 / F.pow(d, F.lit(power)))
    return raw.withColumn("weight", F.col("_w") / F.sum("_w").over(Window.partitionBy(site))).drop("_w")


def site_blocks(weights: DataFrame, site: str, cell: str, static: DataFrame | None = None, group: Sequence[str] = (), how: str = "left") -> DataFrame:
    """One row per site (and row of ``static`` about it) with its ``_near`` cells and its block (``_home``, ``_salt``) of SITE_BLOCK sites or so.

    Sites whose groups begin in the same cell share a block, as they share cells; a group stays in one block unless it is larger than that.
    """
    near = F.struct(F.col(cell).alias("cell"), F.col("weight").alias("w"), F.col("rank").alias("rank"))
    places = weights.where(F.col(cell).isNotNull()).groupBy(site).agg(
        F.collect_list(near).alias("_near"), F.min_by(F.col(cell), F.struct("rank", cell)).alias("_own"))
    if static is not None:
        places = places.join(static, site, how)
    places = checkpoint(places)  # read by the groups and by their sites
    keys = list(group) or [site]
    groups = places.groupBy(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]).agg(F.min("_own").alias("_home"), F.count(F.lit(1)).alias("_n"))
    blocks = groups.join(groups.groupBy("_home").agg(F.sum("_n").alias("_all")), "_home")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)])
    part = F.pmod(F.xxhash64(site), F.ceil(F.col("_n") / SITE_BLOCK))
    salt = F.pmod(F.xxhash64(*keys, part), F.ceil(F.col("_all") / SITE_BLOCK)).alias("_salt")
    return places.join(blocks, same).select(*[c for c in places.columns if c != "_own"], "_home", salt)


def interpolate(df: DataFrame, weights: DataFrame, values: Sequence[str], ts: str = "forecast_ts", site: str = "turbine_id",
                cell: str = "grid_id", near_k: int | None = None, static: DataFrame | None = None, group: Sequence[str] = (), how: str = "left") -> DataFrame:
    """Weighted value, nearest value and (with ``near_k``) spread over the near cells per hour and site.

    Hours of cells are shuffled, never hours of sites: a cell's rows are sent once to every block of sites that needs them, and the sites
    of a block unfold where its cells meet.  ``static`` adds its columns about the sites as a join would, without a shuffle of its own;
    sites of one ``group`` then lie in one task, so totals per hour and group fold before they are shuffled.
    """
    kept = [] if static is None else [c for c in static.columns if c != site]
    places = checkpoint(site_blocks(weights, site, cell, static, group, how))  # read by the cells needed and by the blocks
    need = places.select("_home", "_salt", F.explode("_near.cell").alias(cell)).distinct()
    rows = spread(attach(df.select(ts, cell, *values), need, [cell], "inner"), "_home", "_salt")
    # moments of a cell's rows of an hour: one row as a rule
    moments = [e for i, v in enumerate(values) for e in (F.sum(F.col(v).cast("double")).alias(f"s{i}"), F.max(v).alias(f"m{i}"))]
    if near_k:
        moments += [e for i, v in enumerate(values) for e in (F.count(v).cast("double").alias(f"n{i}"), F.var_pop(v).alias(f"v{i}"))]
    here = rows.groupBy("_home", "_salt", ts, F.col(cell).alias("_cell")).agg(F.struct(*moments).alias("_v"))
    hours = here.groupBy("_home", "_salt", ts).agg(F.map_from_entries(F.collect_list(F.struct("_cell", "_v"))).alias("_at"))
    blocks = places.groupBy("_home", "_salt").agg(F.collect_list(F.struct(site, *kept, "_near")).alias("_sites"))
    each = hours.join(blocks, ["_home", "_salt"]).select(ts, "_at", F.inline("_sites"))
    most = places.agg(F.max(F.size("_near"))).first()[0] or 1  # near cells of a site, few
    near = [F.get("_near", F.lit(i)) for i in range(most)]
    each = each.select(ts, site, *kept, *[e for i, n in enumerate(near) for e in (
        F.try_element_at("_at", n["cell"]).alias(f"_e{i}"), n["w"].alias(f"_w{i}"), n["rank"].alias(f"_r{i}"))])
    each = each.where(F.coalesce(*[F.col(f"_e{i}") for i in range(most)]).isNotNull())

    def total(parts: list[Column]) -> Column:
        return F.when(F.coalesce(*parts).isNotNull(), reduce(add, [F.coalesce(p, F.lit(0.0)) for p in parts]))

    def nearest(i: int) -> Column:
        # the filter changes nothing, but keeps this wide projection out of whole-stage code, whose one method would be too long to be compiled
        return F.array_max(F.filter(F.array(*[F.when(F.col(f"_r{j}") == 1, F.col(f"_e{j}")[f"m{i}"]) for j in range(most)]), lambda m: m.isNotNull()))

    def deviation(i: int) -> Column:
        sums, counts, spreads = ([F.when(F.col(f"_r{j}") <= near_k, F.col(f"_e{j}")[f"{t}{i}"]) for j in range(most)] for t in "snv")
        n = F.nullif(total(counts), F.lit(0.0))
        mean = total(sums) / n
        gaps = [s / F.nullif(c, F.lit(0.0)) - mean for s, c in zip(sums, counts)]
        return F.sqrt(total([c * (v + g * g) for c, v, g in zip(counts, spreads, gaps)]) / n)

    out = [total([F.col(f"_w{j}") * F.col(f"_e{j}")[f"s{i}"] for j in range(most)]).alias(f"idw__{v}") for i, v in enumerate(values)]
    out += [nearest(i).alias(f"nearest__{v}") for i, v in enumerate(values)]
    if near_k:
        out += [deviation(i).alias(f"near{near_k}_std__{v}") for i, v in enumerate(values)]
    return each.select(ts, site, *kept, *out)


def spatial_summary(df: DataFrame, variables: Sequence[str], wind: Sequence[str], ts: str = "forecast_ts") -> DataFrame:
    """Mean and population spread of every variable and the extremes of the wind variables over all grids per hour."""
    return df.groupBy(ts).agg(
        *[F.avg(v).alias(f"global_mean__{v}") for v in variables],
        *[F.stddev_pop(v).alias(f"global_std__{v}") for v in variables],
        *[F.min(v).alias(f"global_min__{v}") for v in wind], *[F.max(v).alias(f"global_max__{v}") for v in wind],
    )


def capacity_statistics(df: DataFrame, keys: Sequence[str], value: str, weight: str = "capacity_mw") -> DataFrame:
    """Capacity-weighted mean, spread and range over turbines; additive, so it aggregates partially."""
    out = df.groupBy(*keys).agg(
        F.sum(weight).alias("_w"), F.sum(F.col(weight) * F.col(value)).alias("_wx"),
        F.sum(F.col(weight) * F.col(value) * F.col(value)).alias("_wxx"), F.max(value).alias("_hi"), F.min(value).alias("_lo"),
    )
    mean = F.col("_wx") / F.col("_w")
    return out.select(
        *keys, mean.alias(f"{value}__cw_mean"),
        F.sqrt(F.greatest(F.col("_wxx") / F.col("_w") - mean * mean, F.lit(0.0))).alias(f"{value}__cw_std"),
        (F.col("_hi") - F.col("_lo")).alias(f"{value}__range"),
    )


def capacity_weighted(df: DataFrame, keys: Sequence[str], values: Sequence[str], weight: str = "capacity_mw") -> DataFrame:
    """Capacity-weighted mean with the weights renormalised over the sites that have a value; null if none has."""
    return df.groupBy(*keys).agg(*[
        (F.sum(F.col(weight) * F.col(v)) / F.nullif(F.sum(F.when(F.col(v).isNotNull(), F.col(weight))), F.lit(0.0))).alias(v)
        for v in values
    ])


def turbine_layout(turbines: DataFrame, farm: str = "farm", turbine: str = "turbine_id") -> DataFrame:
    """Static arrays per farm in turbine order: capacity share and local plane position in km."""
    packed = turbines.groupBy(farm).agg(
        F.sort_array(F.collect_list(F.struct(turbine, "lat", "lon", "capacity_mw", "rotor_m"))).alias("t")
    )
    total = F.aggregate("t", F.lit(0.0), lambda a, r: a + r["capacity_mw"])
    packed = packed.withColumn("total_mw", total)
    packed = packed.withColumn("w", F.transform("t", lambda r: r["capacity_mw"] / F.col("total_mw")))

    def mean(field: str) -> Column:
        return F.aggregate(F.zip_with("t", "w", lambda r, s: r[field] * s), F.lit(0.0), lambda a, x: a + x)

    packed = packed.withColumns({"lat0": mean("lat"), "lon0": mean("lon"), "rotor_m": mean("rotor_m")})
    return packed.select(
        farm, "w", "total_mw", "rotor_m", F.transform("t", lambda r: r[turbine]).alias("turbines"),
        F.transform("t", lambda r: local_xy_km(r["lat"], r["lon"], F.col("lat0"), F.col("lon0"))[0]).alias("x"),
        F.transform("t", lambda r: local_xy_km(r["lat"], r["lon"], F.col("lat0"), F.col("lon0"))[1]).alias("y"),
    )


def _hull(points: np.ndarray) -> np.ndarray:
    """Convex hull (monotone chain): the two ends of the largest distance are always on it."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(sequence) -> list:
        out: list = []
        for p in sequence:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def layout_extent(turbines: DataFrame, farm: str = "farm", salt: int = 16) -> DataFrame:
    """Largest distance between two turbines of a farm.  Hulls are formed per salted part first and per farm from the
    parts' hulls, so neither a large farm nor its pairs end up in one task."""
    centre = turbines.groupBy(farm).agg(
        (F.sum(F.col("capacity_mw") * F.col("lat")) / F.sum("capacity_mw")).alias("lat0"),
        (F.sum(F.col("capacity_mw") * F.col("lon")) / F.sum("capacity_mw")).alias("lon0"),
    )
    x, y = local_xy_km("lat", "lon", "lat0", "lon0")
    points = attach(turbines, centre, [farm]).select(
        farm, x.alias("x"), y.alias("y"), F.pmod(F.xxhash64("lat", "lon"), F.lit(salt)).cast("int").alias("_salt"))

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = _hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({farm: [pdf[farm].iloc[0]] * len(hull), "x": hull[:, 0], "y": hull[:, 1]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = _hull(pdf[["x", "y"]].to_numpy())
        far = max(float(np.sqrt(((hull - p) ** 2).sum(axis=1).max())) for p in hull)
        return pd.DataFrame({farm: [pdf[farm].iloc[0]], "layout_extent_km": [far]})

    kind = turbines.schema[farm].dataType.simpleString()
    hulls = points.groupBy(farm, "_salt").applyInPandas(part, f"{farm} {kind}, x double, y double")
    return hulls.groupBy(farm).applyInPandas(whole, f"{farm} {kind}, layout_extent_km double")


def grid_spacing(cells: DataFrame, cell: str = "grid_id", tile: float = 0.1) -> DataFrame:
    """One row with the median distance of a cell to its nearest other cell."""
    near = nearest_cells(cells.withColumn("_self", F.col(cell)).drop(cell), cells, 1, "_self", cell, tile, exclude_self=True)
    q = exact_quantiles(near.withColumn("_k", F.lit(1)), ["_k"], "distance_km", [0.5])
    return q.select(F.col("q")[0].alias("grid_spacing_median_km"))


def layout_constants(turbines: DataFrame, near: DataFrame, spacing: DataFrame, farm: str = "farm",
                     turbine: str = "turbine_id") -> DataFrame:
    """Nearest and effective grid distances, spacing ratio, turbine count, capacity and extent per farm."""
    weights = idw_weights(near, turbine)
    per = weights.groupBy(turbine).agg(
        F.min("distance_km").alias("nearest"), F.sum(F.col("weight") * F.col("distance_km")).alias("effective"))
    rows = turbines.join(per, turbine)
    cap = F.col("capacity_mw")
    out = rows.groupBy(farm).agg(
        F.sum(cap).alias("capacity_mw"), F.count(F.lit(1)).alias("turbine_count"),
        (F.sum(cap * F.col("nearest")) / F.sum(cap)).alias("nearest_distance_cw_mean_km"),
        F.max("nearest").alias("nearest_distance_max_km"),
        (F.sum(cap * F.col("nearest") * F.col("nearest")) / F.sum(cap)).alias("_sq"),
        (F.sum(cap * F.col("effective")) / F.sum(cap)).alias("idw_effective_distance_cw_mean_km"),
    )
    mean = F.col("nearest_distance_cw_mean_km")
    median = spacing.scalar()
    return (
        out.withColumn("nearest_distance_std_km", F.sqrt(F.greatest(F.col("_sq") - mean * mean, F.lit(0.0)))).drop("_sq")
        .withColumn("grid_spacing_median_km", median)
        .withColumn("nearest_distance_over_grid_spacing", mean / F.greatest(F.col("grid_spacing_median_km"), F.lit(1e-6)))
        .join(layout_extent(turbines, farm), farm)
    )


WAKE_FIELDS = ("flow_speed", "downwind_span_km", "crosswind_span_km", "upstream_edge_ws", "downstream_edge_ws",
               "downstream_minus_upstream_ws", "projection_ws_correlation", "wake_pair_mean", "wake_pair_max",
               "wake_active_fraction", "wake_receiver_cw_mean", "wake_receiver_max", "wake_effective_ws_cw_mean",
               "wake_power_loss_proxy")


def _wake_block(u, v, x, y, w, rotor_km) -> dict[str, np.ndarray]:
    """Wake numbers of rows with n turbines each; all arrays are (rows, n).

    Places are turned into flow coordinates once, so the separation of two turbines is a difference of their coordinates.  The
    turbines then shed their wakes one after the other on all others, and only running totals are kept: memory stays at
    rows x n.
    """
    n = x.shape[1]
    weighted = lambda a: np.einsum("ij,ij->i", w, a)
    east, north = weighted(u), weighted(v)
    flow = np.hypot(east, north)
    unit = np.where(flow > 1e-5, flow, np.inf)
    east, north = (east / unit)[:, None], (north / unit)[:, None]
    down, across = east * x + north * y, east * y - north * x
    ws, rotor = np.hypot(u, v), rotor_km[:, None]
    deficit, strongest, active = np.zeros_like(ws), np.zeros(len(ws)), np.zeros(len(ws))
    for source in range(n):
        gap = np.maximum(down - down[:, [source]], 0.0)
        growth = WAKE_EXPANSION * gap
        offset = (across - across[:, [source]]) / np.maximum(0.5 * rotor + growth, 1e-6)
        shade = np.where(gap > 0.0, np.exp(-offset * offset) / (1.0 + growth / rotor) ** 2, 0.0)
        deficit += shade
        strongest = np.maximum(strongest, shade.max(axis=1))
        active += np.count_nonzero(shade > WAKE_ACTIVE, axis=1)
    pairs = max(n * (n - 1), 1)
    out = {"flow_speed": flow, "downwind_span_km": np.ptp(down, axis=1), "crosswind_span_km": np.ptp(across, axis=1)}
    order, row = np.round(down, 12), np.arange(len(ws))
    out["upstream_edge_ws"], out["downstream_edge_ws"] = ws[row, order.argmin(axis=1)], ws[row, order.argmax(axis=1)]
    out["downstream_minus_upstream_ws"] = out["downstream_edge_ws"] - out["upstream_edge_ws"]
    place, pace = (a - weighted(a)[:, None] for a in (down, ws))
    spread = np.maximum(weighted(place * place), 1e-8) * np.maximum(weighted(pace * pace), 1e-8)
    out["projection_ws_correlation"] = weighted(place * pace) / np.sqrt(spread)
    out |= {"wake_pair_mean": deficit.sum(axis=1) / pairs, "wake_pair_max": strongest, "wake_active_fraction": active / pairs}
    out |= {"wake_receiver_cw_mean": weighted(deficit), "wake_receiver_max": deficit.max(axis=1)}
    left = ws * np.maximum(1.0 - WAKE_LOSS_SCALE * deficit, 0.0)
    free = weighted(ws ** 3)
    out |= {"wake_effective_ws_cw_mean": weighted(left), "wake_power_loss_proxy": (free - weighted(left ** 3)) / np.maximum(free, 1e-6)}
    return out


@F.pandas_udf(T.StructType([T.StructField(f, T.DoubleType()) for f in WAKE_FIELDS]))
def _wake(u: pd.Series, v: pd.Series, x: pd.Series, y: pd.Series, w: pd.Series, rotor_m: pd.Series) -> pd.DataFrame:
    out = np.full((len(u), len(WAKE_FIELDS)), np.nan)
    size = u.map(len).to_numpy()
    for n in np.unique(size):
        alike = np.flatnonzero(size == n)
        step = max(1, WAKE_CELLS // max(int(n), 1))
        for start in range(0, len(alike), step):
            at = alike[start:start + step]
            block = _wake_block(*(np.stack(s.iloc[at].to_numpy()) for s in (u, v, x, y, w)), rotor_m.iloc[at].to_numpy() / 1000.0)
            out[at] = np.column_stack([block[f] for f in WAKE_FIELDS])
    return pd.DataFrame(out, columns=list(WAKE_FIELDS))


def wake_features(df: DataFrame, turbines: DataFrame, u: str, v: str, ts: str = "forecast_ts", farm: str = "farm",
                  turbine: str = "turbine_id") -> DataFrame:
    """Directional layout features per hour and farm.  Turbines of one hour are packed into one row; the pairs live only
    inside the vectorised kernel and are never rows.  Rows that name their farm already are taken as they are."""
    layout = turbine_layout(turbines, farm, turbine)
    rows = df if farm in df.columns else attach(df, turbines.select(turbine, farm), [turbine], "inner")
    packed = rows.groupBy(ts, farm).agg(F.sort_array(F.collect_list(F.struct(turbine, u, v))).alias("p"))
    ready = attach(packed, layout, [farm], "inner").withColumns({
        "_u": F.transform("p", lambda r: r[u]), "_v": F.transform("p", lambda r: r[v])})
    return ready.select(ts, farm, _wake("_u", "_v", "x", "y", "w", "rotor_m").alias("k")).select(ts, farm, "k.*")


def turbine_places(turbines: DataFrame, farm: str = "farm", turbine: str = "turbine_id") -> DataFrame:
    """(farm, turbine, w, x, y): capacity share and local position of every turbine."""
    return turbine_layout(turbines, farm, turbine).select(farm, F.inline(F.arrays_zip("turbines", "w", "x", "y"))).withColumnRenamed("turbines", turbine)


def flow_projection(df: DataFrame, turbines: DataFrame, u: str, v: str, ts: str = "forecast_ts", farm: str = "farm",
                    turbine: str = "turbine_id") -> DataFrame:
    """``df`` with the farm and ``projection``: each turbine's place along the farm's capacity-weighted mean flow, in km.

    Rows that hold their turbine's place already are taken as they are.  The flow is a total over a farm hour.
    """
    rows = df if {farm, "w", "x", "y"} <= set(df.columns) else attach(df, turbine_places(turbines, farm, turbine), [turbine], "inner")
    hour = Window.partitionBy(ts, farm)
    rows = rows.where(F.col(ts).isNotNull() & F.col(farm).isNotNull())
    rows = rows.withColumns({"_mu": F.sum(F.col("w") * F.col(u)).over(hour), "_mv": F.sum(F.col("w") * F.col(v)).over(hour)})
    along = (F.col("_mu") * F.col("x") + F.col("_mv") * F.col("y")) / F.greatest(F.hypot("_mu", "_mv"), F.lit(1e-5))
    return rows.withColumn("projection", along).drop("w", "x", "y", "_mu", "_mv")


def edge_speeds(df: DataFrame, keys: Sequence[str], projection: ColumnLike, value: ColumnLike) -> DataFrame:
    """Value at the most upstream and the most downstream position."""
    return df.groupBy(*keys).agg(F.min_by(col(value), col(projection)).alias("upstream"),
                                 F.max_by(col(value), col(projection)).alias("downstream"))


def sector_statistics(static: DataFrame, values: Sequence[str], group: str = "farm", weight: str = "capacity_mw") -> DataFrame:
    """(group, sector) capacity-weighted mean and spread of a turbine x sector table.  The wind selects one sector for the
    whole group, so the table is reduced once and the hours join the small result."""
    keys = [group, "sector"]
    means = static.groupBy(*keys).agg(*[(F.sum(F.col(weight) * F.col(v)) / F.sum(weight)).alias(f"{v}_cw_mean") for v in values])
    rows = attach(static, means, keys, "inner")

    def spread(v: str) -> Column:
        gap = F.col(v) - F.col(f"{v}_cw_mean")
        return F.sqrt(F.sum(F.col(weight) * gap * gap) / F.sum(weight))

    return rows.groupBy(*keys).agg(*[e for v in values for e in (F.first(f"{v}_cw_mean").alias(f"{v}_cw_mean"), spread(v).alias(f"{v}_cw_std"))])


def directional_exposure(wind: DataFrame, static: DataFrame, values: Sequence[str], u: str, v: str, group: str = "farm") -> DataFrame:
    """Upwind sector of the flow -> the group's static values in that sector."""
    rows = wind.withColumn("sector", sector(upwind_bearing(u, v), SECTORS))
    return attach(rows, sector_statistics(static, values, group), [group, "sector"])


def _field(array: str, name: str) -> Column:
    return F.transform(array, lambda e: e[name])


def _shares(array: Column) -> Column:
    total = F.aggregate(array, F.lit(0.0), lambda p, q: p + q)
    return F.transform(array, lambda t: t / total)


def along_flow_alignment(wind: DataFrame, turbines: DataFrame, resources: Sequence[str], u: str, v: str, hub_ws: str,
                         atlas_ws: str, curve_weights: Sequence[str], group: str = "farm", turbine: str = "turbine_id") -> DataFrame:
    """Correlation of every static resource with the along-flow position, and resource-curve aggregates.

    The along-flow position is linear in the unit flow, so its covariances follow from five second moments per group and
    resource; only the power curve needs the turbines themselves, and takes them as arrays of a registered farm.
    """
    layout = turbine_layout(turbines, group, turbine)
    attrs = turbines.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(
        turbine, *[F.col(c) for c in dict.fromkeys([*resources, atlas_ws, *curve_weights])]))).alias("a"))
    base = layout.join(attrs, group)

    def dot(*arrays: Column) -> Column:
        merged = F.transform(F.arrays_zip(*[a.alias(f"c{i}") for i, a in enumerate(arrays)]), lambda r: _product(r, len(arrays)))
        return F.aggregate(merged, F.lit(0.0), lambda acc, t: acc + t)

    def _product(row: Column, n: int) -> Column:
        out = row["c0"]
        for i in range(1, n):
            out = out * row[f"c{i}"]
        return out

    w, x, y = F.col("w"), F.col("x"), F.col("y")
    moments = {"_xm": dot(w, x), "_ym": dot(w, y), "_xx": dot(w, x, x), "_yy": dot(w, y, y), "_xy": dot(w, x, y)}
    base = base.withColumns(moments)
    extra = {}
    for r in resources:
        v_r = _field("a", r)
        extra[f"_m_{r}"], extra[f"_q_{r}"] = dot(w, v_r), dot(w, v_r, v_r)
        extra[f"_cx_{r}"], extra[f"_cy_{r}"] = dot(w, x, v_r), dot(w, y, v_r)
    base = base.withColumns(extra)
    atlas = _field("a", atlas_ws)
    base = base.withColumn("_ratio", F.transform(atlas, lambda s: s / dot(w, atlas)))
    for c in curve_weights:
        raw = F.zip_with(w, _field("a", c), lambda a, b: a * b)
        base = base.withColumn(f"_cw_{c}", _shares(raw))
    rows = attach(wind, base.drop("a"), [group], "inner")
    s = F.hypot(u, v)
    ux, uy = F.when(s > 1e-8, F.col(u) / s).otherwise(0.0), F.when(s > 1e-8, F.col(v) / s).otherwise(0.0)
    rows = rows.withColumns({"_ux": ux, "_uy": uy})
    cxx = F.col("_xx") - F.col("_xm") * F.col("_xm")
    cyy = F.col("_yy") - F.col("_ym") * F.col("_ym")
    cxy = F.col("_xy") - F.col("_xm") * F.col("_ym")
    a, b = F.col("_ux"), F.col("_uy")
    along = F.sqrt(F.greatest(a * a * cxx + 2.0 * a * b * cxy + b * b * cyy, F.lit(0.0)))
    out = {}
    for r in resources:
        sd = F.sqrt(F.greatest(F.col(f"_q_{r}") - F.col(f"_m_{r}") * F.col(f"_m_{r}"), F.lit(0.0)))
        cov = a * (F.col(f"_cx_{r}") - F.col("_xm") * F.col(f"_m_{r}")) + b * (F.col(f"_cy_{r}") - F.col("_ym") * F.col(f"_m_{r}"))
        out[f"alignment__{r}"] = F.when(along > 1e-12, cov / along / F.greatest(sd, F.lit(1e-12))).otherwise(0.0)

    def curve(ratio: Column) -> Column:
        local = F.greatest(F.col(hub_ws) * ratio, F.lit(0.0))
        return F.greatest(F.least((local * local * local - 27.0) / (1728.0 - 27.0), F.lit(1.0)), F.lit(0.0))

    for name, weights in (("capacity", "w"), *[(c, f"_cw_{c}") for c in curve_weights]):
        out[f"resource_curve__{name}"] = F.aggregate(
            F.zip_with(F.col(weights), F.col("_ratio"), lambda wt, ratio: wt * curve(ratio)), F.lit(0.0), lambda acc, t: acc + t)
    return rows.select(*wind.columns, *[c.alias(n) for n, c in out.items()])


def expand_turbines(df: DataFrame, turbines: DataFrame, farm: str = "farm", turbine: str = "turbine_id") -> DataFrame:
    """Every hour of a farm x every turbine of that farm with static attributes, joined on the farm."""
    per = turbines.groupBy(farm).agg(F.min(turbine).alias("_first"), F.count(F.lit(1)).alias("_n"), F.avg("lat").alias("_lat"),
                                     F.avg("lon").alias("_lon"), F.sum("capacity_mw").alias("_cap"))
    w = Window.partitionBy(farm).orderBy(turbine)  # a farm is a bounded group
    dims = turbines.join(per, farm).select(
        farm, turbine, ((F.dense_rank().over(w) - 1.0) / F.greatest(F.col("_n") - 1, F.lit(1))).alias("turbine_index_fraction"),
        F.col("lat").alias("turbine_lat"), F.col("lon").alias("turbine_lon"), (F.col("lat") - F.col("_lat")).alias("lat_offset"),
        (F.col("lon") - F.col("_lon")).alias("lon_offset"), (F.col("capacity_mw") / F.col("_cap")).alias("capacity_fraction"),
    )
    return attach(df, dims, [farm], "inner")


def bilinear(points: DataFrame, cells: DataFrame, row: ColumnLike, column: ColumnLike, value: str, keys: Sequence[str],
             missing: float | None = None, wrap: int | None = None, rows: int | None = None) -> DataFrame:
    """Value at fractional lattice coordinates from the four surrounding cells; null if a corner is missing.

    Points unfold into their four corners and meet the cells on the lattice index, so any cell table size works.  ``wrap``
    is the number of columns of a lattice that goes around the globe, ``rows`` the number of rows: the last row serves as
    its own upper neighbour.
    """
    r0, c0 = F.floor(col(row)).cast("bigint"), F.floor(col(column)).cast("bigint")
    fr, fc = col(row) - F.floor(col(row)), col(column) - F.floor(col(column))
    corners = F.array(*[
        F.struct((r0 + i).alias("_r"), (c0 + j).alias("_c"),
                 ((fr if i else 1.0 - fr) * (fc if j else 1.0 - fc)).alias("_w")) for i in (0, 1) for j in (0, 1)])
    spread = points.select(*keys, F.inline(corners))
    if wrap:
        spread = spread.withColumn("_c", F.pmod(F.col("_c"), F.lit(wrap)))
    if rows:
        spread = spread.withColumn("_r", F.least(F.col("_r"), F.lit(rows - 1)))
    good = cells.select(F.col("row_no").alias("_r"), F.col("col_no").alias("_c"), F.col(value).alias("_v"))
    if missing is not None:
        good = good.where((F.col("_v") != missing) & (F.abs(F.col("_v")) <= 1e19))
    met = spread.join(good.where(F.col("_v").isNotNull()), ["_r", "_c"], "left")
    return met.groupBy(*keys).agg(
        F.when(F.count("_v") == F.count(F.lit(1)), F.sum(F.col("_w") * F.col("_v"))).alias(value))


def lattice_gradient(points: DataFrame, cells: DataFrame, row: ColumnLike, column: ColumnLike, lat: str, step_deg: float,
                     keys: Sequence[str]) -> DataFrame:
    """Central differences at the nearest lattice cell in metres: dz_dx (east) and dz_dy (north); rows run northward."""
    r, c = F.floor(col(row) + 0.5).cast("bigint"), F.floor(col(column) + 0.5).cast("bigint")
    sides = F.array(*[F.struct((r + i).alias("_r"), (c + j).alias("_c"), F.lit(s).alias("_s"))
                      for s, i, j in (("w", 0, -1), ("e", 0, 1), ("s", -1, 0), ("n", 1, 0))])
    met = points.select(*keys, lat, F.inline(sides)).join(
        cells.select(F.col("row_no").alias("_r"), F.col("col_no").alias("_c"), F.col("z").alias("_v")), ["_r", "_c"])
    side = lambda s: F.max(F.when(F.col("_s") == s, F.col("_v")))
    per_degree = math.pi * EARTH_M / 180.0
    out = met.groupBy(*keys).agg(F.first(lat).alias("_lat"), side("w").alias("_w"), side("e").alias("_e"),
                                 side("s").alias("_so"), side("n").alias("_no"))
    return out.select(
        *keys, ((F.col("_e") - F.col("_w")) / (2.0 * step_deg * per_degree * F.cos(F.radians("_lat")))).alias("dz_dx"),
        ((F.col("_no") - F.col("_so")) / (2.0 * step_deg * per_degree)).alias("dz_dy"))


def horizon_angles(turbines: DataFrame, pixels: DataFrame, elevation: DataFrame, tile: float = 0.05,
                   radii: Sequence[float] = HORIZON_RADII_M, turbine: str = "turbine_id") -> DataFrame:
    """(turbine, sector) largest elevation angle within every radius.

    Turbines unfold over the tiles their largest circle touches and meet pixels on the tile; distance, wedge and maximum
    follow in the same stage as the join, so pairs are reduced before they are shuffled.
    """
    pad = math.degrees(max(radii) / EARTH_M)
    lat_pad, lon_pad = F.lit(pad), F.lit(pad) / F.cos(F.radians("lat"))
    sites = turbines.join(elevation.select(turbine, F.col("z").alias("z0")), turbine).where(F.col("z0").isNotNull())
    reach = (
        sites.withColumn("_ty", F.explode(F.sequence(_tile(F.col("lat") - lat_pad, tile), _tile(F.col("lat") + lat_pad, tile))))
        .withColumn("_tx", F.explode(F.sequence(_tile(F.col("lon") - lon_pad, tile), _tile(F.col("lon") + lon_pad, tile))))
        .select(turbine, "lat", "lon", "z0", "_ty", "_tx", lon_pad.alias("_pad_lon"))
    )
    cells = pixels.select(F.col("lat").alias("_plat"), F.col("lon").alias("_plon"), F.col("z").alias("_z"),
                          _tile("lat", tile).alias("_ty"), _tile("lon", tile).alias("_tx"))
    # a pixel meets many turbines, so the work is spread over tiles, not over input files
    met = spread(cells, "_ty", "_tx").join(reach, ["_ty", "_tx"])
    # a plain box first: it drops most of a tile before any trigonometry
    met = met.where((F.abs(F.col("_plat") - F.col("lat")) <= pad * 1.001) & (F.abs(F.col("_plon") - F.col("lon")) <= F.col("_pad_lon") * 1.001))
    east, north = displacement_m("lat", "lon", "_plat", "_plon")
    met = met.withColumns({"_d": F.hypot(east, north), "_b": bearing(east, north)})
    met = met.where(F.col("_d").between(MIN_HORIZON_DISTANCE_M, max(radii)))
    # a bearing exactly on an edge belongs to both wedges it touches
    near = sector("_b", SECTORS)
    on_edge = F.pmod(F.col("_b") + SECTOR_HALF_WIDTH, F.lit(360.0 / SECTORS)) == 0
    below = F.pmod(near - 1, F.lit(SECTORS)).cast("int")
    met = met.select(turbine, "_d", F.degrees(F.atan2(F.col("_z") - F.col("z0"), F.col("_d"))).alias("_angle"),
                     F.explode(F.when(on_edge, F.array(near, below)).otherwise(F.array(near))).alias("sector"))
    angle = F.col("_angle")
    return met.groupBy(turbine, "sector").agg(*[
        F.max(F.when(F.col("_d") <= r, angle)).alias(f"horizon_angle_r{int(r):04d}m") for r in radii])
