"""Previous-run providers: day selection, cross-provider features, agreement gate and consensus."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.functions.exprs import ColumnLike, col, mean_of, std_of, total
from windrow.functions.wind import components, speed

PARTS = ("ws", "u", "v")
# fixed value: the mean speed below which ratios to it are formed with this one
CONSENSUS_FLOOR = 0.05


def previous_day(ts: ColumnLike) -> Column:
    """Which previous run may be used: the day before for 01:00 ... 13:00, two days before for the rest."""
    return F.when(F.hour(col(ts)).between(1, 13), 1).otherwise(2)


def select_previous(ts: ColumnLike, day1: ColumnLike, day2: ColumnLike) -> Column:
    return F.when(previous_day(ts) == 1, col(day1)).otherwise(col(day2))


def selected_wind(ts: ColumnLike, name: str) -> tuple[Column, Column, Column]:
    """Speed, u and v of provider columns ``<name>_ws_d1`` ... ``<name>_wd_d2`` after the day choice."""
    ws = select_previous(ts, f"{name}_ws_d1", f"{name}_ws_d2")
    u, v = components(ws, select_previous(ts, f"{name}_wd_d1", f"{name}_wd_d2"))
    return ws, u, v


def join_sources(sources: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Provider tables side by side on their common keys; all are clustered on the same keys, so each is shuffled once."""
    frames = list(sources.values())
    out = frames[0]
    for other in frames[1:]:
        out = out.join(other, list(keys))
    return out


def _span(columns: Sequence[Column]) -> Column:
    return F.greatest(*columns) - F.least(*columns)


def joint_features(first: tuple[Column, Column, Column], middle_low: tuple[Column, Column, Column],
                   middle_high: tuple[Column, Column, Column], last_low_ws: Column, last: tuple[Column, Column, Column],
                   hub_ws: ColumnLike) -> dict[str, Column]:
    """Thirty cross-provider columns from (speed, u, v) triples.

    The middle provider has no 100 m level; its vector is the mean of the levels below and above, which avoids averaging
    directions.
    """
    centre = [0.5 * (low + high) for low, high in zip(middle_low[1:], middle_high[1:])]
    winds = {"first": first, "middle": (speed(*centre), *centre), "last": last}
    out = {f"{provider}_{part}100": value for provider, wind in winds.items() for part, value in zip(PARTS, wind)}
    means = {}
    for part, values in zip(PARTS, zip(*winds.values())):
        means[part] = mean_of(values)
        out |= {f"{part}100_mean": means[part], f"{part}100_std": std_of(values), f"{part}100_range": _span(values)}
    for a, b in itertools.combinations(winds, 2):
        out[f"distance_{a}_{b}"] = speed(*(x - y for x, y in zip(winds[a][1:], winds[b][1:])))
    for name, value in {**{provider: wind[0] for provider, wind in winds.items()}, "mean": means["ws"]}.items():
        out[f"{name}_minus_hub_ws"] = value - col(hub_ws)
    # how far the providers agree, relative to their mean speed
    consensus, size = speed(means["u"], means["v"]), F.greatest(means["ws"], F.lit(CONSENSUS_FLOOR))
    out |= {"consensus_vector_speed": consensus, "directional_coherence": consensus / size, "spread_to_mean_ratio": out["ws100_std"] / size}
    shears = (middle_high[0] - middle_low[0], last[0] - last_low_ws)
    return out | {"vertical_shear_mean": 0.5 * (shears[0] + shears[1]), "vertical_shear_abs_disagreement": F.abs(shears[0] - shears[1])}


def revision_features(ws: Column, u: Column, v: Column, hub_ws: ColumnLike) -> dict[str, Column]:
    return {"rev_ws": ws, "rev_u": u, "rev_v": v, "rev_ws_minus_hub": ws - col(hub_ws)}


def ensemble_disagreement(u_low: ColumnLike, v_low: ColumnLike, u_high: ColumnLike, v_high: ColumnLike, hub_ws: ColumnLike,
                          control_u: ColumnLike, control_v: ColumnLike) -> dict[str, Column]:
    low, high = speed(u_low, v_low), speed(u_high, v_high)
    return {
        "ens_ws_low": low, "ens_ws_low_minus_hub": low - col(hub_ws), "ens_ws_high": high,
        "ens_ws_high_minus_control": high - speed(control_u, control_v),
    }


def agreement_gate(joint: ColumnLike, sources: Sequence[ColumnLike]) -> dict[str, Column]:
    """Number of providers that share the sign of the joint increment, the confidence and the gated increment.

    Fewer than two votes give zero; the size is capped by the median provider size over the joint size; a joint
    increment of exactly zero stays zero.
    """
    j = col(joint)
    same = [F.when((F.signum(j) != 0) & (F.signum(col(s)) == F.signum(j)), 1).otherwise(0) for s in sources]
    votes = total(same)
    vote = F.when(votes >= 2, votes / float(len(sources))).otherwise(0.0)
    ordered = F.array_sort(F.array(*[F.abs(col(s)) for s in sources]))
    n = len(sources)
    median = (F.element_at(ordered, (n + 1) // 2) + F.element_at(ordered, n // 2 + 1)) / 2.0
    cap = F.when(j == 0, 0.0).otherwise(F.least(F.lit(1.0), median / F.abs(j)))
    confidence = vote * cap
    return {"agreement": votes, "confidence": confidence, "gated": j * confidence}
