"""Run keys, lead hours, cutoffs and calendar columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from windrow.functions.exprs import ColumnLike, col

NTZ = "timestamp_ntz"

# fixed values: a run covers operating hours 01:00 ... next-day 00:00; decisions close at 14:00 on the day before
RUN_HOURS = 24
CUTOFF_HOUR = 14
FIRST_LEAD_HOUR = 12
YEAR_DAYS = 365.2425


def hour_floor(ts: ColumnLike) -> Column:
    return F.date_trunc("hour", col(ts)).cast(NTZ)


def day_floor(ts: ColumnLike) -> Column:
    return F.date_trunc("day", col(ts)).cast(NTZ)


def hours(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} HOUR")


def run_key(ts: ColumnLike) -> Column:
    """The operating day a valid hour belongs to: 01:00 ... 00:00 of the next day share one key."""
    return day_floor(col(ts) - hours(1))


def hours_between(later: ColumnLike, earlier: ColumnLike) -> Column:
    """Elapsed hours as a double."""
    return F.timestamp_diff("MICROSECOND", col(earlier), col(later)) / F.lit(3.6e9)


def run_position(ts: ColumnLike) -> Column:
    """0 for 01:00 ... 23 for 00:00."""
    return (F.hour(col(ts)) + 23) % 24


def lead_hours(ts: ColumnLike) -> Column:
    return run_position(ts) + FIRST_LEAD_HOUR


def decision_cutoff(ts: ColumnLike, hour: int = CUTOFF_HOUR) -> Column:
    """14:00 on the day before the operating day of a valid hour."""
    return run_key(ts) - hours(24 - hour)


def cyclic_time_features(ts: ColumnLike, lead: ColumnLike) -> dict[str, Column]:
    two_pi = 2.0 * math.pi
    hour = F.hour(col(ts)).cast("double")
    day = F.dayofyear(col(ts)) - 1.0 + hour / 24.0
    month = F.month(col(ts)).cast("double")
    out = {
        "time__hour_sin": F.sin(two_pi * hour / 24.0),
        "time__hour_cos": F.cos(two_pi * hour / 24.0),
        "time__doy_sin": F.sin(two_pi * day / YEAR_DAYS),
        "time__doy_cos": F.cos(two_pi * day / YEAR_DAYS),
        "time__month_sin": F.sin(two_pi * (month - 1.0) / 12.0),
        "time__month_cos": F.cos(two_pi * (month - 1.0) / 12.0),
        "time__lead_hours": col(lead).cast("double"),
        "time__run_position": col(lead).cast("double") - float(FIRST_LEAD_HOUR),
    }
    out["time__hour_x_doy_sin"] = out["time__hour_sin"] * out["time__doy_sin"]
    out["time__hour_x_doy_cos"] = out["time__hour_cos"] * out["time__doy_cos"]
    return out
