"""Registry of named queries: a DataFrame plan, the survey rows it covers, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from windrow.plans.views import Views, with_views
from windrow.session import apply_conf


@dataclass(frozen=True)
class Entry:
    name: str
    covers: tuple[str, ...]
    plan: Callable[[Views], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.plan(Views(apply_conf(spark), sf_dir))


ENTRIES: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``plan(views)`` under ``name``; ``sql`` may use every view name of :mod:`views`."""

    def wrap(plan: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")
        ENTRIES[name] = Entry(name, tuple(covers.split()), plan, with_views(sql) if sql else None)
        return plan

    return wrap
