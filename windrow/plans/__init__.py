"""Named queries over the surrogate views."""

from __future__ import annotations

from importlib import import_module

#: modules that register queries when imported
MODULES = ("scoring", "weather", "checking", "space", "measured", "composition", "shifting", "relations", "intake", "learning", "estimators", "boosted", "faults")


def load_all():
    from windrow.plans.registry import ENTRIES

    for module in MODULES:
        import_module(f"windrow.plans.{module}")
    return ENTRIES
