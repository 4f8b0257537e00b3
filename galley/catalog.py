"""All queries of the library outside galley.llm, with their SQL."""

from __future__ import annotations

import importlib
import pkgutil

from galley import plans
from galley.plans import registry

for _module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    if _module.startswith("bound_"):
        importlib.import_module(f"galley.plans.{_module}")


def queries():
    return registry.queries()


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
