"""All queries of the scene-analytics operators and their SQL twins."""

from __future__ import annotations

import importlib
import pkgutil

from strataform import plans
from strataform.plans.query import ORACLES, QUERIES

FLAGSHIP = "A25_funnel"

for _module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.startswith("q_")):
    importlib.import_module(f"strataform.plans.{_module}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
