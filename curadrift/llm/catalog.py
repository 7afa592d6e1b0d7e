"""All queries of this subpackage; importing an operator module registers its query."""

import importlib
import pkgutil

import curadrift.llm as llm
from curadrift.llm.common import ORACLES, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(llm.__path__)):
    if _module not in ("catalog", "common"):
        importlib.import_module(f"curadrift.llm.{_module}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
