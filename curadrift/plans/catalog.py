"""All registered queries; importing a plan module registers its queries."""

import importlib
import pkgutil

import curadrift.plans as plans
from curadrift.plans.registry import ORACLES, RUNNERS

for _module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    if _module not in ("catalog", "registry", "ctes"):
        importlib.import_module(f"curadrift.plans.{_module}")


def queries() -> dict:
    return dict(RUNNERS)


def oracle_sql() -> dict:
    return dict(ORACLES)
