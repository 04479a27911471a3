"""Query plans: operators wired to the test tables, with SQL twins."""

from importlib import import_module
from pathlib import Path

from segue.registry import ORACLES, QUERIES

for _m in sorted(p.stem for p in Path(__file__).parent.glob("*.py")):
    if not _m.startswith("_"):
        import_module(f"segue.plans.{_m}")

__all__ = ["ORACLES", "QUERIES"]
