"""No module defines a name twice: the later definition would take the earlier one's callers."""

import ast
from collections import Counter
from pathlib import Path

import pytest

from segue import plans

ROOT = Path(__file__).resolve().parent.parent / "segue"


@pytest.mark.parametrize("path", sorted(ROOT.rglob("*.py")), ids=lambda p: str(p.relative_to(ROOT)))
def test_each_name_is_defined_once(path):
    names = [x.name for x in ast.parse(path.read_text()).body if isinstance(x, (ast.FunctionDef, ast.ClassDef))]
    assert [n for n, k in Counter(names).items() if k > 1] == []


@pytest.mark.parametrize("name", ["entry_score", "exit_score", "transition_points"])
def test_points_of_curves_are_scored(spark, name):
    assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
