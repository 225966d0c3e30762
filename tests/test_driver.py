from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as driver

ROOT = Path(__file__).resolve().parents[1]


def test_contract():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert {"p1_found", "p3_found", "p6_found", "hybrid_search"} <= set(driver.queries())


def test_core_never_imports_the_subpackage():
    code = "import sys; sys.modules['statuta.llm'] = None; import __spark_entry__ as d; assert 'p1_found' in d.queries() and 'p2_found' not in d.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for path in (ROOT / "statuta").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "statuta.llm" not in path.read_text(), path


def test_entry(spark):
    assert driver.entry(spark).limit(5).count() == 5
