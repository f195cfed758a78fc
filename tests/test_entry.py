"""The driver's contract, with and without the optional part."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as contract

ROOT = Path(contract.__file__).parent


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["subject_class", "property_uri", "object_class", "count", "datatype"] or "count" in contract.entry(spark).columns


def test_the_rest_works_without_the_optional_part(tmp_path):
    import shutil

    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "quadrille", tmp_path / "quadrille", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(q))"], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr


def test_the_rest_works_when_a_package_of_the_optional_part_is_missing(tmp_path):
    code = "import sys, warnings; sys.modules['ahocorasick'] = None; warnings.simplefilter('ignore'); import __spark_entry__ as e; q = e.queries(); assert len(q) >= 90 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr


def test_nothing_else_imports_the_optional_part():
    for path in (ROOT / "quadrille").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "quadrille").parts:
            assert ".llm" not in path.read_text() and "import llm" not in path.read_text(), path
