import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_flagship(spark):
    assert entry.entry(spark).count() == 1


def test_sql_has_queries():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_without_the_optional_parts(tmp_path):
    """What is left works if the folders of the optional parts are gone."""
    for name in ("__spark_entry__.py", "tallyweave"):
        subprocess.run(["cp", "-r", ROOT / name, tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "tallyweave" / "llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert e.oracle_sql().keys() == q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_without_a_library(tmp_path):
    """A library that is not there takes only the queries that need it along."""
    (tmp_path / "regex.py").write_text("raise ModuleNotFoundError('absent', name='regex')\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'report_documents' in q and 'op2_quality' in q and 'op1_bpe' not in q and 'pipeline' not in q; assert e.oracle_sql().keys() <= q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{ROOT}", "PYTHONDONTWRITEBYTECODE": "1"}, check=True)


def test_nothing_else_imports_the_optional_part():
    for p in (ROOT / "tallyweave").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text()
