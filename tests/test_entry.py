"""The entry point with and without the subpackage for language models."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["event_id", "raw_score", "created_at", "hot"]


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "newsloom", tmp_path / "newsloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'trending' in q and 'pipeline' not in q and not any(x.startswith('op') for x in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
