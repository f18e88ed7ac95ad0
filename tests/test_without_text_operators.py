"""The library without the text operators' folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
names = set(e.queries())
assert "pipeline" not in names and not any(n.startswith("op1_") for n in names) and len(names) > 100 and set(e.oracle_sql()) <= names
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", e.entry(spark).count())
"""


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables")
@pytest.mark.parametrize("gone", [("statefield/llm", "tests/llm"), ("statefield/llm", "tests/llm", "corpus_pipeline.py")])
def test_the_rest_imports_and_runs(tmp_path, gone):
    for p in ("statefield", "tests", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / p).is_dir():
            shutil.copytree(ROOT / p, tmp_path / p, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / p).exists():
            shutil.copy(ROOT / p, tmp_path / p)
    for p in gone:
        if (tmp_path / p).is_dir():
            shutil.rmtree(tmp_path / p)
        elif (tmp_path / p).exists():
            (tmp_path / p).unlink()
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "ROWS" in done.stdout, done.stderr[-2000:]
