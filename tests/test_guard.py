import os
import shutil
import subprocess
import sys

import pytest

from conftest import ROOT


CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 150 and set(o) <= set(q); assert not any(k.startswith('op') or k == 'pipeline' for k in q); print('fine')"


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_the_library_stands_without_the_training_data_operators(tmp_path, also):
    """With the two folders gone (and the pipeline, or not) the entry imports, every other test is found, and some run."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", "spark-warehouse", *also))
    done = subprocess.run([sys.executable, "-c", CODE], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "fine", done.stderr
    environment = {**os.environ, "PYTHONPATH": str(copy)}
    found = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=copy, capture_output=True, text=True, timeout=240, env=environment)
    assert found.returncode == 0, found.stdout[-2000:]
    ran = subprocess.run([sys.executable, "-m", "pytest", "tests/test_oracles.py", "-q", "-k", "fn_jaccard or ret_fts or entry"], cwd=copy, capture_output=True, text=True, timeout=400, env=environment)
    assert ran.returncode == 0, ran.stdout[-2000:]


def test_nothing_else_imports_them():
    files = [p for p in ROOT.rglob("*.py") if "llm" not in p.parts and p.name not in ("__spark_entry__.py", "corpus_pipeline.py", "test_guard.py")]
    assert files and not [p for p in files if "quillmesh.llm" in p.read_text()]
