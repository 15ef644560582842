"""The entry points, with and without the optional folder."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"


@pytest.mark.parametrize("pipeline", [True, False])
def test_imports_without_the_optional_folder(tmp_path, pipeline):
    skipped = ("llm", ".git", "__pycache__", *(() if pipeline else ("corpus_pipeline.py",)))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(*skipped))
    if pipeline and os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        assert (tmp_path / "copy/corpus_pipeline.py").exists()
    names = subprocess.run([sys.executable, "-c", NAMES], cwd=tmp_path / "copy", capture_output=True, text=True, check=True).stdout.split()
    assert "retention_funnel" in names and "vocabulary" in names
    assert "pipeline" not in names and not [n for n in names if n.startswith("op")]
