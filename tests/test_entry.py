"""The entry without the corpus operators: their folders, with or without the pipeline's file, may be missing."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; names = set(e.queries()); assert set(e.oracle_sql()) <= names; print(len(names), any(n.startswith('op') or n == 'pipeline' for n in names))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_corpus_operators(tmp_path, pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
    told = subprocess.run([sys.executable, "-c", ASK], cwd=copy, env={"PATH": "", "PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert told.returncode == 0, told.stderr
    n, left = told.stdout.split()
    assert int(n) > 100 and left == "False"
