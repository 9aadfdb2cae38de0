"""The driver's contract, with and without the training-text operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(k.startswith('op') or k == 'pipeline' for k in e.queries()))"


def listed(folder: str) -> list[int]:
    done = subprocess.run([sys.executable, "-c", LIST], cwd=folder, env={**os.environ, "PYTHONPATH": folder}, capture_output=True, text=True, check=True)
    return [int(x) for x in done.stdout.split()[-3:]]


def test_the_rest_loads_without_the_training_text_operators(tmp_path):
    copy = str(tmp_path / "copy")
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse"))
    kept, sql, of_texts = listed(copy)  # corpus_pipeline.py may still be there
    assert of_texts == 0 and kept >= 61 and sql >= 57
    if os.path.exists(f"{copy}/corpus_pipeline.py"):  # gone already where the operators are taken out of the repository itself
        os.remove(f"{copy}/corpus_pipeline.py")
    assert listed(copy) == [kept, sql, 0]
