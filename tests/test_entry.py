"""The contract module with and without the corpus folders."""

import os
import shutil
import subprocess
import sys

from sluicelog.plans import catalogue

from .conftest import ROOT

COUNT = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), ' '.join(sorted(e.queries())))"


def names_in(folder) -> list[str]:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", COUNT], cwd=folder, env=env, check=True, capture_output=True, text=True).stdout.split()[1:]


def test_log_engine_loads_without_the_corpus_folders(tmp_path):
    """Without the subpackage, with the pipeline's file left behind or not, all queries of the log engine are there."""
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    assert names_in(tmp_path / "repo") == sorted(catalogue.QUERIES)
    left = tmp_path / "repo" / "corpus_pipeline.py"
    if left.exists():
        left.unlink()
    (tmp_path / "repo" / "sluicelog" / "llm" / "__pycache__").mkdir(parents=True)
    assert names_in(tmp_path / "repo") == sorted(catalogue.QUERIES)
