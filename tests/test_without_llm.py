"""The library, its queries and its tests work when the optional folders are deleted."""

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LEFT_OUT = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm")


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_and_collection_without_llm(tmp_path, pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(HERE, copy, ignore=LEFT_OUT)
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    seen = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"],
                          cwd=copy, env=env, capture_output=True, text=True)
    assert seen.returncode == 0, seen.stderr
    count, has_pipeline = seen.stdout.split()
    assert int(count) > 150 and has_pipeline == "False"
    tests = subprocess.run([sys.executable, "-m", "pytest", "--co", "-q", "tests"], cwd=copy, env=env, capture_output=True, text=True)
    assert tests.returncode == 0, tests.stdout
