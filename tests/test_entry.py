"""The entry module loads whatever of the optional parts is there."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("gone", [["hazegrid/llm", "tests/llm"], ["hazegrid/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_the_optional_parts(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.txt", "*.json"))
    for name in gone:
        at = copy / name
        shutil.rmtree(at) if at.is_dir() else at.unlink(missing_ok=True)
    said = subprocess.run([sys.executable, "-c", CODE], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)})
    assert said.returncode == 0, said.stderr
    n, operators, twins = said.stdout.split()
    assert int(n) > 150 and int(operators) == 0 and twins == "True"
