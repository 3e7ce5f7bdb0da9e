"""The table queries without the operators for training text."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
LISTS = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


@pytest.mark.parametrize("left_out", [("tidemark/llm",), ("tidemark/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_imports_without_the_optional_parts(tmp_path, left_out):
    copy = tmp_path / "repo"
    absent = {str(REPO / part) for part in left_out}
    hidden = {".git", "__pycache__", "tests"}
    shutil.copytree(REPO, copy, ignore=lambda folder, names: [n for n in names if n in hidden or f"{folder}/{n}" in absent])
    listed = subprocess.run([sys.executable, "-c", LISTS], cwd=copy, capture_output=True, text=True, timeout=120)
    assert listed.returncode == 0, listed.stderr
    names = listed.stdout.split()
    assert "fact_sales" in names
    assert "pipeline" not in names
    assert any(n.startswith("op1_") for n in names) == ("tidemark/llm" not in left_out and (REPO / "tidemark/llm").exists())
