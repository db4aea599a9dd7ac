"""The library stands without its training-data subpackage, and nothing in it imports that."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent


@pytest.mark.parametrize("more", [(), ("corpus_pipeline.py",)])
def test_without_llm(tmp_path, more):
    """With both ``llm`` folders gone the entry module works, whether the pipeline's file stays or goes with them."""
    own = tmp_path / "repo"
    shutil.copytree(ROOT, own, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "spark-warehouse", *more))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(n.startswith('op') and n[2].isdigit() for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=own, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-500:]
    n, sql, has_llm = out.stdout.split()[-3:]
    assert int(n) > 100 and int(sql) > 100 and has_llm == "False"


def test_nothing_imports_llm():
    for path in (ROOT / "plumbline").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"plumbline\.llm|from plumbline import llm", path.read_text()), path


def test_no_local_checkpoints_or_rdds():
    for path in [*(ROOT / "plumbline").rglob("*.py"), ROOT / "corpus_pipeline.py"]:
        if path.exists():
            assert not re.search(r"localCheckpoint|\.rdd\b", path.read_text()), path
