"""The rest of the library stands without the corpus operators."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).parent.parent


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "tidewright", tmp_path / "tidewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print('fine')"
    out = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True,
        timeout=120
    )
    assert out.stdout.strip() == "fine", out.stderr


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "tidewright").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text()
