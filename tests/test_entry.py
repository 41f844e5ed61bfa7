"""The entry without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PRINT = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.QUERIES), set(e.oracle_sql()) == set(e.ORACLE_SQL))"


def _copy(to, keep_pipeline, leftover):
    for name in ("wardrank", "tests"):
        shutil.copytree(f"{REPO}/{name}", to / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if leftover:
        (to / "wardrank/llm").mkdir()
    shutil.copy(f"{REPO}/__spark_entry__.py", to)
    if keep_pipeline and os.path.exists(f"{REPO}/corpus_pipeline.py"):
        shutil.copy(f"{REPO}/corpus_pipeline.py", to)


def _run(where):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-B", "-c", PRINT], cwd=where, env=env, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("keep_pipeline, leftover", [(True, False), (False, False), (True, True)])
def test_import_without_the_subpackage(tmp_path, keep_pipeline, leftover):
    _copy(tmp_path, keep_pipeline, leftover)
    done = _run(tmp_path)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == ["True", "True"]


def test_other_missing_modules_are_errors(tmp_path):
    _copy(tmp_path, False, True)
    (tmp_path / "wardrank/llm/__init__.py").touch()
    (tmp_path / "wardrank/llm/queries.py").write_text("import no_such_module\n")
    done = _run(tmp_path)
    assert done.returncode != 0 and "no_such_module" in done.stderr
