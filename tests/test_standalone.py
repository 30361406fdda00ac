"""The library stands without the subpackage that nothing else imports."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def alone(tmp_path_factory):
    """A copy of the repository without the corpus operators, their tests and the pipeline."""
    folder = tmp_path_factory.mktemp("alone")
    for name in ("tesserql", "tests"):
        shutil.copytree(ROOT / name, folder / name, ignore=shutil.ignore_patterns("llm", "__pycache__", "test_standalone.py"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, folder)
    return folder


def run(folder, *command, timeout=900):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(folder)}
    return subprocess.run([sys.executable, *command], cwd=folder, env=env, timeout=timeout, capture_output=True, text=True)


def test_queries_without_the_corpus_operators(alone):
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and not any(k[:3] == 'op1' or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    done = run(alone, "-c", code)
    assert done.returncode == 0, done.stderr


def test_other_tests_without_the_corpus_operators(alone):
    """But for those of each query, which are the same."""
    done = run(alone, "-m", "pytest", "-x", "-q", "-p", "no:cacheprovider", "tests", "--deselect", "tests/test_queries.py::test_query")
    assert done.returncode == 0, done.stdout[-2000:]


def test_a_missing_library_is_an_error(alone, tmp_path):
    """Only the subpackage's own absence is passed over."""
    if not (ROOT / "tesserql" / "llm").exists() or not (ROOT / "corpus_pipeline.py").exists():
        pytest.skip("removed")
    folder = tmp_path / "broken"
    shutil.copytree(ROOT / "tesserql", folder / "tesserql", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", folder)
    shutil.copy(ROOT / "corpus_pipeline.py", folder)
    (folder / "xxhash.py").write_text("raise ModuleNotFoundError(\"No module named 'xxhash'\", name='xxhash')")
    done = run(folder, "-c", "import __spark_entry__")
    assert done.returncode and "xxhash" in done.stderr
    (folder / "xxhash.py").unlink()
    (folder / "corpus_pipeline.py").unlink()
    done = run(folder, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'op10_best_fit_packing' in q and 'pipeline' not in q")
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_them():
    if not (ROOT / "tesserql" / "llm").exists():
        pytest.skip("removed")
    for path in (ROOT / "tesserql").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
