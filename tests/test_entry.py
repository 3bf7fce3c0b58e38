"""The driver's contract, and that nothing of it needs the corpus operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_corpus_operators(tmp_path):
    """With the corpus folder and file deleted, or with a package they import missing, the other queries are all there."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    said = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    (copy / "zstandard.py").write_text("raise ImportError('not there')\n")
    without_package = subprocess.run([sys.executable, "-c", said], cwd=copy, capture_output=True, text=True, check=True).stdout
    shutil.rmtree(copy / "queuelens" / "llm", ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    deleted = subprocess.run([sys.executable, "-c", said], cwd=copy, capture_output=True, text=True, check=True).stdout
    own = [n for n in entry.queries() if not (n.startswith("op") and n[2].isdigit()) and n != "pipeline"]
    assert without_package == deleted and int(deleted.split()[0]) == len(own) > 60


def test_nothing_imports_the_corpus_operators():
    for folder, _, files in os.walk(os.path.join(ROOT, "queuelens")):
        if os.path.basename(folder) == "llm":
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "llm" not in f.read(), name
