import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_module

ROOT = Path(__file__).parents[1]


def test_entry_and_registry(spark):
    found = entry_module.queries()
    assert set(entry_module.oracle_sql()) <= set(found) and len(found) >= 70
    assert entry_module.entry(spark).count() > 0


def test_library_stands_without_the_two_folders(tmp_path):
    """Only archivolt/llm and tests/llm go; corpus_pipeline.py is still there and can't be imported."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    shutil.rmtree(copy / "archivolt" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and set(e.oracle_sql()) <= set(q); assert not any(n == 'pipeline' or n.startswith('op') and n[2].isdigit() for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})


def test_shared_folder(spark, monkeypatch):
    from archivolt.sources import shared

    assert shared.new_folder(spark, "a") != shared.new_folder(spark, "a")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError, match="share"):
            shared.shared_dir(spark)
