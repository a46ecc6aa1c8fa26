"""The driver's contract, with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert all(n.startswith(("q_", "op")) or n == "pipeline" for n in __spark_entry__.queries())


def test_the_rest_works_without_the_optional_part(tmp_path):
    shutil.copytree(ROOT / "strandline", tmp_path / "strandline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if not n.startswith('q_')])"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert said.stdout.split(maxsplit=1)[1].strip() == "[]" and int(said.stdout.split()[0]) > 50


def test_errors_inside_optional_modules_are_not_hidden(tmp_path):
    shutil.copytree(ROOT / "strandline", tmp_path / "strandline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "strandline/llm").mkdir()
    (tmp_path / "strandline/llm/__init__.py").write_text("")
    (tmp_path / "strandline/llm/queries.py").write_text("import nothing_of_this_name\n")
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True).returncode


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no driver tables")
def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["lang", "doc_id", "n_chars", "bundle", "tall", "seam_cut"]
