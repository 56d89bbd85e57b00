"""The entry module, with and without the optional corpus part."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_flagship_has_ten_ranks(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 11))
    assert (rows[0]["a"], rows[0]["b"], rows[0]["distance"]) == (412, 618, 2.536033)


def test_every_oracle_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_stands_without_the_corpus_part(tmp_path):
    shutil.copytree(f"{HERE}/motifloom", tmp_path / "motifloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{HERE}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'motifs_exact' in q and not any(k.startswith('op') for k in q)"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=60)
    assert done.returncode == 0, done.stderr


def test_a_missing_package_of_the_corpus_part_is_not_swallowed(tmp_path):
    shutil.copytree(f"{HERE}/motifloom", tmp_path / "motifloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{HERE}/__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import a_package_that_is_not_there\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=60)
    assert done.returncode != 0 and "a_package_that_is_not_there" in done.stderr
