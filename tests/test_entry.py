import __spark_entry__ as entry


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["x", "y", "n", "speed"] and df.count() == 40


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_training_data_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    repo = os.path.dirname(entry.__file__)
    shutil.copytree(repo, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True)
