"""Driver contract: every registered query runs on the smoke tables."""

import importlib

import pytest

E = importlib.import_module("__spark_entry__")


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "rate_moe" in df.columns


def test_every_query_has_oracle():
    from indicata.plans import catalog
    assert set(catalog.oracle_sql()) == set(catalog.queries())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_works_without_the_corpus_operators(tmp_path):
    """A copy without the corpus package and pipeline still imports and lists the rest."""
    import os
    import shutil
    import subprocess
    import sys
    from indicata.plans import catalog

    root = os.path.dirname(os.path.abspath(E.__file__))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(root, "indicata"), tmp_path / "indicata", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries()))"],
                         cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert out.stdout.split() == sorted(catalog.queries()), out.stderr


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_runs(spark, name):
    df = E.queries()[name](spark, "/root/testdata/sf0.001")
    df.limit(5).collect()
    assert len(df.columns) > 0


def test_cli_list(capsys):
    from indicata.__main__ import main
    assert main(["list"]) == 0
    out = capsys.readouterr().out
    assert "survey_breakdown" in out and "poverty_runs" in out
