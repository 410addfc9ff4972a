"""Every catalog query against its SQL in DuckDB, and what the entry module offers."""

import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from cairn import catalog_queries

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", catalog_queries.QUERIES)
def test_against_sql(spark, duck, name):
    found = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    rows = lambda r, names: sorted((tuple(x[names.index(c)] for c in columns) for x in r), key=repr)
    assert rows(found.collect(), found.columns) == rows(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).columns == ["p_partkey"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_pipeline(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; from cairn import catalog_queries as c; assert set(e.queries()) == set(c.QUERIES) and set(e.oracle_sql()) == set(c.SQL)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=os.environ | {"PYTHONPATH": ""})
    (tmp_path / "r/cairn/llm").mkdir()
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=os.environ | {"PYTHONPATH": ""})


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(f"{ROOT}/cairn"):
        for n in names:
            if n.endswith(".py") and "/llm" not in folder:
                assert not re.search(r"(from|import)\s+cairn\.llm", open(f"{folder}/{n}").read())
