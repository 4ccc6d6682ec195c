"""Every standard query against its SQL on the smallest tables."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

from quernel.plans import queries as plans

FOLDER = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_sql(spark, duck, name):
    df, sql = plans.queries()[name](spark, FOLDER), duck.sql(plans.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    types = dict(zip(sql.columns, map(str, sql.types), strict=True))
    assert {c: KINDS[t] for c, t in df.dtypes} == types
    want = sql.fetchall()
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(plain(r[sql.columns.index(c)]) for c in columns) for r in want)
    assert got or name == "route_ambiguous"


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_part():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("quernel.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import importlib.util as u
find = u.find_spec
u.find_spec = lambda n, *a: None if n == "corpus_pipeline" or n.startswith("quernel.llm") else find(n, *a)
import __spark_entry__ as e
names = e.queries()
assert "sentiment_summary" in names and not [n for n in names if n.startswith("op") or n == "pipeline"], names
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_nothing_else_imports_the_training_data_part():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{root}/quernel/**/*.py", recursive=True):
        if "/llm/" not in path:
            with open(path) as f:
                assert "quernel.llm" not in f.read(), path
