"""The registered queries of the training-data operators against their SQL, types included."""

import glob
import os

import duckdb
import pytest

from quernel.llm import queries as llm

FOLDER = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def compare(spark, name, folder):
    df, sql = llm.queries()[name](spark, folder), connect(folder).sql(llm.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    types = dict(zip(sql.columns, map(str, sql.types), strict=True))
    assert {c: KINDS[t] for c, t in df.dtypes} == types
    want = sorted(tuple(map(str, r)) for r in sql.fetchall())
    assert sorted(tuple(map(str, r)) for r in df.select(*sql.columns).collect()) == want


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    compare(spark, name, FOLDER)


def test_links_between_hosts_equal_sql(spark, tmp_path):
    page = lambda i, u, *to: (i, u, "".join(f'<a href="{t}">x</a>' for t in to))
    rows = [
        page(1, "https://a.com/de/1", "https://b.net/x", "//C.net"), page(2, "https://b.net/1", "http://a.com/"), page(3, "https://c.net/"), page(4, "HTTP://Good.ORG/ok?q#f", "https://d.net/p", "/local"),
        page(5, "https://d.net"), page(6, "https://x.example.org/en/12", "https://d.net"), page(7, "https://e.net/z", "https://x.example.org/"), page(8, "https://www.shop.com/fr/a?b"), (9, None, None), (10, "none", ""),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/raw")
    os.rename(glob.glob(f"{tmp_path}/raw/*.parquet")[0], f"{tmp_path}/pages.parquet")
    compare(spark, "op4_urls", str(tmp_path))


def test_mixing_with_odd_rows_equals_sql(spark, tmp_path, odd_docs):
    odd_docs.select("doc_id", "text", "source").coalesce(1).write.parquet(f"{tmp_path}/raw")
    os.rename(glob.glob(f"{tmp_path}/raw/*.parquet")[0], f"{tmp_path}/documents.parquet")
    compare(spark, "op9_mixing", str(tmp_path))


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_query_has_a_row_for_every_document(spark, name):
    docs = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in llm.queries()[name](spark, FOLDER).select("doc_id").collect()} == docs


def test_filter_audit_with_odd_rows_equals_sql(spark, tmp_path, odd_docs):
    odd_docs.select("doc_id", "text", "lang").coalesce(1).write.parquet(f"{tmp_path}/raw")
    os.rename(glob.glob(f"{tmp_path}/raw/*.parquet")[0], f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (12, 1, None)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/marks")
    os.rename(glob.glob(f"{tmp_path}/marks/*.parquet")[0], f"{tmp_path}/labels.parquet")
    compare(spark, "op12_filters", str(tmp_path))
