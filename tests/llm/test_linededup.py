import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quernel.llm import linededup as ld


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))


def brute(texts, least=10):
    docs = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and docs[key(x)] >= least)]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def run(docs, **options):
    return ld.drop_repeated_lines(docs, **options)


def test_equal_to_brute_force(spark):
    r = random.Random(2)
    pool = [f"line {i}" for i in range(40)] + ["", "  ", "ÄÖ x", "ALL caps", "all CAPS\t", " all caps "]
    texts = ["\n".join(r.choice(pool) if r.random() < 0.6 else f"own {r.random()}" for _ in range(r.randrange(0, 12))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for batches in (1, 4, 20):
        got = [tuple(x) for x in run(docs, batches=batches).orderBy("doc_id").select("text", "n_lines", "n_dropped").collect()]
        assert got == brute(texts)


def test_edges(odd_docs, odd_rows, no_docs):
    got = run(odd_docs, min_docs=3)
    want = [(r[0], *x) for r, x in zip(odd_rows, brute([r[1] for r in odd_rows], 3), strict=True)]
    assert got.columns == [c for c in odd_docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=str) == sorted(want, key=str)
    assert run(no_docs).count() == 0


def keyed(spark, *n):
    return spark.createDataFrame([(x, x) for x in n], "a long, b long")


def test_runs_compact_and_tell_new_keys(spark):
    runs = ld.LineRuns(spark, min_docs=3, fanout=2)
    fresh = [{r["a"] for r in runs.add(keyed(spark, *batch), fresh=True).collect()} for batch in ((1, 1, 2), (1, 3), (2, 2, 4), (1, 4), (4, 5))]
    assert fresh[0] == {1, 2} and fresh[4] == {5}
    assert len(runs.levels["keys"]) >= 3 and len(runs.levels["tallies"]) >= 3
    stored = [r["a"] for run in runs.runs() for r in run.collect()]
    assert sorted(stored) == [1, 2, 3, 4, 5]  # every key in one run
    assert {r["a"] for r in runs.repeated().collect()} == {1, 2, 4}
    assert {r["a"] for r in runs.unseen(keyed(spark, 1, 3, 6, 7)).collect()} == {6, 7}
    runs.delete()
    assert ld.LineRuns(spark).repeated().count() == 0
    with pytest.raises(ValueError):
        ld.LineRuns(spark, fanout=1)


def test_a_folder_is_opened_again(spark, tmp_path):
    batches = [(1, 1, 2), (1, 3), (2, 2, 4), (1, 4), (4, 5)]
    for i, batch in enumerate(batches):
        runs = ld.LineRuns(spark, folder=f"file://{tmp_path}/runs", min_docs=3, fanout=2)
        for name in spark.catalog.listTables(pattern="quernel_lines_*"):
            spark.sql(f"DROP TABLE {name.name}")  # as in a new session, which knows no table
        runs.add(keyed(spark, *batch), str(i))
        assert runs.add(keyed(spark, *batch), str(i), fresh=True).count() == 0  # a repeated batch counts once
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = ld.LineRuns(spark, folder=f"file://{tmp_path}/runs", min_docs=3, fanout=2)
        assert again.buckets == 4 and again.batches == list("01234")
        again.add(keyed(spark, 5, 5, 9), "5")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r["a"] for r in again.repeated().collect()} == {1, 2, 4, 5}


def test_runs_merge_without_exchange_or_sort(spark):
    runs = ld.LineRuns(spark, fanout=9)
    for i in range(3):
        runs.add(keyed(spark, *range(i * 50, i * 50 + 100)))
    with ld._sorted_scans(spark):
        plan = runs.unseen(runs.runs()[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan and "Sort [" not in plan
    runs.delete()
