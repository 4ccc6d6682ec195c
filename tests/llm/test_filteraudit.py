import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from quernel.llm import filteraudit


def failed(rows):
    """The failed filters of each (id, text, part) row, in plain Python."""
    least = {}
    for key, text, _ in rows:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))
    for key, text, part in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = set()
        f |= {"A"} if len(w) < 200 else set()
        f |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        f |= {"E"} if key is not None and key > least[t] else set()
        yield key, part or "", f


def brute(rows, labels):
    good, toxic = ({k for k, *v in labels if k is not None and v[i] == 1} for i in (0, 1))
    docs = list(failed(rows))
    removed_by, out = Counter(), []
    for part in {p for _, p, _ in docs}:
        own = [(k, f) for k, p, f in docs if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(k, f) for k, f in left if x in f]
                left = [(k, f) for k, f in left if x not in f]
                removed_by[part, x] += len(gone)
                out.append([part, order, step, len(left), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == {x} for _, f in own), sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone), x])
    return sorted((*r[:9], removed_by[r[0], r[9]]) for r in out)


LABELS = [(0, 1, 1), (1, 1, 0), (3, 0, 1), (3, 1, None), (7, 1, 1), (11, None, 1), (12, 1, 0), (12, 1, 0), (None, 1, 1), (99, 1, 1)]


def run(spark, docs, labels=LABELS):
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filteraudit.filter_audit(docs, marked, F.col("quality") == 1, F.col("toxic") == 1)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(map(tuple, got.collect()))


def test_odd_rows(spark, odd_docs, odd_rows):
    rows = [(r[0], r[1], r[2]) for r in odd_rows]
    assert run(spark, odd_docs) == brute(rows, LABELS)


def test_filters_meet(spark, words):
    long = words(1, 300)
    texts = [long, long.upper(), long + " $", "Short", "Short", "a " * 250, "A " * 250 + "#", long, None, "", "A%", words(2, 199), words(3, 200)]
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)] + [(3, "Short", "en"), (3, "Short", "en"), (None, long, "en"), (None, long, "en"), (-1, "Short", "de")]
    assert run(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")) == brute(rows, LABELS)


def test_columns_with_names_of_the_operator(spark):
    rows = [(1, "a", "x"), (2, "a", "x")]
    docs = spark.createDataFrame(rows, "id long, mask string, whole string").withColumns({"part": F.lit("p"), "n": F.lit(1), "text": F.lit("t")})
    labels = spark.createDataFrame([(1, 1)], "id long, good int")
    got = filteraudit.filter_audit(docs, labels, F.col("good") == 1, F.lit(False), "id", "mask", "whole")
    assert {(r["kept"], r["removed"]) for r in got.where("filter_order = 'EABCD' and step = 1").collect()} == {(1, 1)}


def test_no_rows(spark, no_docs):
    assert run(spark, no_docs) == []
    docs = spark.createDataFrame([(1, "x", "en")], "doc_id long, text string, lang string")
    assert len(run(spark, docs, [])) == 600


def test_zeta(spark):
    counts = list(range(1, 9))
    got = spark.range(1).select(filteraudit.subset_zeta(F.array(*map(F.lit, counts)), 3)).first()[0]
    assert got == [sum(c for k, c in enumerate(counts) if k & m == k) for m in range(8)]
