import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quernel.llm import mixing

SOURCES = [None, "a", "b", "B", "é", "z"]


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, done = Fraction(3, 2) * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in done]
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] > 2 * sizes[s]]
        if not over:
            return {s: float(t) for s, t in (done | part).items()}
        for s in over:
            done[s] = Fraction(2 * sizes[s])
            left -= done[s]


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_shares(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    got = mixing.shares(sizes, weights, Fraction(3, 2) * sum(sizes), 2)
    assert sum(got) == Fraction(3, 2) * sum(sizes)
    assert all(0 <= t <= 2 * s for t, s in zip(got, sizes, strict=True))


@pytest.fixture(scope="module")
def corpus():
    r, rows = random.Random(4), []
    for i in range(6000):
        s = r.choices(SOURCES, [8, 1, 2, 1, 1, 3])[0]
        rows.append((i, " ".join(["w"] * int(r.lognormvariate(3, 1))), s))
    return rows


def run(docs):
    return [tuple(r) for r in mixing.copies(docs).select("doc_id", "size", "source", "source_size", "target", "copies").collect()]


def test_targets_and_taken(spark, corpus, monkeypatch):
    monkeypatch.setattr(mixing, "SLOT_ROWS", 16)
    docs = spark.createDataFrame(corpus, "doc_id long, text string, source string")
    got = run(docs)
    assert sorted(r[0] for r in got) == list(range(6000))
    sizes, taken = defaultdict(int), defaultdict(int)
    for k, text, s in corpus:
        sizes[s] += len(text.split())
    want = brute_targets(sizes)
    for k, size, s, source_size, target, n in got:
        assert size == len(re.findall("[^ \t-\r]+", corpus[k][1])) and source_size == sizes[s]
        assert target == pytest.approx(want[s]) and 0 <= n <= 2
        taken[s] += n * size
    for s, t in want.items():
        assert taken[s] == pytest.approx(t, rel=0.02)
    assert sorted(run(docs.repartition(7))) == sorted(got)


def test_mix_emits_the_copies(spark, corpus):
    docs = spark.createDataFrame(corpus[:500], "doc_id long, text string, source string")
    want = sorted(r[0] for r in run(docs) for _ in range(r[5]))
    out = mixing.mix(docs)
    assert sorted(r["doc_id"] for r in out.collect()) == want and out.columns == docs.columns


def test_edges(odd_docs, odd_rows, no_docs, spark):
    got = mixing.copies(odd_docs)
    sizes = defaultdict(int)
    for r in odd_rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = brute_targets(sizes)
    rows = got.collect()
    assert len(rows) == len(odd_rows) and got.columns.count("size") == 1
    assert all(r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["copies"] <= 2 for r in rows)
    assert mixing.copies(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [r["copies"] for r in mixing.copies(blank).collect()] == [0, 0]
