import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quernel.llm import neardup as nd


def shingle_bag(text):
    w = (text or "").split()
    counts = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    return Counter({k: n.bit_length() for k, n in counts.items()})


def brute(rows):
    """Class of each text by comparing all pairs."""
    texts = sorted({t or "" for _, t in rows})
    bags = [shingle_bag(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            shared = (bags[i] & bags[j]).total()
            if shared and shared >= 0.8 * (bags[i].total() + bags[j].total() - shared):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for k, t in rows:
        if k is not None:
            least[find(texts.index(t or ""))].append(k)
    return {(k, t): min(least[find(texts.index(t or ""))], default=None) for k, t in rows}


def copies_of(text, n, edits, seed):
    r, words = random.Random(seed), text.split()
    for k in range(n):
        w = list(words)
        for _ in range(edits if isinstance(edits, int) else r.choice(edits)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        yield " ".join(w)


@pytest.fixture(scope="module")
def planted(words):
    texts = [words(i, 60 + i % 90) for i in range(120)]
    for i in range(6):
        texts += copies_of(texts[i], 4, [1, 2], i)
    texts += copies_of(words(999, 150), 320, [0, 1, 2, 3, 4, 5, 6, 8], 5)  # a group whose members are not all alike
    for i in range(8):  # lines that are repeated weigh more, the more often they occur
        line = words(500 + i, 12)
        texts += ["\n".join([line] * n + [texts[i]]) for n in (3, 12, 13, 14, 40)]
    texts += texts[:30]
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [32, 256])
def test_classes_equal_brute_force(spark, planted, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    docs = spark.createDataFrame(planted, "doc_id long, text string")
    got = {(r["doc_id"], dict(planted)[r["doc_id"]]): r["class_id"] for r in nd.near_duplicates(docs).collect()}
    assert got == brute(planted)


def test_signature_estimates_weighted_similarity():
    r = np.random.default_rng(1)
    h = r.integers(0, 2**63, 300).astype(np.uint64)
    a, b = r.integers(1, 9, 300).astype(float), r.integers(1, 9, 300).astype(float)
    a[:60], b[240:] = 0, 0
    one, two = (nd.dart_minhash(h[w > 0], w[w > 0], 4000) for w in (a, b))
    assert abs((one == two).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_weights_grow_with_counts_or_are_one(spark):
    base = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, base), (2, " ".join([base] * 4)), (3, " ".join([base] * 4) + " tail")], "doc_id long, text string")
    classes = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(docs).collect()}
    assert classes == {1: 1, 2: 2, 3: 2}
    classes = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(docs, weighted=False, similarity=0.6).collect()}
    assert classes == {1: 1, 2: 1, 3: 1}


def test_a_repeated_phrase_does_not_join_different_texts(spark, words):
    phrase = "\n".join([words(7, 12)] * 300)
    rows = [(i, f"{phrase}\n{words(20 + i, 60)}") for i in range(4)]
    docs = spark.createDataFrame([*rows, (9, rows[0][1] + " tail")], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(docs).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 9: 0}


def test_the_same_row_stays_on_every_run(spark):
    rows = [(1, "same id and text", s, s * 3) for s in "dcba"] + [(2, "same id and text", "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    kept = [nd.drop_near_duplicates(docs.repartition(n)).collect() for n in (1, 3)]
    assert kept[0] == kept[1] and len(kept[0]) == 1 and kept[0][0]["doc_id"] == 1


def test_edges(odd_docs, odd_rows, no_docs):
    got = nd.near_duplicates(odd_docs)
    want = brute([(r[0], r[1]) for r in odd_rows])
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["class_id"]) for r in got.collect()) == sorted((k is None, k or 0, want[k, t]) for k, t, *_ in odd_rows)
    kept = nd.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == got.select("class_node").distinct().count()
    assert nd.near_duplicates(no_docs).count() == 0 and nd.drop_near_duplicates(no_docs).count() == 0


def test_words_across_pieces(monkeypatch, words):
    text = words(3, 4000).encode()
    whole = nd.word_hashes(text)
    monkeypatch.setattr(nd, "PIECE", 64)
    assert (nd.word_hashes(text) == whole).all() and len(whole) == 4000
