import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quernel.llm import lmscore as lm


def occurrences(text):
    """Every token with each context of up to three bytes; a document starts after newlines."""
    data = b"\n" * 3 + text
    return [(data[j - k : j], data[j : j + 1]) for j in range(3, len(data)) for k in range(4)]


def counts_of(texts):
    """How often a token follows a context, and how often anything does."""
    pairs = Counter(o for t in texts for o in occurrences(t))
    after = Counter()
    for (context, _), n in pairs.items():
        after[context] += n
    return pairs, after


def probability(context, token, pairs, after):
    """The written formula with counts as dictionaries."""
    p = (pairs[b"", token] + 1) / (after[b""] + 256)
    for k in range(1, 4):
        c = context[3 - k :]
        p = (pairs[c, token] + 20 * p) / (after[c] + 20)
    return p


def loss(text, texts, own):
    """Mean loss of a text, without its own counts if it is one of ``texts``."""
    pairs, after = counts_of(texts)
    if own:
        mine, mine_after = counts_of([text])
        pairs.subtract(mine)
        after.subtract(mine_after)
    data = b"\n" * 3 + text
    return -sum(math.log(probability(data[j - 3 : j], data[j : j + 1], pairs, after)) for j in range(3, len(data))) / len(text)


def test_probabilities_add_up(words):
    """After any context, seen or not, at a start or not, with or without a document's own counts."""
    import numpy as np
    import pyarrow as pa

    texts = [words(i, 60).encode() for i in range(30)] + [b"\nx", b"\n\n\n", b"z"]
    part = pa.table({"block": pa.array([0] * len(texts), pa.int32()), "id": list(range(len(texts))), "text": texts, "mark": [False] * len(texts)})
    counts = lm._count_block(part)
    grams, n = counts.column("gram").to_numpy(), counts.column("n").to_numpy()
    model = lm.NgramModel(n[1:], grams[1:], int(n[0]))
    pairs, after = counts_of(texts)
    for context in (b"\n\n\n", b"\n\nk", texts[0][:3], texts[3][10:13], b"\x00\xff\x00", b"qqk", texts[5][-3:]):
        keys = np.array([int.from_bytes(context + bytes([w]), "big") for w in range(256)], np.uint32)
        slots, contexts = lm._places(model.grams, keys)
        none = [0] * lm.ORDER
        got = np.exp(-model.losses(slots, contexts, none, none, 0))
        assert got.sum() == pytest.approx(1, abs=1e-9)
        assert got == pytest.approx([probability(context, bytes([w]), pairs, after) for w in range(256)])
        own, own_after = counts_of([texts[0]])
        mine = [np.array([own[context[3 - k :], bytes([w])] for w in range(256)]) for k in range(lm.ORDER)]
        before = [np.full(256, own_after[context[3 - k :]]) for k in range(lm.ORDER)]
        assert np.exp(-model.losses(slots, contexts, mine, before, len(texts[0]))).sum() == pytest.approx(1, abs=1e-9)


def test_equal_to_the_formula(spark, words):
    texts = [words(i, 12) for i in range(12)] + ["", None, "zzzz 1234 zzzz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(8)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in lm.cross_entropy_difference(docs, labels, F.col("quality") == 1).collect()}
    every = [t.encode() for t in texts if t]
    target = [texts[i].encode() for i in range(0, 8, 2)]
    for i, t in enumerate(texts):
        r = got[i]
        if not t:
            assert (r["n_tokens"], r["score"]) == (0, 0.0)
            continue
        inside = i < 8 and i % 2 == 0
        assert r["in_target"] == inside
        assert r["ce_background"] == pytest.approx(loss(t.encode(), every, True))
        assert r["ce_target"] == pytest.approx(loss(t.encode(), target, inside))
        assert r["score"] == pytest.approx(r["ce_target"] - r["ce_background"])


def test_junk_scores_above_prose(spark, words):
    rows = [(i, words(i, 40)) for i in range(40)] + [(100 + i, "".join(random.Random(i).choices("#$%&", k=200))) for i in range(5)]
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in lm.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), labels, F.col("quality") == 1).collect()}
    assert min(got[100 + i] for i in range(5)) > max(got[i] for i in range(40))


def test_edges(spark, odd_docs, odd_rows, no_docs, monkeypatch):
    labels = spark.createDataFrame([(4, 1), (4, 1), (None, 1), (9, None)], "doc_id long, quality int")
    got = lm.cross_entropy_difference(odd_docs, labels, F.col("quality") == 1)
    rows = got.collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(len((r[1] or "").encode()) for r in odd_rows)
    assert all(math.isfinite(r["score"]) for r in rows)
    none = lm.cross_entropy_difference(odd_docs, labels, F.col("quality") == 7)
    assert none.count() == len(odd_rows) and none.where("in_target").count() == 0
    assert lm.cross_entropy_difference(no_docs, labels, F.col("quality") == 1).count() == 0


def test_long_texts_in_pieces(monkeypatch, words):
    model = lm.NgramModel(__import__("numpy").zeros(lm.STARTS[-1], int))
    text = words(5, 300).encode()
    whole = lm.document_losses(text, model, model, lm._Scratch())
    monkeypatch.setattr(lm, "CHUNK", 100)
    assert lm.document_losses(text, model, model, lm._Scratch()) == pytest.approx(whole)


def test_counts_are_exact_and_grow(spark, monkeypatch):
    """Random characters: 800,000 places, few n-grams alike, which 2^20 buckets would not hold apart."""
    monkeypatch.setattr(lm, "BLOCK", 100_000)
    r = random.Random(3)
    texts = ["".join(chr(r.randrange(32, 127)) for _ in range(20_000)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 40, 3)], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in lm.cross_entropy_difference(docs, labels, F.col("quality") == 1).collect()}

    every = [t.encode() for t in texts]
    for i in (0, 1, 39):
        assert got[i]["ce_background"] == pytest.approx(loss(every[i], every, True), rel=1e-12)
        assert got[i]["ce_target"] == pytest.approx(loss(every[i], every[::3], i % 3 == 0), rel=1e-12)
