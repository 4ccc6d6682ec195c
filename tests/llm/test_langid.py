import binascii
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import langid

STEMS = {"aa": "ka mo ti re lu", "bb": "sché für über ein ung", "cc": "ción los que ñando el"}


def held(i):
    return binascii.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def docs(spark, words):
    rows = [(i, words(i, 5 + i % 40, STEMS[k]), k, "s") for i in range(600) for k in [list(STEMS)[i % 3]]]
    rows += [(1000 + i, words(i, 20, STEMS["aa"]), None, "s") for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_held_out_accuracy_and_calibration(docs):
    got = langid.identify_language(docs, per_language=60).join(docs, "doc_id").collect()
    assert all(r["held_out"] == held(r["doc_id"]) for r in got)
    out = [r for r in got if r["held_out"] and r["lang"]]
    assert len(out) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got) and np.mean([r["score"] for r in out]) > 0.9
    assert {r["lang_pred"] for r in got if r["lang"] is None} == {"aa"}


def test_learns_only_from_rows_that_are_not_held_out(docs):
    wrong = docs.withColumn("lang", F.when(langid.held_out(), F.lit("wrong")).otherwise(F.col("lang")))
    model, other = langid.train_on_documents(docs, 40), langid.train_on_documents(wrong, 40)
    assert model.languages == other.languages == list(STEMS)
    assert np.array_equal(model.weights, other.weights) and np.array_equal(model.idf, other.idf)
    assert 0 < np.mean(model.weights != 0) < 0.5


def test_document_frequencies_cover_all_rows(spark):
    rows = spark.createDataFrame([("ab",), ("abab",), ("é",)], "text string")
    df, n = langid.document_frequencies(rows)
    assert n == 3 and df[langid.counts_of("ab")[0]].max() >= 2
    for text in ("ab", "é"):
        assert (df[langid.counts_of(text)[0]] >= 1).all()


def test_temperature_softens_overconfident_scores():
    r = np.random.default_rng(0)
    labels = r.integers(0, 3, 400)
    logits = np.eye(3)[np.where(r.random(400) < 0.7, labels, r.integers(0, 3, 400))] * 30
    assert langid.fit_temperature(logits, labels) > 5


def brute_counts(text):
    """Features of all n-grams of a text, one by one with whole numbers."""
    padded, out = [ord(c) if c.isalpha() else 32 for c in f" {text.lower()} "], Counter()
    for at in range(len(padded)):
        h = 0
        for n, multiplier in enumerate(langid.MULTIPLIERS):
            if at + n >= len(padded):
                break
            h = (h * (63 + 2 * n) + padded[at + n]) * multiplier % (1 << 32)
            h ^= h >> 15
            out[h >> 16] += 1
    return out


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 200, 1 << 20])
def test_features_equal_brute_force_in_any_pieces(monkeypatch, words, chunk):
    monkeypatch.setattr(langid, "CHUNK", chunk)
    for text in ["", "a", "ab", "a1 b", "İΣ Σ", "日本語 x", words(1, 60, STEMS["bb"]), words(2, 33, STEMS["cc"]) + "\n"]:
        assert dict(zip(*map(list, langid.counts_of(text)), strict=True)) == brute_counts(text)


def test_weights_equal_brute_force(monkeypatch):
    """Follow-the-regularised-leader with dictionaries, and TF-IDF by its formula."""
    monkeypatch.setattr(langid, "FEATURES", 50)
    r = np.random.default_rng(3)
    idf, rows = r.random(50) + 1, []
    model = langid.LanguageModel(list("abc"), idf, np.zeros((50, 3)), np.zeros(3))
    for i in range(40):
        found = np.sort(r.choice(50, 8, replace=False))
        counts = r.integers(1, 5, 8)
        x = [(1 + math.log(c)) * idf[f] for f, c in zip(found, counts, strict=True)]
        norm = math.sqrt(sum(v * v for v in x))
        assert model.vector(found, counts) == pytest.approx([v / norm for v in x])
        rows.append((found, model.vector(found, counts), i % 3))
    got, bias = langid.fit_ftrl(rows, 3, epochs=2)
    z, n, alpha, beta, l1, l2 = {}, {}, 1.0, 1.0, 0.002, 0.01

    def w(key):
        v = z.get(key, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n.get(key, 0.0))) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for i in order.permutation(len(rows)):
            found, values, label = rows[i]
            x = [*zip(found.tolist(), values.tolist(), strict=True), (50, 1.0)]
            old = {(f, c): w((f, c)) for f, _ in x for c in range(3)}
            e = [math.exp(sum(v * old[f, c] for f, v in x)) for c in range(3)]
            for f, v in x:
                for c in range(3):
                    g, k = v * (e[c] / sum(e) - (c == label)), (f, c)
                    z[k] = z.get(k, 0.0) + g - (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / alpha * old[k]
                    n[k] = n.get(k, 0.0) + g * g
    assert got == pytest.approx(np.array([[w((f, c)) for c in range(3)] for f in range(50)]))
    assert bias == pytest.approx([w((50, c)) for c in range(3)])


def test_the_sample_is_bounded_in_all(docs, monkeypatch):
    seen, fit = [], langid.fit_ftrl
    monkeypatch.setattr(langid, "fit_ftrl", lambda rows, classes: seen.append(len(rows)) or fit(rows, classes))
    model, full = (langid.train(docs, F.xxhash64("doc_id"), "text", "lang", most_rows=n) for n in (30, 20_000))
    assert np.array_equal(model.idf, full.idf) and 10 < seen[0] < 45 and seen[1] > 400


def test_edges(odd_docs, odd_rows, no_docs):
    got = langid.identify_language(odd_docs)
    rows = got.collect()
    assert len(rows) == len(odd_rows)
    texts = {r[0]: r[1] for r in odd_rows if r[0] != 5}
    for r in rows:
        if r["doc_id"] in texts:
            letters = any(map(str.isalpha, texts[r["doc_id"]] or ""))
            assert r["lang_pred"] == ("en" if letters else "und") and r["held_out"] == (r["doc_id"] is not None and held(r["doc_id"]))
    assert langid.identify_language(no_docs).count() == 0
    untrained = langid.identify_language(odd_docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in untrained.collect()} == {("und", 0.0)}
    model = langid.train_on_documents(odd_docs)
    assert langid.predict(odd_docs, model).columns == [c for c in odd_docs.columns if c != "score"] + ["lang_pred", "score"]
