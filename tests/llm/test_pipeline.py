import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp


@pytest.fixture(scope="module")
def folder(spark, words, tmp_path_factory):
    """Two languages, a line that many documents share, copies, near copies, and rows to reject."""
    r, rows = random.Random(7), []
    for i in range(240):
        lang = ("aa", "bb")[i % 2]
        text = words(i, 60, "ka mo ti re lu" if i % 2 == 0 else "sché für über ein ung")
        rows.append((i, text + ("\nShared LINE of all" if i % 5 == 0 else ""), lang, f"s{i % 4}" if i % 9 else None))
    for i in range(30):
        w = rows[i][1].split("\n")[0].split(" ")
        if i % 3:
            w[r.randrange(len(w))] = "changed"
        rows.append((300 + i, " ".join(w), rows[i][2], "s1"))
    rows += [(400, None, "aa", "s1"), (401, "", None, "s1"), (402, "12 34 ?!", "aa", "s2"), (403, "\n\n", "aa", None)]
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    return str(out)


def read(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"], str(r)))


def test_stages_against_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r["doc_id"]: r for r in read(docs)}
    assert [k for k, _ in cp.STAGES] == ["language", "lines", "near_duplicates", "mixing", "tokens"]

    one = cp.staged(cp.language(spark, docs, folder), "t")
    assert one.columns == docs.columns
    assert {r["doc_id"] for r in read(one)} == set(before) - {400, 401, 402, 403}
    assert all(before[r["doc_id"]] == r for r in read(one))

    two = cp.staged(cp.lines(spark, one, folder), "t")
    count = Counter(x for r in read(one) for x in {y.strip().lower() for y in r["text"].split("\n")})
    for r in read(two):
        kept = "\n".join(x for x in before[r["doc_id"]]["text"].split("\n") if count[x.strip().lower()] < 10)
        assert r["text"] == kept and r["n_chars"] == len(kept)
    assert "Shared LINE of all" not in "".join(r["text"] for r in read(two))

    three = cp.staged(cp.near_duplicates(spark, two, folder), "t")
    assert {r["doc_id"] for r in read(three)} == set(range(240))

    four = cp.staged(cp.mixing(spark, three, folder), "t")
    times, size, taken = Counter(r["doc_id"] for r in read(four)), defaultdict(int), defaultdict(int)
    for r in read(three):
        size[r["source"]] += len(r["text"].split())
    for r in read(four):
        taken[r["source"]] += len(r["text"].split())
    assert max(times.values()) <= 2 and four.columns == docs.columns
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.05)

    library = Tokenizer.from_file(f"{cp.TOKENIZERS}/byte_bpe_50k.json")
    five = read(cp.tokens(spark, four, folder))
    assert len(five) == four.count()
    for r, text in zip(five, [x["text"] for x in read(four)], strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()

    assert read(cp.run(spark, folder)) == five


def test_an_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_the_classifier_rejects_long_texts_without_a_language(spark, monkeypatch):
    rows = [(1, "clean. " * 20, "aa", 0.9), (2, "junk!! " * 20, "bb", 0.4), (3, "short.", "aa", 0.4), (4, "x" * 100, "aa", 0.49), (5, "x" * 99, "aa", 0.49), (6, "y" * 100, "aa", 0.5), (7, None, "und", 0.0)]
    found = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double")
    monkeypatch.setattr(cp, "train_on_documents", lambda docs: None)
    monkeypatch.setattr(cp, "predict", lambda docs, model: found)
    kept = cp.language(spark, found.select("doc_id", "text"), "")
    assert kept.columns == ["doc_id", "text"]
    assert {r["doc_id"] for r in kept.collect()} == {1, 3, 5, 6}
