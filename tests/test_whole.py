"""Standard queries over whole inputs: nothing is left out for the sake of the comparison with SQL."""

import hashlib

from quernel.plans import queries as plans


def test_every_document_is_explained(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(plans.scoring, "stub_score", lambda segment, i: plans.F.element_at(plans.F.split(segment, " "), -1).cast("double"))
    texts = {1: "one 3", 2: "a 0.125\n\nb 0.125", 3: "a -0.001\n\nb -0.001", 4: "a 1\n\nb 2", 5: "  ", 6: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["explanation"] for r in plans.queries()["explanations"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    for i, figures in {1: "mean +3.00 over 1 segments, volatility 0.00", 2: "mean +0.12 over 2 segments, volatility 0.00", 3: "mean -0.00 over 2 segments, volatility 0.00", 4: "mean +1.50 over 2 segments, volatility 0.71"}.items():
        assert f"({figures})" in got[i], got[i]


def test_prompts_are_whole(spark, tmp_path):
    turns = [(1, 0, "user", "What is the price of tea?"), (1, 1, "assistant", "Two."), (1, 2, "user", "What is the price of salt?"), (2, 1, "user", "What is the price of tea?"), (2, 3, "user", "What is the price of oil?")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: {(r["pos"], r["prompt"]) for r in plans.queries()[name](spark, str(tmp_path)).collect()}
    first = {(1000, turns[0][3]), (1002, turns[2][3]), (2003, turns[4][3])}
    assert run("prompt_dedup_keep_first") == run("seeded_history") == first
    assert run("last_n_prompts") == first | {(2001, turns[0][3])}


def test_long_documents_reach_the_cut_of_excerpts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(plans.scoring, "stub_score", lambda segment, i: i.cast("double") * 2 - 1)
    texts = {1: "short one\n\nshort two", 2: "\n\n".join(f"{i} " + "x" * 300 for i in range(20))}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_chars"], r["digest"]) for r in plans.queries()["excerpts_2000"](spark, str(tmp_path)).collect()}
    want = {i: "\n".join(f"- (+1.0) {s}" for s in t.split("\n\n"))[:2000] for i, t in texts.items()}
    assert got == {i: (len(e), hashlib.md5(e.encode()).hexdigest()) for i, e in want.items()}
    assert got[2][0] == 2000
