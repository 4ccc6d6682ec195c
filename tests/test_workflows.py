"""Prompt search, bootstrapping in rounds, whole corpora, stored responses, routing on any catalog: against plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernel.errors import BadInput
from quernel.operators import catalog, optimization, responses, scoring, search, sentiment
from quernel.operators.corpora import corpus_segments, numbered_units
from quernel.plans.workflows import QUALITY, _trial
from quernel.sources.documents import corpus
from quernel.sources.scratch import files_in, shared_path

# Prompt search ------------------------------------------------------------


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(20_000).withColumnRenamed("id", "example_id").cache()


def test_halving_finds_the_planted_program_with_a_tenth_of_the_calls(rows):
    programs = [optimization.Program(str(q)) for q in QUALITY]
    best, trials = search.successive_halving(_trial, programs, rows)
    assert best == 137 and trials.records[137].n == 20_000
    assert trials.calls == sum(t.n for t in trials.records) < 0.1 * len(programs) * 20_000


def test_halving_of_few_rows_and_ties(spark):
    few = spark.range(3).withColumnRenamed("id", "example_id")
    same = lambda programs, pairs: pairs.select("candidate", F.lit(1.0).alias("score"))
    best, trials = search.successive_halving(same, [optimization.Program(str(i)) for i in range(9)], few)
    assert best == 0 and trials.records[0].n == 3
    assert search.successive_halving(same, [optimization.Program()], few.limit(0))[0] == 0
    with pytest.raises(BadInput):
        search.successive_halving(same, [], few)


def worth(program):
    """An instruction and two demonstrations matter, the others don't."""
    return 300 + 250 * (program.instructions == "i3") + 150 * ({"d": 1} in program.demos) + 150 * ({"d": 5} in program.demos)


def test_the_surrogate_finds_a_planted_program_in_a_large_space(rows):
    space = search.Space([f"i{i}" for i in range(6)], [{"d": d} for d in range(10)], most=3)
    assert space.size() == 6 * (1 + 10 + 45 + 120)

    def trial(programs, pairs):
        return _trial([optimization.Program(str(worth(p))) for p in programs], pairs)

    best, trials = search.search_programs(trial, space, rows, batch=16, rounds=6, seed=3)
    assert worth(best) == 850
    assert len(trials.programs) == len({(p.instructions, str(p.demos)) for p in trials.programs}) <= 96 and trials.calls < 0.02 * space.size() * 20_000


def test_a_small_space_is_tried_whole(rows):
    space = search.Space(["a", "b"], [{"d": 0}], most=4)
    trial = lambda programs, pairs: pairs.select("candidate", search.by_candidate([F.lit(len(p.demos) + (p.instructions == "b") / 2) for p in programs]).alias("score"))
    best, trials = search.search_programs(trial, space, rows, batch=3)
    assert (best.instructions, best.demos) == ("b", [{"d": 0}]) and len(trials.programs) == space.size() == 4
    assert search.propose(space, {}, 9, random.Random(1)) != [] and set(search.propose(space, {}, 9, random.Random(1))) == {(0, ()), (0, (0,)), (1, ()), (1, (0,))}


def test_the_surrogate_is_the_posterior_of_a_linear_model():
    import numpy as np

    r = np.random.default_rng(1)
    x, n = r.integers(0, 2, (30, 4)).astype(float), r.integers(1, 9, 30).astype(float)
    y = x @ [0.3, -0.2, 0.1, 0.0] + r.normal(0, 0.1, 30)
    s = search.Surrogate(x, y, n)
    w = np.diag(n / 0.25)
    precision = np.eye(4) / 0.05 + x.T @ w @ x
    want = np.linalg.solve(precision, x.T @ w @ (y - np.average(y, weights=n)))
    assert np.allclose(s.coefficients, want)
    assert np.allclose(s.bound(x[:3], 2), s.mean + x[:3] @ want + 2 * np.sqrt([v @ np.linalg.inv(precision) @ v for v in x[:3]]))


# Bootstrapping ------------------------------------------------------------


def test_demos_are_the_first_in_hash_order_and_few_rows_are_held(spark):
    import hashlib

    for passing, copies in ((1000, 1), (3, 2), (0, 1)):
        keys = [*range(4000)] * copies + [None]
        scored = spark.createDataFrame([(k, 3 if k is not None and k < passing else 0) for k in keys], "example_id long, hits int").repartition(4)
        ordered = sorted((hashlib.md5(("0" if k is None else f"0#{k}").encode()).hexdigest(), k) for k in keys)
        first = [k for _, k in ordered if k is not None and k < passing][:4]
        want = ([(k, "bootstrapped") for k in first] + [(k, "labeled") for _, k in ordered if k not in first])[:8]
        assert [(r["example_id"], r["kind"]) for r in optimization.bootstrap_demos(scored).collect()] == want
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(key):
        seen.add(1)
        return 3

    optimization.bootstrap_demos(spark.range(20_000).withColumnRenamed("id", "example_id").withColumn("hits", counted("example_id")))
    assert 0 < seen.value < 2_000


def test_rounds_use_the_last_program_and_stop(spark):
    rows, teachers = spark.range(4000).withColumnRenamed("id", "example_id"), []

    def run(program, examples):
        teachers.append(len(program.demos))
        return examples.withColumn("hits", F.when(F.col("example_id") < 3 + 5 * len(program.demos), 3).otherwise(0))

    one = optimization.bootstrap_rounds(run, rows, bootstrapped=10, labeled=12)
    assert [d[1] for d in one.demos] == ["bootstrapped"] * 3 + ["labeled"] * 9 and one.scored == 4000 and set(teachers) == {0}
    teachers.clear()
    more = optimization.bootstrap_rounds(run, rows, bootstrapped=10, labeled=12, max_rounds=5)
    kinds = Counter(d[1:] for d in more.demos)
    assert kinds == {("bootstrapped", 1): 3, ("bootstrapped", 2): 7, ("labeled", 0): 2} and set(teachers) == {0, 3}
    assert len({d[0] for d in more.demos}) == 12
    # All pass: the first batch is enough.
    easy = optimization.bootstrap_rounds(lambda p, e: e.withColumn("hits", F.lit(3)), rows, max_rounds=3)
    assert easy.scored < 4000 / 32 and [d[1] for d in easy.demos] == ["bootstrapped"] * 4 + ["labeled"] * 4
    order = sorted(range(4000), key=lambda i: __import__("hashlib").md5(f"0#{i}".encode()).hexdigest())
    assert [d[0] for d in easy.demos] == order[:8]
    none = optimization.bootstrap_rounds(lambda p, e: e.withColumn("hits", F.lit(0)), rows, max_rounds=3)
    assert none.scored == 4000 and [d[1] for d in none.demos] == ["labeled"] * 8


# Whole corpora ------------------------------------------------------------


def texts():
    r = random.Random(4)
    pieces = ["One. Two! Three?", "a\n\nb", "  \n", "line\nline", "x\n \t\n\n y\n\n", "", "Ends. ", "no end", "é ß .\n\nz", None]
    return [(i, f"c{i % 5}" if i % 7 else None, "\n\n".join(r.choice(pieces) or "" for _ in range(r.randrange(4))) if i % 3 else r.choice(pieces)) for i in range(200)]


@pytest.mark.parametrize("options", [{"max_segments": 24}, {"max_segments": 1}, {}, {"max_segments": 3}])
def test_segments_equal_those_of_one_string(spark, options):
    rows = texts() + [(500, "single", "Only one. Paragraph here! Yes?"), (501, "single", " "), (502, "blank", "  "), (503, "one", "word"), (504, "many", "S one. S two. " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(7)
    got = {tuple(r) for r in corpus_segments(docs, ["source"], **options).collect()}
    joined = corpus(docs.where("text IS NOT NULL"), ["source"], ["doc_id"])
    most = options.get("max_segments", 24)
    want = sentiment.explode_segments(joined, most, "corpus", ("source",))
    assert got == {tuple(r) for r in want.collect()} and len(got) > 3


def test_one_corpus_of_all_documents_in_small_segments(spark):
    docs = spark.createDataFrame(texts(), "doc_id long, source string, text string")
    units = [r["__unit"] for r in sorted(numbered_units(docs).collect(), key=lambda r: r["__number"])]
    whole = corpus(docs.where("text IS NOT NULL"), [], ["doc_id"]).first()["corpus"]
    assert units == [p.strip() for p in re.split(r"\n\s*\n", whole) if p.strip()]
    got = sorted(map(tuple, corpus_segments(docs, units_per_segment=3).collect()))
    assert got == [(i, " ".join(units[3 * i : 3 * i + 3])) for i in range(math.ceil(len(units) / 3))]
    with pytest.raises(BadInput):
        corpus_segments(docs, max_segments=2, units_per_segment=2)


def test_repeated_rows_and_equal_order(spark):
    rows = [(1, "a\n\nb")] * 3 + [(1, "c"), (2, "d"), (None, "e")]
    units = numbered_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["__number"] for r in units) == list(range(9)) and {r["__total"] for r in units} == {9}
    assert Counter(r["__unit"] for r in units) == {"a": 3, "b": 3, "c": 1, "d": 1, "e": 1}
    assert [r["__unit"] for r in sorted(units, key=lambda r: r["__number"])][0] == "e"
    assert corpus_segments(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# Stored responses ---------------------------------------------------------


@pytest.fixture
def store(spark):
    return responses.ResponseStore(spark, shared_path(spark, "test-store"))


def counting(spark, fails=None):
    calls = spark.sparkContext.accumulator(0)

    def model(segments, indexes):
        if fails and fails in segments:
            raise ValueError("lost")
        calls.add(len(segments))
        return [(f"{s}-{i}", s[:1]) for s, i in zip(segments, indexes, strict=True)]

    return model, calls


def samples(spark, n, copies=2):
    rows = spark.range(n * copies).select(F.concat(F.lit("s"), (F.col("id") % n).cast("string")).alias("segment"), F.col("id").alias("row"))
    return scoring.resample(rows, 2)


def test_a_second_run_calls_nothing(spark, store):
    model, calls = counting(spark)
    first = responses.score_stored(samples(spark, 300), model, store).collect()
    assert calls.value == 600 and len(first) == 1200
    assert all(r["raw"] == f"{r['segment']}-{r['sample_idx']}" and r["rationale"] == "s" for r in first)
    again = responses.score_stored(samples(spark, 300), model, responses.ResponseStore(spark, store.folder)).collect()
    assert calls.value == 600 and sorted(again) == sorted(first)
    responses.score_stored(samples(spark, 350), model, store).count()
    assert calls.value == 700
    responses.score_stored(samples(spark, 10), model, store, model="other").count()
    assert calls.value == 720


def test_a_lost_run_repeats_its_open_batch_only(spark, store):
    key = lambda s, i: __import__("hashlib").md5(f"m#{i}#{s}".encode()).hexdigest()
    all_calls = [(s, i) for s in (f"s{n}" for n in range(300)) for i in (0, 1)]
    part = {c: int(key(*c)[:2], 16) // 64 for c in all_calls}
    bad = next(s for s, i in all_calls if part[s, i] == 2 and part[s, 1 - i] >= 2)
    model, calls = counting(spark, fails=bad)
    with pytest.raises(Exception, match="lost"):
        responses.score_stored(samples(spark, 300), model, store, model="m", batches=4, retries=0)
    done = sum(p < 2 for p in part.values())
    assert store.read().count() == done
    model, calls = counting(spark)
    assert responses.score_stored(samples(spark, 300), model, store, model="m", batches=4).count() == 1200
    assert calls.value == 600 - done


def test_texts_move_once(spark, store):
    """A segment is shuffled and written once for all its samples, and not at all where every call is known."""
    calls = scoring.resample(samples(spark, 50).select("segment"), 70).withColumn("sample_idx", F.col("sample_idx").cast("long"))
    texts = scoring.asked_texts(calls)
    assert texts.count() == 100 and texts.select("segment").distinct().count() == 50
    pairs = [(f"s{n}", i) for n in range(50) for i in range(70)]
    back = scoring.calls_of(texts, "bigint")
    assert sorted(map(tuple, back.collect())) == sorted(pairs) and back.dtypes == [("segment", "string"), ("sample_idx", "bigint")]
    model, asked = counting(spark)
    assert responses.score_stored(calls, model, store, batches=2).count() == 14000 and asked.value == 3500
    held = set(files_in(spark, store.folder.rsplit("/", 1)[0]))
    assert responses.score_stored(calls, model, store, batches=2).count() == 14000 and asked.value == 3500
    assert set(files_in(spark, store.folder.rsplit("/", 1)[0])) == held
    assert "Aggregate" not in store.read()._jdf.queryExecution().optimizedPlan().toString()


def test_compaction_and_runs_side_by_side(spark, store):
    answer = lambda raw, keys: spark.createDataFrame([(k, raw, "") for k in keys], "call string, raw string, rationale string")
    a, b = store.append(answer("x", ["00aa", "ff01"])), store.append(answer("y", ["00aa", "7f02"]))
    held = {r["call"]: r["raw"] for r in store.read().collect()}
    assert held == {"00aa": "x" if a < b else "y", "ff01": "x", "7f02": "y"}
    answer("half", ["1234"]).withColumn("bucket", F.lit(18)).write.partitionBy("bucket").parquet(f"{store.folder}/batches/open")  # no commit
    store.compact()
    assert len(store.batches()) == 1 and {r["call"]: r["raw"] for r in store.read().collect()} == held
    store.clean()
    assert files_in(spark, f"{store.folder}/batches") == store.batches() and {r["call"]: r["raw"] for r in store.read().collect()} == held
    assert responses.ResponseStore(spark, store.folder + "-none").read().collect() == []


# Routing ------------------------------------------------------------------

NAMES = st.text("abcAB é1", min_size=1, max_size=6)


def ranks(request, skills, top):
    words = lambda t: set(re.findall("[a-z0-9]+", t.casefold()))
    marks = [(-len(words(request or "") & words(f"{n} {d or ''}")), n) for n, d in skills.items()]
    return [(n, -m) for m, n in sorted(marks, key=lambda x: (x[0], x[1].encode()))[:top]]


@settings(max_examples=12, deadline=None)
@given(st.dictionaries(NAMES, st.text("abc d", max_size=12) | st.none(), max_size=14), st.lists(st.text("abcd é1", max_size=10) | st.none(), min_size=1, max_size=6), st.integers(0, 4), st.integers(1, 3))
def test_ranks_are_the_same_however_common_words_are(spark, skills, asked, common, top):
    table = spark.createDataFrame(list(skills.items()), "name string, description string")
    requests = spark.createDataFrame(list(enumerate(asked)), "i int, request string")
    got = {r["i"]: [tuple(x) for x in r["ranked"]] for r in catalog.rank_skills(requests, table, top=top, common=common).collect()}
    assert got == {i: ranks(t, skills, top) for i, t in enumerate(asked)}


@pytest.mark.parametrize("n", [10, 1000, 1001, 3000])
def test_one_answer_at_every_size_of_the_catalog(spark, n):
    skills = {f"skill {i:05d}": f"does the thing number {i % 97}" for i in range(n)}
    table = spark.createDataFrame(list(skills.items()), "name string, description string")
    asked = ["the thing 00007", "nothing in common", "does thing number 5", "SKILL 00003 ", None]
    got = catalog.route(spark.createDataFrame(list(enumerate(asked)), "i int, request string"), table)
    ranked = {r["i"]: [tuple(x) for x in r["ranked"]] for r in catalog.rank_skills(got.select("i", "request"), table).collect()}
    assert ranked == {i: ranks(t, skills, 2) for i, t in enumerate(asked)}
    skill = {r["i"]: (r["skill"], r["reason"]) for r in got.collect()}
    assert skill[0][0] == "skill 00007" and skill[1] == (None, "ambiguous") and skill[3] == ("skill 00003", "exact name match") and skill[4] == (None, "ambiguous")


def test_a_selector_sees_a_shortlist(spark):
    skills = [(f"s{i:03d}", "common words" if i % 2 else "other") for i in range(200)]
    table = spark.createDataFrame(skills, "name string, description string")
    asked = spark.createDataFrame([(1, "common words"), (2, "none such"), (3, "s004"), (4, "common words")], "i int, request string")
    calls = spark.sparkContext.accumulator(0)

    def choose(text, offered):
        calls.add(1)
        assert len(offered) == 5 and offered == sorted(offered) and all(d for _, d in offered)
        return offered[-1][0] if text == "common words" else "s199"

    got = {r["i"]: (r["skill"], r["reason"]) for r in catalog.route(asked, table, selector=choose, shortlist=5).collect()}
    assert got == {1: ("s009", "selector"), 2: (None, "ambiguous"), 3: ("s004", "exact name match"), 4: ("s009", "selector")}
    assert calls.value == 2


# Costs --------------------------------------------------------------------


def test_each_row_is_retried_alone_and_counted(spark):
    waits = spark.sparkContext.accumulator(0)

    def call(segment, index):
        if segment == "bad":
            raise ValueError("refused")
        if segment == "slow" and index == 0:
            raise TimeoutError("busy")
        return f"{segment}{index}", "why"

    rows = spark.createDataFrame([("ok", 0), ("bad", 0), ("slow", 0), ("slow", 1), ("ok", 1)], "segment string, sample_idx int")
    scored = scoring.score_each(rows, call, retries=2, sleep=lambda s: waits.add(1))
    got = {(r["segment"], r["sample_idx"]): (r["raw"], r["attempts"], r["error"]) for r in scored.collect()}
    assert got == {("ok", 0): ("ok0", 1, None), ("ok", 1): ("ok1", 1, None), ("slow", 1): ("slow1", 1, None), ("bad", 0): (None, 1, "ValueError: refused"), ("slow", 0): (None, 3, "TimeoutError: busy")}
    assert waits.value == 2
    told = scoring.call_costs(scored, price_sent=1e6, price_received=2e6).first().asDict()
    assert told == {"calls": 5, "attempts": 7, "failed": 2, "sent": 2 + 2 + 3 + 12 + 4, "received": 3 + 3 + 3 + 3 + 5 + 3, "cost": pytest.approx(23 + 2 * 20)}
    assert scoring.call_costs(scored.limit(0)).first()["calls"] == 0


# Fetching -----------------------------------------------------------------


@pytest.fixture(scope="module")
def server():
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    seen = []

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((time.monotonic(), self.path))
            again = sum(p == self.path for _, p in seen) > 1
            status = {"/gone": 404, "/down": 503}.get(self.path, 200 if again or not self.path.startswith("/busy") else 429)
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/page")
                self.end_headers()
                return
            body = f"<p>{self.path}</p>".encode()
            self.send_response(status)
            self.send_header("Content-Type", "Text/HTML; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_address[1]}", seen
    httpd.shutdown()


def test_a_server_is_fetched_at_its_rate_with_retries(spark, server):
    from quernel.sources import web

    base, seen = server
    seen.clear()
    paths = ["/page", "/moved", "/gone", "/down", "/busy1", "/busy2", "/a", "/b"]
    urls = spark.createDataFrame([(base + p,) for p in paths] + [("file:///etc/hosts",), ("http://127.0.0.1:1/none",)], "url string").repartition(4)
    got = {r["origin"].removeprefix(base): r for r in web.fetch(urls, web.http_fetcher(timeout=5), clients=3, apart=0.02, sleep=lambda s: None).collect()}
    assert len(got) == 10
    for path in ("/page", "/a", "/b", "/busy1", "/busy2"):
        assert (got[path]["status"], bytes(got[path]["content"]).decode(), got[path]["content_type"], got[path]["error"]) == (200, f"<p>{path}</p>", "text/html", None)
    assert bytes(got["/moved"]["content"]) == b"<p>/page</p>"
    assert (got["/gone"]["status"], got["/gone"]["content"], got["/gone"]["error"]) == (404, None, "status 404")
    assert (got["/down"]["status"], got["/down"]["error"]) == (503, "status 503") and sum(p == "/down" for _, p in seen) == 3
    assert got["file:///etc/hosts"]["error"].startswith("unsupported") and got["http://127.0.0.1:1/none"]["status"] is None
    times = sorted(t for t, p in seen if p != "/page")
    assert len(times) > 8 and times[-1] - times[0] >= 0.02 * (len(times) - 2) * 0.9


def test_turns_of_a_host():
    from quernel.sources.web import HostTurns

    slept, turns = [], HostTurns(1.0, clock=lambda: 100.0, sleep=lambda s: slept.append(s))
    for url in ("http://a/x", "http://b/x", "http://A/y", "http://a/z"):
        turns.wait(url)
    assert slept == [1.0, 2.0]


def test_fetching_goes_on_where_it_was(spark, server):
    from quernel.sources import web

    base, seen = server
    seen.clear()
    store = web.PageStore(spark, shared_path(spark, "test-pages"))
    paths = [f"/n{i}" for i in range(60)] + ["/gone", "/down"]
    urls = spark.createDataFrame([(base + p,) for p in paths * 2], "url string")
    key = lambda p: __import__("hashlib").md5((base + p).encode()).hexdigest()
    last = next(p for p in paths if int(key(p)[:2], 16) >= 192 and p.startswith("/n"))
    plain = web.http_fetcher(timeout=5)

    def lost(url):
        if url.endswith(last):
            raise RuntimeError("lost")
        return plain(url)

    with pytest.raises(Exception, match="lost"):
        web.fetch_stored(urls, lost, store, batches=4, retries=0)
    held = store.read().count()
    assert 0 < held == sum(int(key(p)[:2], 16) < 192 and p != "/down" for p in paths)
    seen.clear()
    got = web.fetch_stored(urls, plain, store, batches=4, retries=0).collect()
    assert len(got) == 61 and {r["origin"].removeprefix(base) for r in got} == set(paths) - {"/down"}
    asked = [p for _, p in seen if p != "/down"]
    assert len(asked) == 61 - held
    seen.clear()
    assert web.fetch_stored(urls, plain, store, retries=0).count() == 61 and {p for _, p in seen} == {"/down"}


# Sessions as state --------------------------------------------------------


def test_a_stream_of_turns_equals_the_batch_and_goes_on_after_a_restart(spark, tmp_path):
    from quernel.operators import conversations
    from quernel.streaming import chats

    r = random.Random(1)
    rows = [(s, t, f"text {s} {t} " * r.randrange(3)) for s in range(8) for t in range(r.randrange(1, 9))]
    turns = spark.createDataFrame(rows, "session long, turn long, text string")
    told = lambda history, text: f"{len(history)}|{text}|{'/'.join(h['text'] for h in history)}"
    for i, part in enumerate(("turn < 2", "turn = 2", "turn > 2")):
        turns.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = chats.write_answers(chats.answered(chats.turns_stream(spark, f"{tmp_path}/in", turns.schema), told), f"{tmp_path}/out", f"{tmp_path}/cp")
        query.awaitTermination(120)
        assert query.exception() is None, i
    got = {(x["session"], x["turn"]): (x["n_history"], x["answer"]) for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = conversations.respond(conversations.with_history(turns, "session", "turn", ("text",)), told)
    assert got == {(x["session"], x["turn"]): (x["n_history"], x["answer"]) for x in batch.collect()} and len(got) == len(rows)
