import json
import re

import pytest
from pyspark.sql import functions as F

from quernel.errors import BadInput, BadSettings, CallFailed, NoSkill
from quernel.operators import catalog, conversations, evaluation, optimization, scoring, sentiment
from quernel.plans import reports
from quernel.plans.pipeline import Pipeline
from quernel.sources import documents, jsonl, sessions, settings, skills, web
from quernel.streaming import ingest


def test_retry():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise CallFailed("busy", status=503)
        return "done"

    assert scoring.call_with_retry(flaky, 2, waits.append) == "done" and waits == [1.0, 2.0]
    for error, n in ((CallFailed("bad", status=400), 1), (TimeoutError(), 3), (ValueError(), 1)):
        calls.clear()

        def fail(e=error):
            calls.append(1)
            raise e

        with pytest.raises(type(error)):
            scoring.call_with_retry(fail, 2, waits.append)
        assert len(calls) == n


def test_concurrent_calls_are_bounded_and_retried_alone(spark):
    import asyncio

    tried, under_way, most = [], [], []

    async def call(segment, index):
        tried.append(segment)
        under_way.append(1)
        most.append(len(under_way))
        await asyncio.sleep(0.01)
        under_way.pop()
        if segment == "b" and tried.count("b") == 1:
            raise CallFailed("busy", status=429)
        return index, segment.upper()

    assert scoring.concurrent(call, at_once=2)("abcd", [0, 1, 2, 3]) == [(0, "A"), (1, "B"), (2, "C"), (3, "D")]
    assert max(most) == 2 and sorted(tried) == list("abbcd")

    async def broken(segment, index):
        tried.append(segment)
        raise CallFailed("bad", status=400)

    with pytest.raises(CallFailed):
        scoring.concurrent(broken)(["x"], [0])
    assert tried.count("x") == 1

    async def length(segment, index):
        return len(segment), ""

    rows = spark.createDataFrame([("aa", 0), ("b", 0)], "segment string, sample_idx int")
    assert {r["segment"]: r["raw"] for r in scoring.score_with(rows, scoring.concurrent(length), retries=0).collect()} == {"aa": "2", "b": "1"}


def test_scorer_runs_each_distinct_call_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def scorer(segments, indexes):
        with open(log, "a") as f:
            f.writelines(f"{s}|{i}\n" for s, i in zip(segments, indexes, strict=True))
        return [(" 7 " if i else "oops", "" if i == 2 else f"r{i}") for i in indexes]

    docs = spark.createDataFrame([(1, "Same text here."), (2, "Same text here."), (3, " ")], "doc_id int, text string")
    cut = scoring.resample(sentiment.explode_segments(docs), 3)
    scored = sentiment.coerced(scoring.score_distinct(cut, scorer, parallelism=1)).cache()
    rows = sentiment.segment_level(scored).collect()
    assert {r["doc_id"]: (r["seg_mean"], r["rationale"]) for r in rows} == {1: (14 / 3, "r1"), 2: (14 / 3, "r1")}
    with open(log) as f:
        assert len(f.readlines()) == 3
    report = sentiment.explain(sentiment.document_level(sentiment.segment_level(scored))).first().asDict()
    text = reports.sentiment_report(report, ["a.txt"])
    assert text.startswith("Positive, +4.67 on a scale") and "Read from a.txt." in text and "Too little text" in text


def test_lexicon(spark):
    docs = spark.createDataFrame([(1, "Flawless and great. Terrible, awful."), (2, None)], "doc_id int, text string")
    got = sentiment.sentiment(docs, lambda s, i: scoring.lexicon_score(s)).collect()
    assert [(r["doc_id"], r["mean"], r["n_segments"]) for r in got] == [(1, 0.0, 2)]


def test_file_sources(spark, tmp_path):
    (tmp_path / "b.TXT").write_bytes(b"line\r\nbad \xff byte\r")
    (tmp_path / "a.html").write_text("<html><head><title>t</title></head><body><p>Hi &eacute; <b>you</b></p><script>x</script><svg><svg></svg>in</svg></body></html>", encoding="utf-8")
    (tmp_path / "blank.md").write_text(" \n")
    paths = [str(tmp_path / n) for n in ("b.TXT", "a.html", "blank.md")]
    both = documents.union_in_order(documents.files(spark, paths), documents.literals(spark, ["  one ", " "]))
    rows = documents.with_text(both).orderBy("kind_ord", "arg_ord").collect()
    assert [r["text"] for r in rows] == ["one", "line\nbad � byte", "Hi é\nyou"]
    with pytest.raises(Exception, match="no text in"):
        documents.with_text(documents.files(spark, paths), strict=True).collect()
    with pytest.raises(BadInput):
        documents.files(spark, [str(tmp_path / "none.txt")])
    assert documents.corpus(documents.with_text(both)).first()["corpus"].startswith("one\n\nline")


def test_files_under_keeps_no_names_on_the_driver(spark, tmp_path):
    held = {"a b/0/1.html": b"<p>one</p>", "a b/0/2.HTM": b"", "a b/1/%20 ü.txt": b"x\r\ny", "a b/1/_no.txt": b"hidden", "a b/1/in/deep.txt": b"deep"}
    for name, body in held.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    (tmp_path / "void").mkdir()
    got = documents.files_under(spark, f"{tmp_path}/a b/*/*")
    assert got.inputFiles() == []  # Spark's own reader lists every file on the driver
    named = documents.files(spark, [str(tmp_path / name) for name in held if name.endswith(("1.html", "deep.txt")) or "%20" in name])
    empty = (f"file:{tmp_path}/a b/0/2.HTM", "")  # that reader passes over empty files, too
    assert sorted((r["origin"], r["text"]) for r in got.collect()) == sorted([*((r["origin"], r["text"]) for r in named.collect()), empty])
    one = documents.files_under(spark, f"file://{tmp_path}/a b/{{0/?.html,1/*.pdf}}").collect()
    assert [r["text"] for r in one] == ["one"]
    assert documents.files_under(spark, f"{tmp_path}/void").collect() == []
    for none in ("void/*", "a b/*/*.pdf", "a b/0/1.html/*", "nope/*"):
        with pytest.raises(BadInput, match="no file matches"):
            documents.files_under(spark, f"{tmp_path}/{none}")


def test_pages(spark):
    answers = {"http://a/x": (200, "Text/HTML; charset=utf-8", b"<p>A</p>"), "https://b": (200, "text/plain", b"B"), "http://c": (404, "", b"")}

    def fetcher(url):
        if url not in answers:
            raise BadInput("no route")
        return answers[url]

    urls = spark.createDataFrame([(u,) for u in [*answers, "ftp://d", "http://e"]], "url string")
    got = web.fetch(urls, fetcher, clients=2).cache()
    errors = {r["origin"]: r["error"] for r in got.where("error IS NOT NULL").collect()}
    assert errors == {"http://c": "status 404", "ftp://d": "unsupported scheme (http and https only)", "http://e": "no route"}
    text = documents.fetched(got.where("error IS NULL").withColumn("arg_ord", F.lit(0).cast("long")))
    assert {r["origin"]: r["text"] for r in text.collect()} == {"http://a/x": "A", "https://b": "B"}
    listing = json.dumps({"data": [{"id": "m"}, {}]})
    assert spark.range(1).select(web.model_ids(F.lit(listing))).first()[0] == ["m", ""]
    served = {"http://h/health": (200, "", b""), "http://h/v1/models": (200, "", listing.encode())}
    assert web.probe("http://h/v1", lambda u: served[u]) == {"healthy": True, "models": ["m", ""]}


def test_few_pages_of_a_batch_are_held_as_strings():
    import tracemalloc

    import pyarrow as pa

    html = pa.array([f"<p>{'x' * 20_000}</p>", None] * 640)  # 12.8 MB
    tracemalloc.start()
    got = documents._visible_text(html)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 1280 and got[1].as_py() is None and got[1278].as_py() == "x" * 20_000 and peak < 6e6
    assert documents._visible_text(pa.array([], pa.string())).to_pylist() == []


GOOD = '{"text": "t", "merchant": "m", "date": "d", "amount": 1.5}'


def test_json_lines(spark, tmp_path):
    def load(content):
        path = tmp_path / "rows.jsonl"
        path.write_text(content, encoding="utf-8")
        return jsonl.load(spark, str(path)).collect()

    assert [r["line"] for r in load(f"{GOOD}\n\n  \r\n{GOOD}\n")] == [1, 4]
    for content, message in ((f"{GOOD}\n{{bad", ":2: invalid JSON"), ('{"text": "t", "merchant": "m", "date": "d"}', ":1: schema error: amount"), (" \n", "no valid rows"), (f"{GOOD}\n[1]", ":2: schema error")):
        with pytest.raises(BadInput, match=message):
            load(content)
    with pytest.raises(BadInput):
        jsonl.load(spark, str(tmp_path / "none.jsonl"))
    (tmp_path / "in.json").write_text('{"a": 1}')
    assert jsonl.run_input(spark, "t", "ignored") == {"text": "t"} and jsonl.run_input(spark, path=str(tmp_path / "in.json")) == {"a": 1}
    (tmp_path / "in.json").write_text("[1]")
    with pytest.raises(BadInput):
        jsonl.run_input(spark, path=str(tmp_path / "in.json"))


def test_lines_are_numbered_where_they_are_read(spark, tmp_path):
    ends = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1e", "\x85", "\u2028", "\u2029", "\n\n", " \u2029\n", "\n\x85"]
    texts = {f"{k}.txt": "".join(f"{k}-{i}{'é' * (i * k % 97)}{ends[i * (k + 1) % len(ends)]}" for i in range(k * 17 + 1)) for k in range(6)}
    texts["blank.txt"], texts["none.txt"], texts["long.txt"] = "\n \n", "", f"a\n{'b' * 2_000}\nc\n"
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    want = sorted((name, i, line.strip()) for name, text in texts.items() for i, line in enumerate(text.splitlines(), 1) if line.strip())
    batch, most, cost = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    try:
        # Splits of a part of a line, a few lines, a few files; several in a task, and batches that end inside of them.
        for settings in ({most: "300"}, {most: "700", cost: "0", batch: "7"}, {most: "9000", cost: "0", batch: "10"}, {}):
            for key in (batch, most, cost):
                spark.conf.unset(key)
            for key, value in settings.items():
                spark.conf.set(key, value)
            got = jsonl.numbered_lines(spark, str(tmp_path))
            assert sorted((r["path"].rsplit("/", 1)[1], r["line"], r["value"]) for r in got.collect()) == want
    finally:
        for key in (batch, most, cost):
            spark.conf.unset(key)


def test_lines_are_not_shuffled_and_parsed_once(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text(f"{GOOD}\n{GOOD}\n")
    rows = jsonl.load(spark, str(tmp_path / "rows.jsonl"))
    plan = spark.sparkContext._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    dealt = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert dealt and not [x for x in dealt if "value#" in x or "lines#" in x]
    assert len(re.findall("(?i)parse_?json", rows._jdf.queryExecution().optimizedPlan().toString())) == 1


def manifest(root, name, text):
    (root / name).mkdir(parents=True)
    (root / name / "SKILL.md").write_text(text)


def test_skills(spark, tmp_path):
    for name, words in (("extract", "read payee day and sum out of a receipt"), ("chat", "go on with a talk")):
        manifest(tmp_path / "b", name, f"---\nname: {name}\ndescription: {words}\ntrainset: t.jsonl\n---\nbody")
    manifest(tmp_path / "u", "chat", '\n---\nname: chat\ndescription: "my: own"\nentrypoint: code:make\n---\n')
    manifest(tmp_path / "u", "bad", "no header")
    (tmp_path / "u" / "chat" / "code.py").write_text("def make():\n    return 42\n")
    good, bad = skills.discover(skills.scan(spark, str(tmp_path / "b"), str(tmp_path / "u")))
    assert [r["error"] for r in bad.collect()] == ["the header block is missing"]
    known = catalog.shadowed(good).cache()
    assert [r["name"] for r in catalog.names(known).collect()] == ["chat", "extract"]
    mine = catalog.get_skill(known, "chat")
    assert (mine["source"], mine["description"], mine["module"], mine["attr"]) == ("user", "my: own", "code", "make")
    assert catalog.load_attribute(mine["directory"].removeprefix("file:"), mine["entrypoint"], "user")() == 42
    assert [r["name"] for r in catalog.by_source(known, "builtin").collect()] == ["extract"]
    with pytest.raises(NoSkill, match="chat, extract"):
        catalog.get_skill(known, "none")
    assert catalog.route_one(spark, " EXTRACT ", known) == ("extract", "exact name match")
    assert catalog.route_one(spark, "which payee and sum", known)[0] == "extract"
    with pytest.raises(NoSkill):
        catalog.route_one(spark, "brew tea", known)
    asked = spark.createDataFrame([("tea",)], "request string")
    assert catalog.route(asked, known, selector=lambda r, c: "chat").first()["skill"] == "chat"
    assert catalog.route(asked, known, selector=lambda r, c: "made up").first()["skill"] is None
    assert known.where("name = 'extract'").select(skills.dataset_path(F.lit("/d/"), F.col("trainset"))).first()[0] == "/d/t.jsonl"


MANIFESTS = [
    ("---\nname: a\ndescription: >\n  one\n  two\n\n  three\n---\n", ("a", "one two\nthree\n", None)),
    ("---\r\nname: a\r\ndescription: |-\r\n  one\r\n    two\r\nversion: 1\r\n---", ("a", "one\n  two", None)),
    ("---\n# first\nname: a # short\ndescription: one\n  two: three\n# last\n---\n", ("a", "one two: three", None)),
    ('---\n  name: "a"\n  description: "say \\"no\\"" # so\n---\n', ("a", 'say "no"', None)),
    ("---\nname: 'a'\ndescription: 'it''s\n  long'\ntrainset: ~\n---\n", ("a", "it's long", None)),
    ("---\nname: a\n- item\n---\n", (None, None, "the header block must be a mapping")),
    ("---\nname: a\ncolour: red\n---\n", (None, None, "unknown fields: colour")),
    ("---\n---\n", (None, None, "name and description are needed")),
]


def test_manifest_headers(spark):
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(MANIFESTS)], "i int, text string")
    got = {r["i"]: r["m"] for r in rows.select("i", skills.parse_manifest(F.col("text")).alias("m")).collect()}
    for i, (_, (name, description, error)) in enumerate(MANIFESTS):
        assert got[i]["error"] == error
        assert error or (got[i]["name"], got[i]["description"], got[i]["trainset"]) == (name, description, None)


def test_a_manifest_is_taken_apart_once(spark):
    """The plan splits the header once, not anew for each field made of it."""
    plan = spark.createDataFrame([("---\nname: a\ndescription: b\n---",)], "text string").select(skills.parse_manifest(F.col("text")).alias("m")).select("m.name", "m.error")
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2


def test_model_names(spark):
    registry = catalog.model_registry(spark, {"big": {"model": "m", "ctx": 131072, "reasoning": "nothink"}, "baked": {"model": "Some@131072"}, "both": {"model": "x@1", "ctx": 2}, "tag": {"model": "org/model@latest"}}, "mine")
    got = {r["alias"]: r["model_string"] for r in catalog.model_aliases(registry).collect()}
    assert got == {"big": "openai/m::nothink@131072", "baked": "openai/Some::nothink@131072", "both": "openai/x::nothink@2", "tag": "openai/org/model@latest::nothink", "default": "openai/mine::nothink"}


def test_sessions_and_prompts(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"text": "q", "answer": 5, "x": 1}, {"text": "only"}, 3]')
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "object.json").write_text('{"text": "q"}')
    got = {r["session"]: (r["readable"], r["turns"]) for r in sessions.load_sessions(spark, str(tmp_path)).collect()}
    assert [tuple(t) for t in got["s"][1]] == [("q", "5")] and got["broken"] == (False, None) and got["object"] == (True, [])
    assert sessions.load_sessions(spark, str(tmp_path / "none")).count() == 0
    sessions.save_session(spark, str(tmp_path / "new"), "mine", [{"text": "é", "answer": "a"}])
    assert [tuple(t) for t in sessions.load_sessions(spark, str(tmp_path / "new")).first()["turns"]] == [("é", "a")]
    sessions.save_session(spark, str(tmp_path / "new"), "mine", [])
    assert sessions.load_sessions(spark, str(tmp_path / "new")).first()["turns"] == []
    with pytest.raises(BadInput):
        sessions.save_session(spark, str(tmp_path), "../escape", [])
    turns = sessions.append_turn(F.lit(None).cast(sessions.TURNS), F.lit("a"), F.lit("b"))
    assert spark.range(1).select(sessions.session_json(turns)).first()[0] == '[{"text":"a","answer":"b"}]'
    history = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "pos int, prompt string")
    once = conversations.distinct_in_order(history, "prompt", "pos")
    assert [r["prompt"] for r in once.orderBy("pos").collect()] == ["a", "b"]
    sessions.save_prompts(spark.range(1500).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("prompt")), str(tmp_path / "h"))
    kept = [r["prompt"] for r in sessions.prompt_lines(spark, str(tmp_path / "h" / "part-*")).orderBy("pos").collect()]
    assert kept == [str(i) for i in range(500, 1500)]
    assert [r["pos"] for r in conversations.most_recent_first(history).collect()] == [2, 1, 0]


def test_settings(spark, tmp_path):
    file = tmp_path / "c.toml"
    file.write_text('responses = "/kept"\nunknown = 1\n[models]\nname = "from file"\n[models.aliases.tiny]\nmodel = "t"\nctx = 8\n[endpoint]\nclients = 2\n[other]\nx = 1')
    env = {"OLLAMA_HOST": "http://h:1/", "OPENAI_MODEL": "injected", "CONTEXT": "12x", "QUERNEL_ENDPOINT_CLIENTS": "7", "QUERNEL_NONE": "?"}
    got = settings.load_settings(env=env, file=file, endpoint_secret="k", search_rounds=3)
    assert (got.models.name, got.endpoint.address, got.models.context, got.models.wanted()) == ("from file", "http://h:1/v1", None, "from file")
    assert got.endpoint.call_options() == {"retries": 2, "parallelism": 7} and got.search.options()["max_rounds"] == 3
    assert got.redacted()["endpoint"]["secret"] == "***" and got.store(spark).folder == "/kept"
    names = {r["alias"]: r["model_string"] for r in catalog.model_aliases(got.models.registry(spark)).collect()}
    assert names == {"tiny": "openai/t::nothink@8", "default": "openai/from file::nothink"}
    plain = settings.load_settings(env={"CONTEXT": "64"})
    assert (plain.models.context, plain.models.wanted(), plain.store(spark)) == (64, "default", None)
    for bad in ({"endpoint_secret": ""}, {"models_reasoning": "maybe"}, {"endpoint_clients": "x"}, {"endpoint_attempts": 0}):
        with pytest.raises(BadSettings):
            settings.load_settings(env={}, **bad)


NOTES = [("Lunch at Corner Cafe on 3/14/2026, paid $14.27", "Corner Cafe", "2026-03-14", 14.27), ("Taxi Co - Apr 2 2026 - 1,023.50 USD", "Taxi Co", "2026-04-02", 1023.5), ("Blue Books order #11-9, $129.99 charged 2026-01-09", "Blue Books", "2026-01-09", 129.99), ("Paper from Office Hut 21 Jun 2026 for 33.50", "Office Hut", "2026-06-21", 33.5), ("nothing here", "", None, None)]


def examples(spark):
    return spark.createDataFrame([(i, *n) for i, n in enumerate(NOTES)], "example_id int, text string, merchant string, date string, amount double")


def test_extraction_and_optimization(spark, tmp_path):
    rows = examples(spark)

    def run(program, data):
        found = evaluation.extract(data)
        wrong = found.withColumn("merchant", F.when(F.lit(bool(program.demos)), F.col("merchant")).otherwise(F.when(F.col("example_id") > 1, "x").otherwise(F.col("merchant"))))
        return evaluation.scored(evaluation.pair(data, wrong))

    full = evaluation.evaluate(evaluation.scored(evaluation.pair(rows, evaluation.extract(rows)))).first()
    assert full["n"] == 5 and full["score_frac"] >= 13 / 15
    out = optimization.optimize(run, rows, dev=rows, save_path=tmp_path / "deep" / "p.json")
    assert out.after > out.baseline and optimization.Program.load(out.save_path) == optimization.Program.load(tmp_path / "deep" / "p.json")
    assert 1 <= len(out.program.demos) <= 8
    assert optimization.optimize(run, rows, dev=rows, method="search", instructions=("a", "b")).program.instructions == "a"
    with pytest.raises(ValueError):
        optimization.optimize(run, rows, method="guess")
    with pytest.raises(BadInput):
        optimization.optimize(run, rows.limit(0))
    assert "a lift of +0.2500" in reports.optimization_report(0.5, 0.75)


def test_reports(spark):
    row = spark.range(1).select(F.lit(2.675).alias("mean"), F.lit(0.125).alias("std_error"), F.lit(None).cast("double").alias("p_value"))
    shown = reports.presented(row).first()
    assert (shown["mean"], shown["std_error"], shown["p_value"]) == (2.67, 0.125, None)
    assert reports.as_json(row.select("p_value", "mean")).first()[0] == '{"mean":2.675,"p_value":null}'
    with reports.observed(spark.range(10), "count") as (df, seen):
        df.collect()
    assert seen.calls == 10 and seen.elapsed_s > 0
    assert reports.fields_report({"b": 1, "a": 2}) == "a: 2\nb: 1" and reports.fields_report("plain") == "result: plain"
    chain = Pipeline().then(lambda d: d.where("id > 2")).then(lambda d: d.select((F.col("id") * 2).alias("x")))
    assert [r["x"] for r in chain(spark.range(5)).collect()] == [6, 8]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"One {i}. Two {i}!") for i in range(30)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.sentiment_stream(ingest.documents_stream(spark, str(tmp_path / "in"), files_per_trigger=1))
    ingest.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "mean", "polarity").collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(sentiment.sentiment(docs, scoring.stub_score))
