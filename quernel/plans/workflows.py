"""Standard queries that take several jobs: prompt search, bootstrapping, whole corpora, stored responses, large catalogs."""

from __future__ import annotations

import hashlib
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators import catalog, conversations, optimization, responses, scoring, search, sentiment
from quernel.operators.corpora import corpus_segments
from quernel.plans import reports
from quernel.plans.pipeline import Pipeline
from quernel.plans.queries import FIGURES, SAMPLES, SUMMARY, SUMMARY_COLUMNS, query, rounded, table, units_sql
from quernel.sources.scratch import shared_path
from quernel.streaming import chats

# Prompt search ------------------------------------------------------------

PROGRAMS = 200
#: Of a thousand rows a program gets so many right, by its number; number 137 is the best.
QUALITY = [900 if c == 137 else 400 + c * 37 % PROGRAMS * 2 for c in range(PROGRAMS)]
PLACE = "('0x' || substr(md5('0#' || o_orderkey), 1, 13))::BIGINT / 4503599627370496.0"


def _trial(programs: list[optimization.Program], pairs: DataFrame) -> DataFrame:
    """A stand-in for a model: by hash, a program gets its share of the rows right."""
    luck = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("#", F.col("candidate").cast("string"), F.col("example_id").cast("string"))), 1, 8), 16, 10).cast("bigint"), F.lit(1000))
    quality = search.by_candidate([F.lit(int(p.instructions)) for p in programs])
    return pairs.select("candidate", (luck < quality).cast("double").alias("score"))


def _rung(k: int, share: str, kept: int | None) -> str:
    among = f" AND c IN (SELECT c FROM k{k - 1})" if k else ""
    rung = f"r{k} AS (SELECT c, count(*) AS n, avg(hit) AS m FROM tries WHERE spot < {share}{among} GROUP BY c)"
    return rung if kept is None else f"{rung},\nk{k} AS (SELECT c FROM r{k} ORDER BY round(m, 9) DESC, c LIMIT {kept})"


@query(f"""
WITH progs AS (SELECT range AS c, CASE WHEN range = 137 THEN 900 ELSE 400 + range * 37 % {PROGRAMS} * 2 END AS quality FROM range({PROGRAMS})),
tries AS (SELECT c, spot, ((('0x' || substr(md5(c || '#' || o_orderkey), 1, 8))::BIGINT % 1000) < quality)::INT AS hit FROM progs, (SELECT o_orderkey, {PLACE} AS spot FROM orders)),
{_rung(0, "1 / 64.0", 50)}, {_rung(1, "1 / 16.0", 13)}, {_rung(2, "1 / 4.0", 4)}, {_rung(3, "1", None)}
SELECT c::INT AS program, rung::INT AS rung, n, round(m, 6) + 0.0 AS score FROM (SELECT *, 3 AS rung FROM r3 UNION ALL SELECT *, 2 FROM r2 UNION ALL SELECT *, 1 FROM r1 UNION ALL SELECT *, 0 FROM r0)
QUALIFY row_number() OVER (PARTITION BY c ORDER BY rung DESC) = 1
""")
def prompt_halving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred programs over all orders: what each scored on the last rung it reached."""
    programs = [optimization.Program(str(q)) for q in QUALITY]
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("example_id"))
    _, trials = search.successive_halving(_trial, programs, rows)
    told = [(i, t.rung, t.n, t.score) for i, t in enumerate(trials.records)]
    return rounded(spark.createDataFrame(told, "program int, rung int, n bigint, score double"), "score")


def _taught(program: optimization.Program, rows: DataFrame) -> DataFrame:
    """A stand-in: more rows are right under a program with more demonstrations."""
    return rows.withColumn("hits", F.when(F.col("example_id") < 6 + 2 * len(program.demos), 3).otherwise(1)).withColumn("score", F.col("hits") / 3.0)


@query(f"""
WITH rows AS (SELECT o_orderkey AS example_id, md5('0#' || o_orderkey) AS o, {PLACE} AS spot FROM orders),
one AS (SELECT example_id, o, 1 AS round FROM rows WHERE example_id < 6 ORDER BY o, example_id LIMIT 12),
two AS (SELECT example_id, o, 2 AS round FROM rows WHERE example_id < 6 + 2 * (SELECT count(*) FROM one) AND example_id NOT IN (SELECT example_id FROM one) ORDER BY o, example_id LIMIT 12 - (SELECT count(*) FROM one)),
three AS (SELECT example_id, o, 0 AS round FROM rows WHERE example_id NOT IN (SELECT example_id FROM one UNION ALL SELECT example_id FROM two) ORDER BY o, example_id LIMIT 4),
reached AS (SELECT min(s) AS s FROM (SELECT unnest([1 / 64.0, 1 / 16.0, 1 / 4.0, 1.0]) AS s) WHERE (SELECT count(*) FROM two JOIN rows USING (example_id) WHERE spot < s) = (SELECT count(*) FROM two)),
seen AS (SELECT (SELECT count(*) FROM rows) + (SELECT count(*) FROM rows, reached WHERE spot < s AND example_id NOT IN (SELECT example_id FROM one)) AS scored)
SELECT example_id, kind, round::INT AS round, (row_number() OVER (ORDER BY g, o, example_id) - 1)::INT AS position, scored
FROM (SELECT *, 'bootstrapped' AS kind, 1 AS g FROM one UNION ALL SELECT *, 'bootstrapped', 2 FROM two UNION ALL SELECT *, 'labeled', 3 FROM three), seen
""")
def bootstrap_in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve demonstrations: six pass without any, the others under the program that has those."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("example_id"))
    found = optimization.bootstrap_rounds(_taught, rows, bootstrapped=12, labeled=16, max_rounds=3)
    told = [(k, kind, number, i, found.scored) for i, (k, kind, number) in enumerate(found.demos)]
    return spark.createDataFrame(told, "example_id bigint, kind string, round int, position int, scored bigint")


# Whole corpora ------------------------------------------------------------

#: Every line a paragraph, for the test tables hold no blank lines.
SPREAD = "replace(text, chr(10), chr(10) || chr(10))"


def _spread(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


@query(f"""
WITH joined AS (SELECT source AS doc_id, string_agg({SPREAD}, chr(10) || chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY source), {units_sql(source="joined")}
SELECT doc_id AS source, (generate_subscripts(s, 1) - 1)::BIGINT AS seg_idx, length(unnest(s)) AS n_chars, md5(unnest(s)) AS digest FROM segs
""")
def corpus_segments_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source as one text, in 24 segments at most, without a task that sees it whole."""
    docs = _spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    cut = corpus_segments(docs, ["source"], max_segments=24)
    return cut.select("source", "seg_idx", F.char_length("segment").cast("bigint").alias("n_chars"), F.md5("segment").alias("digest"))


@query(f"""
WITH joined AS (SELECT 0 AS doc_id, string_agg({SPREAD}, chr(10) || chr(10) ORDER BY doc_id) AS text FROM documents),
{SUMMARY.replace("FROM documents),", "FROM joined),", 1).replace("ceil(len(u) / 24.0)::BIGINT AS sz", "8 AS sz", 1).replace("WHEN len(u) <= 24 THEN", "WHEN len(u) <= 1 THEN", 1)}
SELECT {SUMMARY_COLUMNS} FROM summary
""")
def whole_corpus_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one corpus, in segments of eight paragraphs."""
    cut = corpus_segments(_spread(table(spark, sf_dir, "documents").select("doc_id", "text")), units_per_segment=8)
    samples = scoring.resample(cut.withColumn("corpus", F.lit(0)), 3).withColumn("score", scoring.stub_score(F.col("segment"), F.col("sample_idx")))
    return rounded(sentiment.summarize_samples(samples, ("corpus",)).drop("corpus"), *FIGURES)


# Stored responses ---------------------------------------------------------


@query(f"""
WITH {SAMPLES}, told AS (SELECT count(*) AS calls, count(DISTINCT sample_idx || '#' || segment) AS fresh, sum(score)::BIGINT AS total FROM samples)
SELECT 1 AS run, calls, fresh AS asked, total FROM told UNION ALL SELECT 2, calls, 0, total FROM told
""")
def stored_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same samples scored twice with one store: the second run asks for nothing."""

    def model(segments, indexes):
        return [(int(hashlib.md5(f"{s}#{i}".encode()).hexdigest()[:8], 16) % 21 - 10, "") for s, i in zip(segments, indexes, strict=True)]

    store = responses.ResponseStore(spark, shared_path(spark, "responses"))
    samples = scoring.resample(sentiment.explode_segments(table(spark, sf_dir, "documents").select("doc_id", "text")), 3)
    out = []
    for run in (1, 2):
        held = store.read().count()
        scored = sentiment.coerced(responses.score_stored(samples, model, store, batches=2, retries=0))
        told = scored.agg(F.count("*").alias("calls"), F.sum("score").cast("bigint").alias("total")).first()
        out.append((run, told["calls"], store.read().count() - held, told["total"]))
    return spark.createDataFrame(out, "run int, calls bigint, asked bigint, total bigint")


# A catalog of any size ----------------------------------------------------

WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


@query(f"""
WITH cat AS (SELECT p_partkey || ' ' || p_name AS name, {WORDS.format("p_partkey || ' ' || p_name || ' ' || p_brand || ' ' || p_type")} AS w FROM part),
asked AS (SELECT c_custkey, {WORDS.format("'part ' || c_custkey || ' small red ring of brand 7 for ' || c_mktsegment")} AS r FROM customer),
pairs AS (SELECT c_custkey, name, len(list_intersect(r, w)) AS o FROM asked, cat),
ranked AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o DESC, name) AS rank FROM pairs QUALIFY rank <= 2)
SELECT c_custkey, rank::INT AS rank, name, o::INT AS overlap FROM ranked
""")
def rank_large_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' requests against all parts as a catalog, many of which share frequent words."""
    key = lambda c: F.col(c).cast("string")
    skills = table(spark, sf_dir, "part").select(F.concat_ws(" ", key("p_partkey"), "p_name").alias("name"), F.concat_ws(" ", "p_brand", "p_type").alias("description"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("part "), key("c_custkey"), F.lit(" small red ring of brand 7 for "), F.col("c_mktsegment")).alias("request"))
    ranked = catalog.rank_skills(asked, skills).select("c_custkey", F.posexplode("ranked").alias("p", "s"))
    return ranked.select("c_custkey", (F.col("p") + 1).alias("rank"), "s.name", "s.overlap")


@query(f"""
WITH cat AS (SELECT n_name AS name, {WORDS.format("n_name || ' region ' || n_regionkey || ' nation ' || n_nationkey")} AS w FROM nation),
asked AS (SELECT s_suppkey, {WORDS.format("'region ' || s_suppkey % 5 || ' for nation ' || s_nationkey")} AS r, 'region ' || s_suppkey % 5 || ' for nation ' || s_nationkey AS request FROM supplier),
ranked AS (SELECT s_suppkey, name, len(list_intersect(r, w)) AS o, lead(len(list_intersect(r, w))) OVER p AS nxt, row_number() OVER p AS rank FROM asked, cat WINDOW p AS (PARTITION BY s_suppkey ORDER BY len(list_intersect(r, w)) DESC, name))
SELECT s_suppkey, CASE WHEN o > 0 AND o > nxt THEN name END AS skill, CASE WHEN o > 0 AND o > nxt THEN 'keyword match (score ' || o || ')' ELSE 'ambiguous' END AS reason FROM ranked WHERE rank = 1
""")
def route_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' requests routed to nations."""
    key = lambda c: F.col(c).cast("string")
    skills = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("region "), key("n_regionkey"), F.lit(" nation "), key("n_nationkey")).alias("description"))
    asked = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("region "), (F.col("s_suppkey") % 5).cast("string"), F.lit(" for nation "), key("s_nationkey")).alias("request"))
    return catalog.route(asked, skills).select("s_suppkey", "skill", "reason")


# Costs and fetching -------------------------------------------------------

BUSY = "('0x' || substr(md5(segment || sample_idx), 1, 4))::BIGINT % 5"


@query(f"""
WITH {SAMPLES}, tried AS (SELECT doc_id, segment, score, least({BUSY} + 1, 4) AS attempts, {BUSY} = 4 AS lost FROM samples)
SELECT lang, count(*) AS calls, sum(attempts)::BIGINT AS attempts, count(*) FILTER (lost) AS failed, sum(attempts * length(segment))::BIGINT AS sent, coalesce(sum(length(score::INT::VARCHAR)) FILTER (NOT lost), 0)::BIGINT AS received,
    round((sum(attempts * length(segment)) * 2.0 + coalesce(sum(length(score::INT::VARCHAR)) FILTER (NOT lost), 0) * 6.0) / 1e6, 6) + 0.0 AS cost
FROM tried JOIN documents USING (doc_id) GROUP BY lang
""")
def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What scoring took by language: a model that is busy up to four times, and so fails for good at some calls."""

    last: dict[int, tuple] = {}  # a thread's open call, and its attempts so far

    def call(segment: str, index: int) -> tuple[object, str]:
        me, asked = threading.get_ident(), (segment, index)
        attempt = last[me][1] + 1 if last.get(me, (None,))[0] == asked else 1
        busy = int(hashlib.md5(f"{segment}{index}".encode()).hexdigest()[:4], 16) % 5
        last[me] = (asked, attempt) if attempt <= busy and attempt < 4 else (None, 0)
        if attempt <= busy:
            raise TimeoutError("busy")
        return int(hashlib.md5(f"{segment}#{index}".encode()).hexdigest()[:8], 16) % 21 - 10, ""

    cut = sentiment.explode_segments(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), keep=("doc_id", "lang"))
    scored = scoring.score_each(scoring.resample(cut, 3), call, retries=3, sleep=lambda s: None)
    return rounded(scoring.call_costs(scored, ["lang"], price_sent=2.0, price_received=6.0), "cost")


# Sessions as state --------------------------------------------------------


@query("""
SELECT conv_id, turn, row_number() OVER w - 1 AS n_history, 'after ' || least(3, row_number() OVER w - 1) || ' turns: ' || length(text) || coalesce(', last ' || length(lag(text) OVER w), '') AS answer
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def chat_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as a stream that stops after their first turns and goes on from its checkpoint; the last three turns are history."""
    folder = shared_path(spark, "chats")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")

    def answer(history, text):
        return f"after {len(history)} turns: {len(text)}" + (f", last {len(history[-1]['text'])}" if history else "")

    for part in ("turn < 3", "turn >= 3"):
        turns.where(part).write.mode("append").parquet(f"{folder}/turns")
        arriving = chats.turns_stream(spark, f"{folder}/turns", "conv_id long, turn long, text string").select(F.col("conv_id").alias("session"), "turn", "text")
        chats.write_answers(chats.answered(arriving, answer, last=3), f"{folder}/answers", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/answers").withColumnRenamed("session", "conv_id")


# Reports ------------------------------------------------------------------


@query(f"""
WITH joined AS (SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
{SUMMARY.replace("FROM documents),", "FROM joined),", 1)}
SELECT doc_id AS conv_id, upper(left(polarity, 1)) || substr(polarity, 2) || printf(', %+.2f on a scale from -10 to 10, over %d segments that differ by %.2f. ', round(mean, 9), n_segments, round(volatility, 9))
    || printf('%d samples put the model''s own spread at %.2f. ', n_samples, round(model_uncertainty, 9))
    || CASE WHEN p_value IS NULL THEN 'Too little text to test against neutral.' ELSE printf('Difference from neutral: %s (p %.4f, 95 %% between %+.2f and %+.2f).', confidence, round(p_value, 9), round(ci_low, 9), round(ci_high, 9)) END AS report
FROM summary
""")
def sentiment_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one corpus, its summary as a printed report."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    steps = Pipeline((lambda df: corpus_segments(df, ["conv_id"], ["turn"]), lambda df: scoring.resample(df, 3)))
    scored = steps.then(lambda df: df.withColumn("score", scoring.stub_score(F.col("segment"), F.col("sample_idx"))))(turns)
    found = rounded(sentiment.summarize_samples(scored, ("conv_id",)), *FIGURES, digits=9)
    names = [c for c in found.columns if c != "conv_id"]

    def printed(frames):
        for frame in frames:
            rows = frame[names].astype(object).where(frame[names].notna(), None).to_dict("records")
            yield frame[["conv_id"]].assign(report=[reports.sentiment_report(r) for r in rows])

    return found.mapInPandas(printed, "conv_id long, report string")


@query("SELECT conv_id * 1000 + turn AS pos, text AS prompt, row_number() OVER (ORDER BY conv_id * 1000 + turn DESC) AS nth FROM conversations WHERE role = 'user' ORDER BY pos DESC LIMIT 500")
def recent_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five hundred prompts, the latest first, as they would be listed."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.col("text").alias("prompt"))
    listed = conversations.most_recent_first(conversations.last_n(rows, 500)).collect()
    return spark.createDataFrame([(r["pos"], r["prompt"], i + 1) for i, r in enumerate(listed)], "pos bigint, prompt string, nth bigint")
