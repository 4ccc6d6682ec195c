"""The standard queries: every operator over the whole tables of the test data, with its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.errors import BadInput, CallFailed
from quernel.functions import metrics, stats
from quernel.functions import text as tx
from quernel.operators import catalog, conversations, evaluation, optimization, scoring, sentiment
from quernel.plans import reports
from quernel.sources import documents as docsrc
from quernel.sources import jsonl, scratch, sessions, settings, skills, web

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that is read in fewer tasks than there are cores, as a single row group is, is dealt to all of them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(rows) if name in ("documents", "pages") else rows


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of which each takes long, dealt to all cores where fewer tasks read them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.rdd().getNumPartitions() < cores else rows


def query(sql: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL for the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounded, and with one kind of zero, so that the order of summation doesn't show."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


# Shared SQL ---------------------------------------------------------------

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
PIECES = f"lambda p: trim(p, {WS})), lambda p: p <> '')"


def units_sql(text: str = "text", cap: int = tx.DEFAULT_MAX_SEGMENTS, source: str = "documents") -> str:
    """Common table expressions up to ``segs(doc_id, s)``, the segments of each document."""
    return rf"""
blocks AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({text}, '\n\s*\n'), {PIECES} AS b FROM {source}),
units AS (SELECT doc_id, CASE WHEN len(b) >= 2 THEN b WHEN len(b) = 1 THEN
    list_filter(list_transform(string_split(regexp_replace(b[1], '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), {PIECES} ELSE [] END AS u FROM blocks),
sized AS (SELECT doc_id, u, ceil(len(u) / {cap}.0)::BIGINT AS sz FROM units),
segs AS (SELECT doc_id, CASE WHEN len(u) <= {cap} THEN u ELSE
    list_transform(range(0, ceil(len(u) / sz::DOUBLE)::BIGINT), lambda i: array_to_string(u[i * sz + 1 : i * sz + sz], ' ')) END AS s FROM sized)"""


SAMPLES = (
    units_sql()
    + """,
seg_rows AS (SELECT doc_id, unnest(s) AS segment, generate_subscripts(s, 1) - 1 AS seg_idx FROM segs),
samples AS (SELECT doc_id, seg_idx::INT AS seg_idx, segment, i::INT AS sample_idx,
    (('0x' || substr(md5(segment || '#' || i), 1, 8))::BIGINT % 21 - 10)::DOUBLE AS score FROM seg_rows, range(0, 3) t(i)),
by_seg AS (SELECT doc_id, seg_idx, count(*) AS n_samples, avg(score) AS m, coalesce(stddev_samp(score), 0) AS sd FROM samples GROUP BY ALL),
by_doc AS (SELECT doc_id, count(*) AS n, sum(n_samples)::BIGINT AS n_samples, avg(m) AS mean, coalesce(stddev_samp(m), 0) AS vol, avg(sd) AS unc FROM by_seg GROUP BY doc_id)"""
)
POLARITY = "CASE WHEN round(mean, 9) >= 6 THEN 'very positive' WHEN round(mean, 9) >= 2 THEN 'positive' WHEN round(mean, 9) > -2 THEN 'neutral / mixed' WHEN round(mean, 9) > -6 THEN 'negative' ELSE 'very negative' END"
CONFIDENCE = "CASE WHEN p IS NULL THEN 'insufficient-data' WHEN round(p, 9) < 0.01 THEN 'high' WHEN round(p, 9) < 0.05 THEN 'moderate' WHEN round(p, 9) < 0.1 THEN 'low' ELSE 'not-significant' END"
SUMMARY = (
    SAMPLES
    + f""",
errors AS (SELECT *, CASE WHEN n >= 2 THEN vol / sqrt(n) ELSE 0 END AS se, n - 1 AS df FROM by_doc),
angles AS (SELECT *, CASE WHEN n >= 2 AND se <> 0 THEN mean / se END AS t0 FROM errors),
waves AS (SELECT *, atan(abs(t0) / sqrt(df)) AS th FROM angles),
terms AS (SELECT *, cos(th) ^ 2 AS c2, CASE WHEN df % 2 = 1 THEN (df - 1) // 2 ELSE df // 2 END AS k FROM waves),
series AS (SELECT *, coalesce(list_sum(list_transform(range(1, k + 1), lambda i: coalesce(list_product(list_transform(range(1, i),
    lambda j: CASE WHEN df % 2 = 1 THEN 2.0 * j / (2 * j + 1) ELSE (2.0 * j - 1) / (2 * j) END * c2)), 1))), 0) * CASE WHEN df % 2 = 1 THEN cos(th) ELSE 1 END AS s FROM terms),
tested AS (SELECT *, CASE WHEN n < 2 THEN NULL WHEN se <> 0 THEN greatest(0, least(1, 1 - CASE WHEN df % 2 = 1 THEN 2 / pi() * (th + sin(th) * s) ELSE sin(th) * s END))
    WHEN mean = 0 THEN 1 ELSE 0 END AS p, CASE WHEN t0 IS NOT NULL THEN t0 WHEN n >= 2 AND mean = 0 THEN 0 END AS t FROM series),
summary AS (SELECT doc_id, n AS n_segments, n_samples, mean, vol AS volatility, unc AS model_uncertainty, se AS std_error, t AS t_statistic, p AS p_value,
    CASE WHEN n >= 2 THEN mean - {stats.Z95!r} * se END AS ci_low, CASE WHEN n >= 2 THEN mean + {stats.Z95!r} * se END AS ci_high,
    {POLARITY} AS polarity, {CONFIDENCE} AS confidence FROM tested)"""
)
FIGURES = ("mean", "volatility", "model_uncertainty", "std_error", "t_statistic", "p_value", "ci_low", "ci_high")
SUMMARY_COLUMNS = ", ".join(["n_segments", "n_samples", *[f"round({c}, 6) + 0.0 AS {c}" for c in FIGURES], "polarity", "confidence"])


def summaries(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", *keep, "text")
    return sentiment.sentiment(docs, scoring.stub_score, keep=("doc_id", *keep))


def stub_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sentiment.explode_segments(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scoring.resample(cut, 3).withColumn("score", scoring.stub_score(F.col("segment"), F.col("sample_idx")))


# Sources ------------------------------------------------------------------


@query(f"SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, trim(text, {WS}) AS t FROM documents) WHERE t <> ''")
def strip_nonempty(spark, sf_dir):
    kept = docsrc.with_text(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query("""
SELECT 0 AS kind_ord, doc_id AS arg_ord, 'text' AS origin, length(text) AS n_chars FROM documents
UNION ALL SELECT 1, item_id, 'benchmark', length(text) FROM benchmark
UNION ALL SELECT 2, page_id, url, length(html) FROM pages
""")
def source_union_ordered(spark, sf_dir):
    part = lambda name, kind, key, origin, text: table(spark, sf_dir, name).select(F.lit(kind).alias("kind_ord"), F.col(key).alias("arg_ord"), origin.alias("origin"), F.char_length(text).cast("bigint").alias("n_chars"))
    return docsrc.union_in_order(part("documents", 0, "doc_id", F.lit("text"), "text"), part("benchmark", 1, "item_id", F.lit("benchmark"), "text"), part("pages", 2, "page_id", F.col("url"), "html"))


@query("SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest, count(*) AS n_sources FROM conversations GROUP BY conv_id")
def corpus_concat(spark, sf_dir):
    joined = docsrc.corpus(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"])
    return joined.select("conv_id", F.md5("corpus").alias("digest"), "n_sources")


@query(r"""
SELECT page_id, CASE WHEN s = '.pdf' THEN 'pdf' WHEN s IN ('.html', '.htm', '.xhtml') THEN 'html' ELSE 'text' END AS kind
FROM (SELECT page_id, lower(regexp_extract(url, '[^/](\.[^./]+)$', 1)) AS s FROM pages)
""")
def suffix_dispatch(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.suffix_kind(F.col("url")).alias("kind"))


TYPES = ["text/html; charset=utf-8", "Application/PDF", "application/xhtml+xml", " text/plain ;x", "application/json"]


@query(f"""
SELECT page_id, m AS media_type, CASE WHEN contains(m, 'pdf') THEN 'pdf' WHEN contains(m, 'html') OR contains(m, 'xml') THEN 'html' ELSE 'text' END AS kind
FROM (SELECT page_id, lower(trim(split_part({TYPES!r}[page_id % 5 + 1], ';', 1))) AS m FROM pages)
""")
def content_type_dispatch(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, TYPES)), (F.col("page_id") % 5).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", tx.media_type(kind).alias("media_type"), tx.content_kind(kind).alias("kind"))


@query("SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme FROM pages WHERE regexp_matches(lower(url), '^https?:')")
def url_scheme_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(tx.scheme_allowed(F.col("url"))).select("page_id", "url", tx.url_scheme(F.col("url")).alias("scheme"))


@query(r"""
SELECT page_id, base AS api_base, regexp_replace(regexp_replace(base, '/v1$', ''), '/+$', '') || '/health' AS health, base || '/models' AS models
FROM (SELECT page_id, regexp_replace(url, '/+$', '') || '/v1' AS base FROM pages)
""")
def url_normalize(spark, sf_dir):
    base = tx.api_base(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", base.alias("api_base"), tx.health_url(base).alias("health"), tx.models_url(base).alias("models"))


def _html_sql() -> str:
    c = "regexp_replace(html, '(?s)<!--.*?-->', chr(1), 'g')"
    for tag in tx.HIDDEN_TAGS:
        c = rf"regexp_replace({c}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', chr(1), 'g')"
    c = f"regexp_replace({c}, '<[!/]?[a-zA-Z][^>]*>', chr(1), 'g')"
    part = "p"
    for pattern, char in tx.ENTITIES:
        part = f"regexp_replace({part}, '{pattern}', '{char.replace(chr(39), chr(39) * 2)}', 'g')"
    parts = f"list_filter(list_transform(string_split({c}, chr(1)), lambda p: trim({part}, {WS})), lambda p: p <> '')"
    lines = rf"array_to_string(list_transform(string_split(array_to_string({parts}, chr(10)), chr(10)), lambda l: rtrim(l, {WS})), chr(10))"
    return rf"SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace({lines}, '\n{{3,}}', chr(10) || chr(10), 'g'), {WS}) AS t FROM pages)"


@query(_html_sql())
def html_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", tx.html_text_native(F.col("html")).alias("t"))
    return pages.select("page_id", F.char_length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("digest"))


@query(_html_sql())
def html_text_parser(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", docsrc.html_to_text(F.col("html")).alias("t"))
    return pages.select("page_id", F.char_length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("digest"))


@query(_html_sql().replace("SELECT page_id, length(t)", "SELECT url AS origin, length(t)", 1).replace("(SELECT page_id, trim", "(SELECT url, trim", 1))
def fetched_pages(spark, sf_dir):
    rows = web.stored(table(spark, sf_dir, "pages")).withColumn("arg_ord", F.lit(0).cast("bigint"))
    got = docsrc.with_text(docsrc.fetched(rows))
    return got.select("origin", F.char_length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


LINES = """SELECT doc_id, CASE doc_id % 6
    WHEN 0 THEN '{"text": "t' || doc_id || '", "merchant": "m", "date": "2026-01-05", "amount": 1.5}'
    WHEN 1 THEN '{"text": "t", "merchant": "m", "date": "d", "amount": "4.95", "more": [1]}'
    WHEN 2 THEN '{"text": "t", "merchant": "m", "date": "d"}'
    WHEN 3 THEN '{"text": 5, "merchant": "m", "date": "d", "amount": 2}'
    WHEN 4 THEN '{broken' ELSE '{"text": "t", "merchant": "m", "date": "d", "amount": "1,234"}' END AS value FROM documents"""


@query(f"""
SELECT doc_id AS line, (CASE doc_id % 6 WHEN 0 THEN 1.5 WHEN 1 THEN 4.95 WHEN 3 THEN 2.0 END)::DOUBLE AS amount,
    CASE doc_id % 6 WHEN 2 THEN 'schema error: amount' WHEN 3 THEN 'schema error: text' WHEN 4 THEN 'invalid JSON' WHEN 5 THEN 'schema error: amount' END AS error
FROM ({LINES})
""")
def jsonl_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    k = F.col("doc_id") % 6
    value = (
        F.when(k == 0, F.concat(F.lit('{"text": "t'), F.col("doc_id").cast("string"), F.lit('", "merchant": "m", "date": "2026-01-05", "amount": 1.5}')))
        .when(k == 1, '{"text": "t", "merchant": "m", "date": "d", "amount": "4.95", "more": [1]}')
        .when(k == 2, '{"text": "t", "merchant": "m", "date": "d"}')
        .when(k == 3, '{"text": 5, "merchant": "m", "date": "d", "amount": 2}')
        .when(k == 4, "{broken")
        .otherwise('{"text": "t", "merchant": "m", "date": "d", "amount": "1,234"}')
    )
    lines = docs.select(F.lit("rows").alias("path"), F.col("doc_id").alias("line"), value.alias("value"))
    return jsonl.parse(lines).select("line", "amount", "error")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'skill-' || c_custkey END AS name,
    CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN c_mktsegment || ' notes' ELSE c_mktsegment END AS description,
    CASE c_custkey % 4 WHEN 0 THEN 'the header block is missing' WHEN 3 THEN 'unknown fields: color' END AS error FROM customer
""")
def manifest_parse(spark, sf_dir):
    k, name, segment = F.col("c_custkey") % 4, F.concat(F.lit("skill-"), F.col("c_custkey").cast("string")), F.col("c_mktsegment")
    head = F.concat(F.lit("\n---\nname: "), name, F.lit("\ndescription: "))
    text = (
        F.when(k == 0, F.concat(F.lit("no header "), name))
        .when(k == 1, F.concat(head, F.lit('"'), segment, F.lit(' notes"\n---\nbody')))
        .when(k == 2, F.concat(head, segment, F.lit("\nversion: 0.1.0\n---\n")))
        .otherwise(F.concat(head, segment, F.lit("\ncolor: red\n---\n")))
    )
    m = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")).select("c_custkey", skills.parse_manifest(text).alias("m"))
    return m.select("c_custkey", "m.name", "m.description", "m.error")


@query("""
SELECT doc_id, 'run-' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '/x' WHEN doc_id % 3 = 1 THEN '' ELSE ' y' END AS name, doc_id % 3 = 1 AS valid FROM documents
""")
def session_names(spark, sf_dir):
    k = F.col("doc_id") % 3
    name = F.concat(F.lit("run-"), F.col("doc_id").cast("string"), F.when(k == 0, "/x").when(k == 1, "").otherwise(" y"))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), tx.session_name_valid(name).alias("valid"))


# Segments -----------------------------------------------------------------


@query(rf"""
WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), {PIECES} AS b FROM documents)
SELECT doc_id, len(b) AS n_paragraphs, md5(array_to_string(b, '|')) AS digest FROM p
""")
def paragraph_split(spark, sf_dir):
    parts = tx.paragraphs(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))
    cut = table(spark, sf_dir, "documents").select("doc_id", parts.alias("b"))
    return cut.select("doc_id", F.size("b").cast("bigint").alias("n_paragraphs"), F.md5(F.array_join("b", "|")).alias("digest"))


@query(f"WITH {units_sql()} SELECT doc_id, len(u) AS n_sentences, md5(array_to_string(u, '|')) AS digest FROM units")
def sentence_split(spark, sf_dir):
    cut = table(spark, sf_dir, "documents").select("doc_id", tx.sentences(F.col("text")).alias("b"))
    return cut.select("doc_id", F.size("b").cast("bigint").alias("n_sentences"), F.md5(F.array_join("b", "|")).alias("digest"))


@query(f"WITH {units_sql(cap=7)} SELECT doc_id, len(s) AS n_segments, md5(array_to_string(s, '|')) AS digest FROM segs")
def segment_merge_cap(spark, sf_dir):
    cut = table(spark, sf_dir, "documents").select("doc_id", tx.segments(F.col("text"), 7).alias("s"))
    return cut.select("doc_id", F.size("s").cast("bigint").alias("n_segments"), F.md5(F.array_join("s", "|")).alias("digest"))


@query(f"WITH {units_sql()} SELECT doc_id, (generate_subscripts(s, 1) - 1)::INT AS seg_idx, md5(unnest(s)) AS digest FROM segs")
def segment_rows(spark, sf_dir):
    return sentiment.explode_segments(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "seg_idx", F.md5("segment").alias("digest"))


# Scores and statistics ----------------------------------------------------


@query("""
SELECT event_id, raw, greatest(-10, least(10, coalesce(CASE WHEN raw LIKE '%nan%' THEN 10 ELSE TRY_CAST(raw AS DOUBLE) END, 0)))::DOUBLE AS score
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' ' || (value - 20) || ' ' WHEN 1 THEN 'n/a' WHEN 2 THEN (event_id % 30)::VARCHAR WHEN 3 THEN 'nan' ELSE '-1e3' END AS raw FROM events)
""")
def score_clamp(spark, sf_dir):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.concat(F.lit(" "), (F.col("value") - 20).cast("string"), F.lit(" "))).when(k == 1, "n/a").when(k == 2, (F.col("event_id") % 30).cast("string")).when(k == 3, "nan").otherwise("-1e3")
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).withColumn("score", stats.coerce_score(F.col("raw")))


@query(f"WITH {SAMPLES} SELECT doc_id, seg_idx, sample_idx, score FROM samples")
def resample_scores(spark, sf_dir):
    return stub_samples(spark, sf_dir).select("doc_id", "seg_idx", "sample_idx", "score")


RATIONALE = "CASE WHEN (seg_idx + sample_idx) % 3 = 0 THEN '' ELSE 'because ' || sample_idx END"


@query(f"""
WITH {SAMPLES}
SELECT doc_id, seg_idx, count(*) AS n_samples, round(avg(score), 6) + 0.0 AS seg_mean, round(coalesce(stddev_samp(score), 0), 6) + 0.0 AS seg_stdev,
    coalesce(arg_max({RATIONALE}, sample_idx) FILTER ({RATIONALE} <> ''), '') AS rationale FROM samples GROUP BY doc_id, seg_idx
""")
def segment_stats(spark, sf_dir):
    i = F.col("sample_idx")
    rows = stub_samples(spark, sf_dir).withColumn("rationale", F.when((F.col("seg_idx") + i) % 3 == 0, "").otherwise(F.concat(F.lit("because "), i.cast("string"))))
    return rounded(sentiment.segment_level(rows), "seg_mean", "seg_stdev")


@query(f"WITH {SUMMARY} SELECT doc_id, {SUMMARY_COLUMNS} FROM summary")
def sentiment_summary(spark, sf_dir):
    return rounded(summaries(spark, sf_dir), *FIGURES)


@query(f"WITH {SUMMARY} SELECT doc_id, {SUMMARY_COLUMNS} FROM summary")
def sentiment_summary_long(spark, sf_dir):
    """The same figures by grouping a long table of samples."""
    return rounded(sentiment.summarize_samples(stub_samples(spark, sf_dir)), *FIGURES)


@query(f"WITH {SUMMARY} SELECT doc_id, {SUMMARY_COLUMNS} FROM summary")
def sentiment_scorer_batches(spark, sf_dir):
    """The same figures by a model function in batches, each distinct call once."""
    import hashlib

    def model(segments, indexes):
        digest = lambda s, i: int(hashlib.md5(f"{s}#{i}".encode()).hexdigest()[:8], 16)
        return [(digest(s, i) % 21 - 10, "") for s, i in zip(segments, indexes, strict=True)]

    cut = sentiment.explode_segments(table(spark, sf_dir, "documents").select("doc_id", "text"))
    scored = sentiment.coerced(scoring.score_distinct(scoring.resample(cut, 3), model))
    return rounded(sentiment.summarize_samples(scored), *FIGURES)


def _by_group(column: str) -> None:
    sql = f"""
WITH {SUMMARY} SELECT {column}, count(*) AS n_docs, sum(n_segments)::BIGINT AS n_segments, round(avg(mean), 6) + 0.0 AS mean, round(avg(volatility), 6) + 0.0 AS volatility
FROM summary JOIN documents USING (doc_id) GROUP BY {column}"""

    def grouped(spark, sf_dir):
        rows = summaries(spark, sf_dir, column).groupBy(column)
        return rounded(rows.agg(F.count("*").alias("n_docs"), F.sum("n_segments").alias("n_segments"), F.avg("mean").alias("mean"), F.avg("volatility").alias("volatility")), "mean", "volatility")

    grouped.__name__ = f"sentiment_by_{column}"
    query(sql)(grouped)


_by_group("lang")
_by_group("source")


def _distribution(column: str) -> None:
    def counted(spark, sf_dir):
        return summaries(spark, sf_dir).groupBy(column).agg(F.count("*").alias("n"))

    counted.__name__ = f"{column}_distribution"
    query(f"WITH {SUMMARY} SELECT {column}, count(*) AS n FROM summary GROUP BY {column}")(counted)


_distribution("polarity")
_distribution("confidence")


@query(f"WITH {SUMMARY} SELECT quality, toxic, polarity, count(*) AS n, round(avg(mean), 6) + 0.0 AS mean FROM summary JOIN labels USING (doc_id) GROUP BY ALL")
def sentiment_vs_label(spark, sf_dir):
    both = summaries(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return rounded(both.groupBy("quality", "toxic", "polarity").agg(F.count("*").alias("n"), F.avg("mean").alias("mean")), "mean")


@query(f"""
WITH {SAMPLES}
SELECT doc_id, length(e) AS n_chars, md5(e) AS digest FROM (
    SELECT doc_id, substr(string_agg('- (' || printf('%+.1f', round(m, 2)) || ') ' || segment, chr(10) ORDER BY seg_idx), 1, 2000) AS e
    FROM by_seg JOIN seg_rows USING (doc_id, seg_idx) GROUP BY doc_id)
""")
def excerpts_2000(spark, sf_dir):
    """Means over all samples with whole segments as rationales, so that long documents reach the cut."""
    rows = stub_samples(spark, sf_dir).withColumn("rationale", F.col("segment"))
    out = sentiment.excerpts(sentiment.segment_level(rows))
    return out.select("doc_id", F.char_length("excerpts").cast("bigint").alias("n_chars"), F.md5("excerpts").alias("digest"))


@query(f"""
WITH {SUMMARY}
SELECT doc_id, 'Overall the text reads as ' || polarity || ' (mean ' || printf('%+.2f', round(mean, 6) + 0.0) || ' over ' || n_segments || ' segments, volatility '
    || printf('%.2f', round(volatility, 6) + 0.0) || '). Confidence that it differs from neutral: ' || confidence || '.' AS explanation FROM summary
""")
def explanations(spark, sf_dir):
    """Explanations of every document with text; figures are rounded from their binary value, ties to even."""
    return sentiment.explain(rounded(summaries(spark, sf_dir), "mean", "volatility")).select("doc_id", "explanation")


FORMS = {"mean": 2, "volatility": 3, "model_uncertainty": 3, "std_error": 3, "t_statistic": 3, "p_value": 4, "ci_low": 2, "ci_high": 2}


@query(f"WITH {SUMMARY} SELECT doc_id, {', '.join(f"printf('%.{d}f', round({c}, 6))::DOUBLE + 0.0 AS {c}" for c, d in FORMS.items())} FROM summary")
def figures_presented(spark, sf_dir):
    """Figures rounded for display."""
    shown = reports.presented(rounded(summaries(spark, sf_dir), *FIGURES))
    return shown.select("doc_id", *[(F.col(c) + F.lit(0.0)).alias(c) for c in FORMS])


@query(f"""
WITH {SUMMARY}
SELECT doc_id, '{{"confidence":"' || confidence || '","doc_id":' || doc_id || ',"n_samples":' || n_samples || ',"n_segments":' || n_segments
    || ',"none":null,"polarity":"' || polarity || '"}}' AS json FROM summary
""")
def json_rows(spark, sf_dir):
    rows = summaries(spark, sf_dir).select("doc_id", "polarity", "confidence", "n_samples", "n_segments", F.lit(None).cast("string").alias("none"))
    return rows.select("doc_id", reports.json_row(rows).alias("json"))


@query(f"WITH {SAMPLES} SELECT count(*) AS calls, count(DISTINCT (segment, sample_idx)) AS distinct_calls FROM samples")
def dedup_before_score(spark, sf_dir):
    counts = scoring.distinct_calls(stub_samples(spark, sf_dir))
    return counts.select("calls", "distinct_calls")


@query("""
SELECT event_id, CASE WHEN status >= 500 OR status IN (408, 409, 429) OR kind IN ('timeout', 'connection') THEN true ELSE false END AS retryable
FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE [400, 401, 404, 408, 409, 422, 429, 500, 503][event_id % 9 + 1] END AS status,
    CASE event_id % 14 WHEN 0 THEN 'timeout' WHEN 7 THEN 'decode' END AS kind FROM events)
""")
def retry_classify(spark, sf_dir):
    status = F.when(F.col("event_id") % 7 != 0, F.get(F.array(*map(F.lit, [400, 401, 404, 408, 409, 422, 429, 500, 503])), (F.col("event_id") % 9).cast("int")))
    kind = F.when(F.col("event_id") % 14 == 0, "timeout").when(F.col("event_id") % 14 == 7, "decode")
    return table(spark, sf_dir, "events").select("event_id", scoring.is_retryable(status, kind).alias("retryable"))


@query("SELECT event_id, least(10, pow(2, event_id % 8)) AS wait_s FROM events")
def retry_backoff(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scoring.backoff(F.col("event_id") % 8 + 1).alias("wait_s"))


# Extraction and evaluation ------------------------------------------------


@query(r"""
SELECT p_partkey, lower(trim(regexp_replace('  ' || upper(p_name) || chr(9) || ' X ', '\s+', ' ', 'g'))) AS norm,
    lower(trim(regexp_replace(p_name || ' x', '\s+', ' ', 'g'))) = lower(trim(regexp_replace('  ' || upper(p_name) || chr(9) || ' X ', '\s+', ' ', 'g'))) AS same FROM part
""")
def norm_string_match(spark, sf_dir):
    left = tx.norm(F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t X ")))
    return table(spark, sf_dir, "part").select("p_partkey", left.alias("norm"), (tx.norm(F.concat("p_name", F.lit(" x"))) == left).alias("same"))


@query(r"""
SELECT o_orderkey, raw, CASE WHEN regexp_matches(k, '^-?(\d+\.?\d*|\.\d+)$') THEN k::DOUBLE END AS amount
FROM (SELECT *, regexp_replace(raw, '[^\d.\-]', '', 'g') AS k FROM (
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '$' || floor(o_totalprice)::BIGINT || '.25' WHEN 1 THEN floor(o_totalprice)::BIGINT || ' USD' WHEN 2 THEN 'n/a' WHEN 3 THEN '-' ELSE '1.2.3' END AS raw FROM orders))
""")
def amount_parse(spark, sf_dir):
    k, whole = F.col("o_orderkey") % 5, F.floor("o_totalprice").cast("bigint").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("$"), whole, F.lit(".25"))).when(k == 1, F.concat(whole, F.lit(" USD"))).when(k == 2, "n/a").when(k == 3, "-").otherwise("1.2.3")
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).withColumn("amount", metrics.parse_amount(F.col("raw")))


@query("SELECT l_orderkey, l_linenumber, coalesce(abs(l_extendedprice - (l_extendedprice + (l_linenumber % 4) * 0.005)) <= 0.01, false) AS ok FROM lineitem")
def amount_tolerance(spark, sf_dir):
    moved = F.col("l_extendedprice") + (F.col("l_linenumber") % 4) * 0.005
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", metrics.amount_matches(F.col("l_extendedprice"), moved).alias("ok"))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold records from orders."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("example_id"), F.col("o_orderpriority").alias("merchant"), day.alias("date"), F.col("o_totalprice").alias("amount"))


def _predicted(gold: DataFrame, program: optimization.Program) -> DataFrame:
    """A stand-in for a model under a program: it misses merchants unless instructed about them, dates
    unless it is instructed about them or has demonstrations, and some amounts in any case."""
    key = F.col("example_id")
    lost = lambda known, n: F.lit(not known) & (key % n == 0)
    return gold.select(
        "example_id",
        F.when(lost("merchants" in program.instructions, 3), "Corner Stall").otherwise(F.concat(F.lit("  "), F.upper("merchant"))).alias("merchant"),
        F.when(lost("dates" in program.instructions or bool(program.demos), 5), "2026-01-01").otherwise(F.col("date")).alias("date"),
        F.when(key % 7 == 0, "n/a").otherwise(F.concat(F.lit("$"), F.col("amount").cast("decimal(18,2)").cast("string"))).alias("amount"),
    )


def examples(spark: SparkSession, sf_dir: str, program: optimization.Program | None = None) -> DataFrame:
    """Gold records and what a program predicts for them."""
    gold = _gold(spark, sf_dir)
    return evaluation.pair(gold, _predicted(gold, program or optimization.Program()))


EXAMPLES = """
hits AS (SELECT o_orderkey AS example_id, ((o_orderkey % 3 <> 0)::INT + (o_orderkey % 5 <> 0 OR strftime(o_orderdate, '%Y-%m-%d') = '2026-01-01')::INT
    + (o_orderkey % 7 <> 0)::INT) AS hits FROM orders)"""


@query(f"WITH {EXAMPLES} SELECT example_id, hits, round(hits / 3.0, 6) + 0.0 AS score FROM hits")
def record_accuracy(spark, sf_dir):
    return rounded(evaluation.scored(examples(spark, sf_dir)).select("example_id", "hits", "score"), "score")


@query(f"WITH {EXAMPLES} SELECT example_id, hits = 3 AS exact FROM hits")
def exact_match(spark, sf_dir):
    return evaluation.scored(examples(spark, sf_dir)).select("example_id", metrics.exact_match(F.col("hits")).alias("exact"))


@query(f"WITH {EXAMPLES} SELECT example_id FROM hits WHERE hits = 3")
def gate_filter(spark, sf_dir):
    return evaluation.scored(examples(spark, sf_dir)).where(metrics.passes_gate(F.col("hits"))).select("example_id")


@query(f"WITH {EXAMPLES} SELECT count(*) AS n, round(avg(hits / 3.0), 6) + 0.0 AS score_frac, round(100 * avg(hits / 3.0), 6) + 0.0 AS score_pct FROM hits")
def eval_score(spark, sf_dir):
    return rounded(evaluation.evaluate(evaluation.scored(examples(spark, sf_dir))), "score_frac", "score_pct")


@query(f"""
WITH {EXAMPLES}, boot AS (SELECT example_id, md5('0#' || example_id) AS o FROM hits WHERE hits = 3 ORDER BY o, example_id LIMIT 4),
rest AS (SELECT example_id, md5('0#' || example_id) AS o FROM hits WHERE example_id NOT IN (SELECT example_id FROM boot) ORDER BY o, example_id LIMIT 8),
both_ AS (SELECT *, 'bootstrapped' AS kind, 0 AS g FROM boot UNION ALL SELECT *, 'labeled', 1 FROM rest)
SELECT example_id, kind, (row_number() OVER (ORDER BY g, o, example_id) - 1)::INT AS position FROM both_ ORDER BY position LIMIT 8
""")
def bootstrap_demos(spark, sf_dir):
    return optimization.bootstrap_demos(evaluation.scored(examples(spark, sf_dir)).select("example_id", "hits"))


@query(r"""
SELECT o_orderkey AS example_id, 'Shop' || o_orderkey AS merchant, strftime(o_orderdate, '%Y-%m-%d') AS date, (o_orderkey + 0.25)::DOUBLE AS amount FROM orders
""")
def rule_extraction(spark, sf_dir):
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 3
    day = F.when(k == 0, F.date_format("o_orderdate", "M/d/yyyy")).when(k == 1, F.date_format("o_orderdate", "MMM d yyyy")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    note = F.concat(F.lit("Lunch at Shop"), F.col("o_orderkey").cast("string"), F.lit(" on "), day, F.lit(", paid $"), F.col("o_orderkey").cast("string"), F.lit(".25"))
    return evaluation.extract(orders.select(F.col("o_orderkey").alias("example_id"), note.alias("text")))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored records of three programs: without instructions, instructed about dates, and about merchants."""
    programs = {"a-base": "", "b-dates": "dates", "c-merchants": "merchants"}
    each = [evaluation.scored(examples(spark, sf_dir, optimization.Program(i))).select(F.lit(name).alias("candidate"), "score") for name, i in programs.items()]
    return reduce(DataFrame.unionByName, each)


CANDIDATES = (
    EXAMPLES
    + """,
cand AS (SELECT 'a-base' AS candidate, hits AS h FROM hits UNION ALL SELECT 'b-dates', least(3, hits + (example_id % 5 = 0)::INT) FROM hits
    UNION ALL SELECT 'c-merchants', least(3, hits + (example_id % 3 = 0)::INT) FROM hits),
marks AS (SELECT candidate, count(*) AS n, avg(h / 3.0) AS score FROM cand GROUP BY candidate)"""
)


@query(f"WITH {CANDIDATES} SELECT candidate, n, round(score, 6) + 0.0 AS score FROM marks")
def candidate_search(spark, sf_dir):
    return rounded(optimization.candidate_scores(_candidates(spark, sf_dir)), "score")


@query(f"WITH {CANDIDATES} SELECT candidate, n, round(score, 6) + 0.0 AS score FROM marks ORDER BY round(score, 9) DESC, candidate LIMIT 1")
def best_candidate(spark, sf_dir):
    return rounded(optimization.best_candidate(optimization.candidate_scores(_candidates(spark, sf_dir))), "score")


@query(f"""
WITH {CANDIDATES} SELECT round(b.score, 6) + 0.0 AS baseline, round(a.score, 6) + 0.0 AS after, round(a.score - b.score, 6) + 0.0 AS lift
FROM marks b, marks a WHERE b.candidate = 'a-base' AND a.candidate = 'c-merchants'
""")
def lift(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    part = lambda name: evaluation.evaluate(rows.where(F.col("candidate") == name))
    return rounded(optimization.lift(part("a-base"), part("c-merchants")), "baseline", "after", "lift")


# Catalog and routing ------------------------------------------------------

#: The catalog of the routing queries.
SKILLS = [
    ("extract", "read who was paid, when and how much out of notes on what the house bought", "builtin", "/b/extract"),
    ("sentiment", "measure the tone of documents and the spread that is in them", "builtin", "/b/sentiment"),
    ("chat", "go on with a talk, given its turns and the next one", "builtin", "/b/chat"),
    ("chat", "talk about those things with others", "user", "/u/chat"),
]


def _skills(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SKILLS, "name string, description string, source string, directory string")


ROUTE = f"""
raw AS (SELECT * FROM (VALUES {", ".join(map(str, SKILLS))}) v(name, description, source, directory)),
cat AS (SELECT name, arg_max(description, (source = 'user')::INT) AS description FROM raw GROUP BY name),
words AS (SELECT name, list_distinct(regexp_extract_all(lower(name || ' ' || description), '[a-z0-9]+')) AS w FROM cat),
asked AS (SELECT item_id, CASE WHEN item_id % 10 = 0 THEN ' Extract ' ELSE text END AS request FROM benchmark),
marks AS (SELECT item_id, request, name, len(list_intersect(list_distinct(regexp_extract_all(lower(request), '[a-z0-9]+')), w)) AS o FROM asked, words),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY o DESC, name) AS r, lead(o) OVER (PARTITION BY item_id ORDER BY o DESC, name) AS nxt FROM marks),
routed AS (SELECT item_id, CASE WHEN lower(trim(request)) IN (SELECT name FROM cat) THEN lower(trim(request)) WHEN o > 0 AND o > nxt THEN name END AS skill,
    CASE WHEN lower(trim(request)) IN (SELECT name FROM cat) THEN 'exact name match' WHEN o > 0 AND o > nxt THEN 'keyword match (score ' || o || ')' ELSE 'ambiguous' END AS reason FROM ranked WHERE r = 1)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 10 == 0, " Extract ").otherwise(F.col("text")).alias("request"))


@query(f"WITH {ROUTE} SELECT item_id, skill, reason FROM routed")
def route_keyword(spark, sf_dir):
    return catalog.route(_requests(spark, sf_dir), catalog.shadowed(_skills(spark))).select("item_id", "skill", "reason")


@query(f"WITH {ROUTE} SELECT item_id, r::INT AS rank, name, o::INT AS overlap FROM ranked WHERE r <= 2")
def route_topk(spark, sf_dir):
    ranked = catalog.rank_skills(_requests(spark, sf_dir), catalog.shadowed(_skills(spark)))
    rows = ranked.select("item_id", F.posexplode(F.slice("ranked", 1, 2)).alias("p", "s"))
    return rows.select("item_id", (F.col("p") + 1).alias("rank"), "s.name", "s.overlap")


@query(f"WITH {ROUTE} SELECT item_id FROM routed WHERE skill IS NULL")
def route_ambiguous(spark, sf_dir):
    return catalog.route(_requests(spark, sf_dir), catalog.shadowed(_skills(spark))).where("skill IS NULL").select("item_id")


#: Skills made of tables: a built-in one for each supplier, a user's for each nation, some under the same names.
TABLE_SKILLS = """
raw AS (SELECT 's-' || s_suppkey AS name, s_name || ' of nation ' || s_nationkey AS description, 'builtin' AS source FROM supplier
    UNION ALL SELECT 's-' || n_nationkey, n_name || ' in region ' || n_regionkey, 'user' FROM nation),
cat AS (SELECT name, arg_max(description, (source = 'user')::INT) AS description, max(source) AS source FROM raw GROUP BY name)"""


def _table_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda c: F.col(c).cast("string")
    builtin = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s-"), key("s_suppkey")).alias("name"), F.concat("s_name", F.lit(" of nation "), key("s_nationkey")).alias("description"), F.lit("builtin").alias("source"))
    user = table(spark, sf_dir, "nation").select(F.concat(F.lit("s-"), key("n_nationkey")).alias("name"), F.concat("n_name", F.lit(" in region "), key("n_regionkey")).alias("description"), F.lit("user").alias("source"))
    return builtin.unionByName(user).withColumn("directory", F.concat(F.lit("/"), F.left("source", F.lit(1)), F.lit("/"), "name"))


@query(f"WITH {TABLE_SKILLS} SELECT name, description, source FROM cat")
def skill_shadowing(spark, sf_dir):
    return catalog.shadowed(_table_skills(spark, sf_dir)).select("name", "description", "source")


OVERRIDES = {"BUILDING": {"model": "small@4096"}, "MACHINERY": {"model": "org/m@latest", "ctx": 8192, "reasoning": "think"}, "default": {"model": "big", "provider": "local"}}
REGISTRY = """reg AS (SELECT * FROM (VALUES ('BUILDING', 'small', 4096, 'nothink', 'openai'), ('MACHINERY', 'org/m@latest', 8192, 'think', 'openai'), ('default', 'big', NULL, 'nothink', 'local')) v(alias, m, c, r, p))"""


@query(f"""
WITH {REGISTRY} SELECT c_custkey, coalesce(p, 'openai') || '/' || coalesce(m, c_mktsegment) || '::' || coalesce(r, 'nothink') || coalesce('@' || c, '') AS model_string
FROM customer LEFT JOIN reg ON alias = c_mktsegment
""")
def alias_resolve(spark, sf_dir):
    named = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("alias"))
    return catalog.resolve_models(named, catalog.model_registry(spark, OVERRIDES)).select("c_custkey", "model_string")


@query("""
SELECT 'a' || p_partkey AS alias, lower(p_type) || '/' || p_brand || '::' || CASE WHEN p_size % 3 = 0 THEN 'think' ELSE 'nothink' END
    || CASE WHEN p_size % 2 = 0 THEN '@' || p_size * 1024 WHEN p_size % 5 = 0 THEN '@' || p_size ELSE '' END AS model_string FROM part
""")
def model_aliases(spark, sf_dir):
    """Every part as a model: some with a context, some with one in the name."""
    size, baked = F.col("p_size"), F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("@"), F.col("p_size").cast("string"))).otherwise("")
    registry = table(spark, sf_dir, "part").select(
        F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("alias"), F.concat("p_brand", baked).alias("model"), F.when(size % 2 == 0, size * 1024).cast("bigint").alias("ctx"),
        F.when(size % 3 == 0, "think").alias("reasoning"), F.lower("p_type").alias("provider"),
    )
    return catalog.model_aliases(registry)


@query("""
SELECT p_partkey, 'openai/m' || p_size || '::' || CASE WHEN p_partkey % 2 = 0 THEN 'think' ELSE 'nothink' END
    || coalesce('@' || CASE WHEN p_partkey % 3 = 0 THEN p_partkey WHEN p_partkey % 4 = 0 THEN 100 END, '') AS model_string FROM part
""")
def model_string(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat(F.lit("m"), F.col("p_size").cast("string"), F.when(k % 4 == 0, "@100").otherwise(""))
    composed = catalog.model_string(name, F.when(k % 3 == 0, k), F.when(k % 2 == 0, "think"), F.lit("openai"))
    return table(spark, sf_dir, "part").select("p_partkey", composed.alias("model_string"))


# Conversations ------------------------------------------------------------


@query("""
SELECT conv_id, turn, count(*) OVER w AS n_history, md5(coalesce(string_agg(role || ':' || text, '|' ORDER BY turn) OVER w, '')) AS digest
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""".replace("string_agg(role || ':' || text, '|' ORDER BY turn) OVER w", "string_agg(role || ':' || text, '|') OVER w"))
def chat_history_prefix(spark, sf_dir):
    rows = conversations.with_history(table(spark, sf_dir, "conversations"))
    joined = F.array_join(F.transform("history", lambda t: F.concat_ws(":", t["role"], t["text"])), "|")
    return rows.select("conv_id", "turn", "n_history", F.md5(joined).alias("digest"))


@query("SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def turn_count(spark, sf_dir):
    return conversations.turn_counts(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS turn_no FROM conversations")
def turn_numbers(spark, sf_dir):
    return conversations.with_turn_number(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "turn_no")


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with a position that orders them over all conversations."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.col("text").alias("prompt"))


PROMPTS = "prompts AS (SELECT conv_id * 1000 + turn AS pos, text AS prompt FROM conversations WHERE role = 'user')"


@query(f"WITH {PROMPTS} SELECT prompt, min(pos) AS pos FROM prompts GROUP BY prompt")
def prompt_dedup_keep_first(spark, sf_dir):
    return conversations.distinct_in_order(_prompts(spark, sf_dir), "prompt", "pos")


@query(f"WITH {PROMPTS} SELECT pos, prompt FROM prompts ORDER BY pos DESC LIMIT 1000")
def last_n_prompts(spark, sf_dir):
    return conversations.last_n(_prompts(spark, sf_dir), sessions.MOST_PROMPTS)


@query(f"WITH {PROMPTS} SELECT prompt, CASE WHEN min(pos % 2) = 0 THEN 0 ELSE 1 END AS part, coalesce(min(pos) FILTER (pos % 2 = 0), min(pos)) AS pos FROM prompts GROUP BY prompt")
def seeded_history(spark, sf_dir):
    rows = _prompts(spark, sf_dir)
    return conversations.seeded_history(rows.where("pos % 2 = 0"), rows.where("pos % 2 = 1"))


@query("""
SELECT conv_id, list_sum(list_transform(list(text), lambda t: length(t)))::BIGINT AS n_chars, count(*) AS n_turns FROM conversations GROUP BY conv_id
""")
def session_json_roundtrip(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", "text", F.lit("ok").alias("answer"))))
    packed = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["text"].alias("text"), t["answer"].alias("answer"))).alias("turns"))
    back = packed.select("conv_id", sessions.session_turns(sessions.session_json(F.col("turns"))).alias("turns"))
    n = F.aggregate("turns", F.lit(0).cast("bigint"), lambda a, t: a + F.char_length(t["text"]))
    return back.select("conv_id", n.alias("n_chars"), F.size("turns").cast("bigint").alias("n_turns"))


@query("""
SELECT conv_id, turn, 'after ' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || ' turns: ' || length(text) AS answer FROM conversations
""")
def chat_answers(spark, sf_dir):
    rows = conversations.with_history(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "text", "history")
    return conversations.respond(rows, lambda history, text: f"after {len(history)} turns: {len(text)}").select("conv_id", "turn", "answer")


# Settings -----------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '***' END AS api_key FROM customer")
def redact(spark, sf_dir):
    key = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.redacted(key).alias("api_key"))


@query("""
SELECT c_mktsegment AS name, arg_max(c_name, c_custkey) FILTER (c_custkey % 3 <> 0) AS value FROM customer GROUP BY c_mktsegment
""")
def settings_layer(spark, sf_dir):
    value = F.when(F.col("c_custkey") % 3 != 0, F.col("c_name"))
    layers = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), value.alias("value"), F.col("c_custkey").alias("priority"))
    return settings.resolve_layers(layers)


@query("SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id")
def latest_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("priority"))
    return catalog.latest_wins(rows, "conv_id", "priority").select("conv_id", "turn")


@query("""
SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL WHEN turn % 4 IN (0, 2) THEN 1 ELSE 0 END::BIGINT AS n_turns FROM conversations
""")
def session_load(spark, sf_dir):
    """Sessions as stored: a list with one full turn and one broken one, an object, a list with a number for an answer, and no JSON."""
    k, text = F.col("turn") % 4, F.to_json(F.struct(F.col("text"), F.lit("a").alias("answer")))
    content = F.when(k == 0, F.concat(F.lit("["), text, F.lit(', {"text": "only"}, 3]'))).when(k == 1, '{"text": "q"}').when(k == 2, '[{"text": "q", "answer": 5, "more": null}]').otherwise("[broken")
    turns = sessions.session_turns(content)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(turns.isNotNull(), F.size(turns)).cast("bigint").alias("n_turns"))


@query("SELECT conv_id, count(*) + 1 AS n_turns, 'and then' AS last_text FROM conversations GROUP BY conv_id")
def session_append(spark, sf_dir):
    packed = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    turns = F.transform("t", lambda x: F.struct(x["text"].alias("text"), F.lit("ok").alias("answer")))
    longer = packed.select("conv_id", sessions.append_turn(turns, F.lit("and then"), F.lit("fine")).alias("turns"))
    return longer.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.element_at("turns", -1)["text"].alias("last_text"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'm' || p_partkey || '|' ELSE 'm' || p_partkey || '|x' END AS ids FROM part")
def model_listing(spark, sf_dir):
    answer = F.concat(F.lit('{"object": "list", "data": [{"id": "m'), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, '"}, {"size": 1}]}').otherwise('"}, {"id": "x"}]}'))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(web.model_ids(answer), "|").alias("ids"))


@query(f"WITH {TABLE_SKILLS} SELECT name FROM raw WHERE source = 'builtin'")
def skill_filter(spark, sf_dir):
    return catalog.by_source(_table_skills(spark, sf_dir), "builtin").select("name")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '/skills/' || c_mktsegment || '/train.jsonl' END AS path FROM customer")
def dataset_paths(spark, sf_dir):
    relative = F.when(F.col("c_custkey") % 2 == 0, "train.jsonl")
    directory = F.concat(F.lit("/skills/"), F.col("c_mktsegment"), F.lit("/"))
    return table(spark, sf_dir, "customer").select("c_custkey", skills.dataset_path(directory, relative).alias("path"))


@query("SELECT p_partkey, len(list_filter([':help', ':history', ':new', ':quit'], lambda c: starts_with(c, left(':history', (p_partkey % 9)::INT))))::INT AS n FROM part")
def complete_prefix(spark, sf_dir):
    typed = F.left(F.lit(":history"), (F.col("p_partkey") % 9).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(catalog.complete(typed, (":help", ":history", ":new", ":quit"))).alias("n"))


@query(f"""
WITH joined AS (SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
{SUMMARY.replace("FROM documents),", "FROM joined),", 1)} SELECT doc_id, {SUMMARY_COLUMNS} FROM summary
""")
def corpus_sentiment(spark, sf_dir):
    """All turns of a conversation as one corpus: each turn is at least one paragraph."""
    joined = docsrc.corpus(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"])
    return rounded(sentiment.sentiment(joined.select(F.col("conv_id").alias("doc_id"), F.col("corpus").alias("text")), scoring.stub_score), *FIGURES)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '(alias default)' ELSE 'm' || o_orderkey END AS label FROM orders")
def model_label(spark, sf_dir):
    configured = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.concat(F.lit("m"), F.col("o_orderkey").cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", catalog.model_label(configured, F.lit("default")).alias("label"))


# Files that the query writes first ----------------------------------------


@query(f"SELECT item_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT item_id, trim(text, {WS}) AS t FROM benchmark)")
def text_files(spark, sf_dir):
    """Texts as files with CR LF line ends, read back as files."""
    folder = scratch.shared_path(spark, "texts")
    body = F.concat(F.lit("\r\n"), F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit(" \r\n"))
    docsrc.write_files(table(spark, sf_dir, "benchmark").select(F.concat("item_id", F.lit(".txt")).alias("name"), body.alias("text")), folder)
    got = docsrc.with_text(docsrc.files_under(spark, f"{folder}/*.txt"))
    key = F.regexp_extract("origin", r"(\d+)\.txt$", 1).cast("bigint")
    return got.select(key.alias("item_id"), F.char_length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query(_html_sql())
def html_files(spark, sf_dir):
    """Pages as files of three suffixes, 4,096 keys a folder, read back as files."""
    folder = scratch.shared_path(spark, "pages")
    suffix = F.get(F.array(*map(F.lit, (".html", ".HTM", ".xhtml"))), (F.col("page_id") % 3).cast("int"))
    name = F.concat(F.floor(F.col("page_id") / 4096).cast("string"), F.lit("/"), "page_id", suffix)
    docsrc.write_files(table(spark, sf_dir, "pages").select(name.alias("name"), F.col("html").alias("text")), folder)
    got = docsrc.files_under(spark, f"{folder}/*/*").select(F.regexp_extract("origin", r"(\d+)\.\w+$", 1).cast("bigint").alias("page_id"), F.col("text").alias("t"))
    return got.select("page_id", F.char_length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("digest"))


def _stored_lines(spark: SparkSession, sf_dir: str, good: bool = False) -> str:
    """JSON Lines files of one line a document in order, 400 documents a file, with a blank line for each seventh; with ``good`` only valid rows."""
    folder, k = scratch.shared_path(spark, "lines"), F.col("doc_id") % 7
    valid = F.to_json(F.struct("text", F.lit("m").alias("merchant"), F.col("source").alias("date"), (F.col("n_chars") / 4).alias("amount")))
    value = F.when(k == 0, "  ").when((k == 3) & F.lit(not good), "{broken").when((k == 5) & F.lit(not good), F.to_json(F.struct("text"))).otherwise(valid)
    rows = table(spark, sf_dir, "documents").select("doc_id", value.alias("value"), F.floor(F.col("doc_id") / 400).alias("file"))
    rows.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "value").write.partitionBy("file").text(folder)
    return f"{folder}/*"


FILE = r"file=(\d+)"
LINES = "n AS (SELECT doc_id // 400 AS file, doc_id % 7 AS k, text, source, n_chars, row_number() OVER (PARTITION BY doc_id // 400 ORDER BY doc_id) AS line FROM documents)"


@query(f"""
WITH {LINES}
SELECT file, line, CASE WHEN k = 3 THEN NULL ELSE md5(text) END AS digest, CASE WHEN k NOT IN (3, 5) THEN n_chars / 4.0::DOUBLE END AS amount, CASE k WHEN 3 THEN 'invalid JSON' WHEN 5 THEN 'schema error: merchant, date, amount' END AS error FROM n WHERE k <> 0
""")
def jsonl_scan(spark, sf_dir):
    """Many files by their lines: blank ones are counted and left out, bad ones carry their error."""
    found = jsonl.parse(jsonl.numbered_lines(spark, _stored_lines(spark, sf_dir)))
    return found.select(F.regexp_extract("path", FILE, 1).cast("bigint").alias("file"), "line", F.md5("text").alias("digest"), "amount", "error")


@query(f"""
WITH {LINES}, bad AS (SELECT line, k FROM n WHERE k IN (3, 5) AND file = 0 ORDER BY line LIMIT 1)
SELECT 'bad' AS kind, line, CASE k WHEN 3 THEN 'invalid JSON' ELSE 'schema error: merchant, date, amount' END AS outcome FROM bad
UNION ALL SELECT 'good', max(line), count(*) || ' rows' FROM n WHERE k <> 0
""")
def jsonl_first_error(spark, sf_dir):
    """Loading stops at the first bad line and names it; good files give all rows."""
    try:
        jsonl.load(spark, _stored_lines(spark, sf_dir)).count()
        failure = ("", "0", "none")
    except BadInput as error:
        failure = re.fullmatch(r"(.*):(\d+): (.*)", str(error)).groups()
    rows = jsonl.load(spark, _stored_lines(spark, sf_dir, good=True))
    bad = spark.range(1).select(F.lit("bad").alias("kind"), F.lit(int(failure[1])).cast("bigint").alias("line"), F.lit(failure[2]).alias("outcome"))
    return bad.unionByName(rows.agg(F.lit("good").alias("kind"), F.max("line").alias("line"), F.concat(F.count("*").cast("string"), F.lit(" rows")).alias("outcome")))


@query("""
SELECT conv_id // 50 AS file, row_number() OVER (PARTITION BY conv_id // 50 ORDER BY conv_id, turn) - 1 AS pos, replace(text, chr(10), ' ') AS prompt FROM conversations WHERE role = 'user'
""")
def prompt_lines(spark, sf_dir):
    """History files of prompts, one a line, for 50 conversations each, read back in order."""
    folder = scratch.shared_path(spark, "prompts")
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.replace("text", F.lit("\n"), F.lit(" ")).alias("value"), F.floor(F.col("conv_id") / 50).alias("file"))
    rows.repartition("file").sortWithinPartitions("file", "conv_id", "turn").select("file", "value").write.partitionBy("file").text(folder)
    return sessions.prompt_lines(spark, f"{folder}/*").select(F.regexp_extract("path", FILE, 1).cast("bigint").alias("file"), "pos", "prompt")


def _skill_folders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The tables' skills as folders, built-in and a user's; those of one region are broken."""
    root = scratch.shared_path(spark, "skills")
    header = F.concat(F.lit("---\nname: "), "name", F.lit("\ndescription: '"), "description", F.lit("'\n---\nHow to.\n"))
    made = _table_skills(spark, sf_dir)
    text = F.when((F.col("source") == "user") & F.col("description").endswith("region 0"), "no header").otherwise(header)
    docsrc.write_files(made.select(F.concat(F.ltrim("directory", F.lit("/")), F.lit("/SKILL.md")).alias("name"), text.alias("text")), root)
    return skills.discover(skills.scan(spark, f"{root}/b", f"{root}/u"))


@query(f"""
WITH {TABLE_SKILLS} SELECT name, CASE WHEN bad THEN NULL ELSE description END AS description, source, CASE WHEN bad THEN 'the header block is missing' END AS error
FROM (SELECT *, source = 'user' AND ends_with(description, 'region 0') AS bad FROM raw)
""")
def skill_scan(spark, sf_dir):
    good, bad = _skill_folders(spark, sf_dir)
    named = bad.select(F.regexp_extract("directory", "([^/]+)$", 1).alias("name"), F.lit(None).cast("string").alias("description"), "source", "error")
    return good.select("name", "description", "source", F.lit(None).cast("string").alias("error")).unionByName(named)


@query(f"WITH {TABLE_SKILLS} SELECT name, description FROM cat WHERE name = 's-7'")
def skill_lookup(spark, sf_dir):
    """One skill by name, from folders: the user's shadows the built-in one."""
    found = catalog.get_skill(catalog.shadowed(_skill_folders(spark, sf_dir)[0]), "s-7")
    return spark.range(1).select(*[F.lit(found[k]).alias(k) for k in ("name", "description")])


#: A user's skill for the queries, in two files: a factory and a metric, and what the factory's program calls.
CODE = """
from .cutting import words_of

def build():
    def program(text):
        words = words_of(text)
        return {"first": words[0] if words else "", "words": len(words)}
    return program

def same_merchant(gold, predicted):
    from pyspark.sql import functions as F
    return (F.lower(F.trim(gold["merchant"])) == F.lower(F.trim(predicted["merchant"]))).cast("int")
"""
CUTTING = """
def words_of(text):
    return (text or "").split()
"""


def _own_skill(spark: SparkSession) -> dict:
    """A user's skill in a folder; executors get its code, not the folder."""
    folder = scratch.shared_path(spark, "own-skill")
    scratch.save_text(spark, f"{folder}/skill.py", CODE)
    scratch.save_text(spark, f"{folder}/cutting.py", CUTTING)
    return {"name": "words", "source": "user", "directory": folder, "entrypoint": "skill:build", "metric": "skill:same_merchant"}


@query(r"SELECT doc_id, coalesce(w[1], '') AS first, len(w) AS words FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents)")
def skill_in_sql(spark, sf_dir):
    """A user's skill as a table function over all documents."""
    catalog.register_skill(spark, _own_skill(spark), "words_of_rows", "doc_id long", "first string, words long")
    table(spark, sf_dir, "documents").select("doc_id", "text").createOrReplaceTempView("skill_documents")
    return spark.sql("SELECT * FROM words_of_rows(TABLE(SELECT * FROM skill_documents))")


@query(r"SELECT item_id, w[1] AS first, len(w) AS words FROM (SELECT item_id, regexp_extract_all(text, '\S+') AS w FROM benchmark)")
def skill_run(spark, sf_dir):
    """A user's skill over every row of a table."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return catalog.run_skill(rows, _own_skill(spark), "first string, words long").select("item_id", "first", "words")


@query("SELECT o_orderkey AS example_id, (o_orderkey % 3 <> 0)::INT::DOUBLE AS score FROM orders")
def skill_metric(spark, sf_dir):
    """Examples scored by a skill's own metric."""
    return evaluation.scored(examples(spark, sf_dir), catalog.skill_metric(_own_skill(spark))).select("example_id", "score")


# Calls --------------------------------------------------------------------


@query("""
SELECT url AS origin, CASE WHEN length(url) % 4 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN length(url) % 4 <> 0 THEN length('<p>' || url || '</p>') END AS n_bytes,
    CASE WHEN length(url) % 4 = 0 THEN 'status 404' END AS error FROM pages
""")
def fetched_answers(spark, sf_dir):
    """Every page is asked for; the server is a stand-in that is busy at first, and has no page for some urls."""
    busy = set()

    def server(url):
        if url not in busy:
            busy.add(url)
            raise CallFailed("busy", kind="timeout")
        return (404, "", b"") if len(url) % 4 == 0 else (200, "text/html", f"<p>{url}</p>".encode())

    got = web.fetch(table(spark, sf_dir, "pages"), lambda u: scoring.call_with_retry(lambda: server(u), 1, lambda s: None), retries=0)
    return got.select("origin", "status", F.octet_length("content").cast("bigint").alias("n_bytes"), "error")


@query(f"""
WITH {ROUTE}, names AS (SELECT list(name ORDER BY name) AS n FROM cat)
SELECT item_id, coalesce(skill, CASE WHEN length(request) % 4 < 3 THEN n[length(request) % 4 + 1] END) AS skill,
    CASE WHEN skill IS NULL AND length(request) % 4 < 3 THEN 'selector' ELSE reason END AS reason FROM routed JOIN asked USING (item_id), names
""")
def route_selector(spark, sf_dir):
    """Ambiguous requests are settled by a stand-in for a model, which sometimes names no skill."""
    choose = lambda text, known: [*(n for n, _ in known), "none of them"][len(text) % 4]
    return catalog.route(_requests(spark, sf_dir), catalog.shadowed(_skills(spark)), selector=choose).select("item_id", "skill", "reason")


@query(f"WITH {SAMPLES} SELECT doc_id, seg_idx, sample_idx, score FROM samples")
def retried_scores(spark, sf_dir):
    """A model that is busy at every first attempt gives the same scores."""
    import hashlib

    failed = set()

    def model(segments, indexes):
        if segments[0] not in failed:
            failed.add(segments[0])
            raise ConnectionError("busy")
        failed.clear()
        return [(int(hashlib.md5(f"{s}#{i}".encode()).hexdigest()[:8], 16) % 21 - 10, "") for s, i in zip(segments, indexes, strict=True)]

    patient = lambda segments, indexes: scoring.call_with_retry(lambda: model(segments, indexes), 1, lambda s: None)
    cut = sentiment.explode_segments(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sentiment.coerced(scoring.score_with(scoring.resample(cut, 3), patient, retries=0)).select("doc_id", "seg_idx", "sample_idx", "score")


@query(f"""
WITH {SAMPLES} SELECT doc_id, round(avg(score), 6) + 0.0 AS one, round(avg((('0x' || substr(md5('b' || segment || '#' || sample_idx), 1, 8))::BIGINT % 21 - 10)::DOUBLE), 6) + 0.0 AS other
FROM samples GROUP BY doc_id
""")
def two_models(spark, sf_dir):
    """Two models in one plan, each with its own scope."""
    rows = stub_samples(spark, sf_dir).withColumn("b", scoring.stub_score(F.concat(F.lit("b"), F.col("segment")), F.col("sample_idx")))
    return rounded(rows.groupBy("doc_id").agg(F.avg("score").alias("one"), F.avg("b").alias("other")), "one", "other")


@query(f"WITH {SAMPLES} SELECT count(*) AS calls, sum(length(segment))::BIGINT AS usage FROM samples")
def run_metrics(spark, sf_dir):
    """What a run cost, observed while it runs: calls, and characters sent."""
    with reports.observed(stub_samples(spark, sf_dir), "scores", usage=F.char_length("segment")) as (rows, seen):
        rows.write.format("noop").mode("overwrite").save()
    return spark.range(1).select(F.lit(seen.calls).cast("bigint").alias("calls"), F.lit(seen.usage).cast("bigint").alias("usage"))


@query("SELECT event_id, kind FROM (SELECT event_id, event_type AS kind FROM events WHERE event_id >= 100 ORDER BY event_id DESC LIMIT 250)")
def last_calls(spark, sf_dir):
    """Of the calls since number 100 the last 250."""
    calls = table(spark, sf_dir, "events").select(F.col("event_id").alias("call_idx"), F.col("event_type").alias("kind"))
    return scoring.calls_since(calls, 100, 250).select(F.col("call_idx").alias("event_id"), "kind")


@query(f"WITH {EXAMPLES} SELECT 'extract' AS skill, round(avg(hits / 3.0), 6) + 0.0 AS score, count(*) AS n FROM hits")
def eval_report(spark, sf_dir):
    return rounded(reports.evaluation_report(evaluation.evaluate(evaluation.scored(examples(spark, sf_dir))), "extract"), "score")


@query(f"""
WITH {CANDIDATES} SELECT 'merchants' AS instructions, 8::BIGINT AS n_demos, round(b.score, 6) + 0.0 AS baseline,
    round((SELECT avg(((o_orderkey % 7 <> 0)::INT + 2) / 3.0) FROM orders), 6) + 0.0 AS after FROM marks b WHERE b.candidate = 'a-base'
""")
def program_search(spark, sf_dir):
    """The whole sequence: baseline, demonstrations, search over instructions, measure again, save and load."""
    path = f"{scratch.shared_path(spark, 'program')}/deep/program.json"
    orders = _gold(spark, sf_dir)
    run = lambda program, rows: evaluation.scored(evaluation.pair(rows, _predicted(rows, program)))
    found = optimization.optimize(run, orders, dev=orders, method="search", instructions=("", "merchants"), save_path=path)
    kept = optimization.Program.load(path)
    return rounded(spark.range(1).select(F.lit(kept.instructions).alias("instructions"), F.lit(len(kept.demos)).cast("bigint").alias("n_demos"), F.lit(found.baseline).alias("baseline"), F.lit(found.after).alias("after")), "baseline", "after")


def queries() -> dict[str, Query]:
    from quernel.plans import workflows  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
