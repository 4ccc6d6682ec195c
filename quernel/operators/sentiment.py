"""Sentiment of documents: segment, score repeatedly, aggregate in two levels.

Two forms of the aggregation give the same numbers.  :func:`summarize_samples`
groups a long table of samples, for scorers that run as jobs of their own.
:func:`summarize_rows` works on arrays inside a document's row, needs no shuffle at
all, and is what the standard query uses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.core import let
from quernel.functions.stats import coerce_score, confidence, polarity, sample_stdev, summary_columns
from quernel.functions.text import DEFAULT_MAX_SEGMENTS, segments
from quernel.operators.display import printed

DEFAULT_RESAMPLE = 3
EXCERPT_CHARS = 2000


def explode_segments(docs: DataFrame, max_segments: int = DEFAULT_MAX_SEGMENTS, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., seg_idx, segment) of every document with text."""
    return docs.select(*keep, F.posexplode(segments(F.col(text), max_segments)).alias("seg_idx", "segment"))


def segment_level(scored: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a segment: samples, mean, spread within the segment, last rationale.

    ``scored`` has ``score`` and ``sample_idx``, and ``rationale`` where there is one.
    """
    measures = [F.count("*").alias("n_samples"), F.avg("score").alias("seg_mean"), sample_stdev(F.col("score")).alias("seg_stdev")]
    if "rationale" in scored.columns:
        last = F.max_by("rationale", F.when(F.col("rationale") != "", F.col("sample_idx")))
        measures.append(F.coalesce(last, F.lit("")).alias("rationale"))
    return scored.where(F.col("score").isNotNull()).groupBy(*keys, "seg_idx").agg(*measures)


def _labelled(measured: DataFrame) -> DataFrame:
    n, mean, volatility = F.col("n_segments"), F.col("mean"), F.col("volatility")
    full = measured.withColumns(summary_columns(n, mean, volatility))
    return full.withColumns({"polarity": polarity(mean), "confidence": confidence(F.col("p_value"))})


def document_level(by_segment: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a document from segment rows; every segment weighs the same."""
    measured = by_segment.groupBy(*keys).agg(
        F.count("*").alias("n_segments"),
        F.sum("n_samples").alias("n_samples"),
        F.avg("seg_mean").alias("mean"),
        sample_stdev(F.col("seg_mean")).alias("volatility"),
        F.avg("seg_stdev").alias("model_uncertainty"),
    )
    return _labelled(measured)


def summarize_samples(scored: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return document_level(segment_level(scored, keys), keys)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def _stdev(values: Column, mean: Column) -> Column:
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    same = F.array_max(values) - F.array_min(values) == 0  # their mean may differ from them in its last bit
    return F.when((F.size(values) >= 2) & ~same, F.sqrt(squares / (F.size(values) - 1))).otherwise(0.0)


def score_rows(docs: DataFrame, scorer: Callable[[Column, Column], Column], *, passes: int = DEFAULT_RESAMPLE, max_segments: int = DEFAULT_MAX_SEGMENTS, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., samples): each document's scores as an array of arrays, by a Column scorer."""
    draws = F.sequence(F.lit(0), F.lit(max(1, passes) - 1))
    return docs.select(*keep, F.transform(segments(F.col(text), max_segments), lambda s: F.transform(draws, lambda i: scorer(s, i))).alias("samples"))


def _row_stats(samples: Column) -> Column:
    """The figures of one document's samples as a struct; every part is computed once."""

    def of_segment(s: Column) -> Column:
        return let(_mean(s), lambda m: F.struct(m.alias("mean"), _stdev(s, m).alias("sd"), F.size(s).alias("n")))

    def of_document(p: Column) -> Column:
        def around(means: Column) -> Column:
            return let(
                _mean(means),
                lambda m: F.struct(
                    F.size(p).cast("bigint").alias("n_segments"),
                    F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("n_samples"),
                    m.alias("mean"),
                    _stdev(means, m).alias("volatility"),
                    _mean(F.transform(p, lambda x: x["sd"])).alias("model_uncertainty"),
                ),
            )

        return let(F.transform(p, lambda x: x["mean"]), around)

    return let(F.transform(samples, of_segment), of_document)


def summarize_rows(scored: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a document from arrays of samples, without a shuffle; empty segments don't count."""
    filled = F.filter("samples", lambda s: F.size(s) > 0)
    # A generator drops what is empty without the optimizer repeating the work in a filter.
    some = F.filter(F.array(filled), lambda t: F.size(t) > 0)
    return _labelled(scored.select(*keys, F.explode(F.transform(some, _row_stats)).alias("s")).select(*keys, "s.*"))


def sentiment(docs: DataFrame, scorer: Callable[[Column, Column], Column], **options) -> DataFrame:
    """The whole chain over a table of documents with a Column scorer."""
    keep = options.get("keep", ("doc_id",))
    return summarize_rows(score_rows(docs, scorer, **options), keep)


def coerced(scored: DataFrame) -> DataFrame:
    """``score`` from a model's ``raw`` answer."""
    return scored.withColumn("score", coerce_score(F.col("raw")))


def excerpts(by_segment: DataFrame, keys: tuple[str, ...] = ("doc_id",), limit: int = EXCERPT_CHARS) -> DataFrame:
    """Per document a line for each segment in order, its mean to one decimal and its rationale, cut to ``limit``."""
    line = F.concat(F.lit("- ("), printed(F.col("seg_mean"), "+.1f", digits=2), F.lit(") "), F.col("rationale"))
    rows = by_segment.select(*keys, F.struct("seg_idx", line.alias("line")).alias("row")).groupBy(*keys).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return rows.select(*keys, F.left(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit(limit)).alias("excerpts"))


def explain(summary: DataFrame) -> DataFrame:
    """Add a plain-language ``explanation`` by a fixed template, in place of a model's prose."""
    verdict = F.concat(
        F.lit("Overall the text reads as "), F.col("polarity"), F.lit(" (mean "), printed(F.col("mean"), "+.2f"),
        F.lit(" over "), F.col("n_segments").cast("string"), F.lit(" segments, volatility "), printed(F.col("volatility"), ".2f"),
        F.lit("). Confidence that it differs from neutral: "), F.col("confidence"), F.lit("."),
    )
    return summary.withColumn("explanation", verdict)
