"""Evaluating typed extractions against gold records, and a rule-based extractor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.errors import BadInput
from quernel.functions.metrics import FIELDS, field_accuracy, field_hits
from quernel.functions.text import strip


def pair(gold: DataFrame, predicted: DataFrame, key: str = "example_id") -> DataFrame:
    """Gold and predictions of the same example as the structs ``gold`` and ``predicted``.

    An example without a prediction has null fields.
    """
    g = gold.select(key, F.struct(*FIELDS).alias("gold"))
    p = predicted.select(key, F.struct(*FIELDS).alias("predicted"))
    return g.join(p, key, "left")


def scored(pairs: DataFrame, metric: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Add ``hits`` and ``score``: the share of fields that match, or what ``metric`` makes of ``gold`` and ``predicted``."""
    kinds = {side: pairs.schema[side].dataType["amount"].dataType.simpleString() for side in ("gold", "predicted")}
    sides = {side: {k: F.col(f"{side}.{k}") for k in FIELDS} for side in kinds}
    hits = field_hits(sides["gold"], sides["predicted"], kinds["gold"], kinds["predicted"])
    return pairs.withColumn("hits", hits).withColumn("score", field_accuracy(F.col("hits")) if metric is None else metric(F.col("gold"), F.col("predicted")).cast("double"))


def evaluate(records: DataFrame) -> DataFrame:
    """One row from scored records: n, the mean as a share and as a percentage."""
    return records.agg(F.count("*").alias("n"), F.avg("score").alias("score_frac"), (F.avg("score") * 100).alias("score_pct"))


def require_examples(examples: DataFrame, what: str = "examples") -> DataFrame:
    if examples.isEmpty():
        raise BadInput(f"no valid rows in {what}")
    return examples


MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def extract_expense(text: Column) -> dict[str, Column]:
    """Merchant, ISO date and amount of an expense note by rules: a baseline, and a stand-in for a model.

    The date is the first that reads as Y-M-D, M/D/Y, Month D Y or D Month Y.  The
    amount is the last number with two decimals.  The merchant is the first run of
    capitalised words that isn't a month or a leading cue.
    """
    month_names = "|".join(MONTHS)
    ymd = F.regexp_extract(text, r"\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})\b", 0)
    mdy = F.regexp_extract(text, r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", 0)
    named = rf"(?i)\b({month_names})[a-z]*\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b"
    day_first = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({month_names})[a-z]*\.?,?\s+(\d{{4}})\b"
    number = F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(f"{i + 1:02d}"))])

    def iso(year: Column, month: Column, day: Column) -> Column:
        return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))

    def month_of(pattern: str, group: int) -> Column:
        return F.try_element_at(number, F.lower(F.regexp_extract(text, pattern, group)))

    date = (
        F.when(ymd != "", iso(*[F.regexp_extract(text, r"\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})\b", i) for i in (1, 2, 3)]))
        .when(mdy != "", iso(*[F.regexp_extract(text, r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", i) for i in (3, 1, 2)]))
        .when(text.rlike(named), iso(F.regexp_extract(text, named, 3), month_of(named, 1), F.regexp_extract(text, named, 2)))
        .when(text.rlike(day_first), iso(F.regexp_extract(text, day_first, 3), month_of(day_first, 2), F.regexp_extract(text, day_first, 1)))
    )
    amounts = F.regexp_extract_all(text, F.lit(r"(?<![\d-])(\d{1,3}(?:,\d{3})+|\d+)\.\d{2}(?!\d)"), F.lit(0))
    amount = F.regexp_replace(F.try_element_at(amounts, F.lit(-1)), ",", "").try_cast("double")
    cued = F.regexp_extract(text, r"(?:\bat|\bfrom|\bto)\s+((?:[A-Z][\w'&.]*\s?)+)", 1)
    leading = F.regexp_extract(text, r"^((?:[A-Z][\w'&.]*\s?)+)", 1)
    return {"merchant": strip(F.when(cued != "", cued).otherwise(leading)), "date": date, "amount": amount}


def extract(examples: DataFrame, text: str = "text", key: str = "example_id") -> DataFrame:
    return examples.select(key, *[c.alias(k) for k, c in extract_expense(F.col(text)).items()])
