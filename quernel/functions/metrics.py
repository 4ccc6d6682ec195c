"""Extraction metrics as Columns over gold and predicted fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernel.functions.text import norm

TOLERANCE = 0.01
FIELDS = ("merchant", "date", "amount")


def parse_amount(c: Column, kind: str = "string") -> Column:
    """An amount as double: numbers as they are, booleans never, texts by their digits,
    points and minus signs; null where nothing parses."""
    if kind == "boolean":
        return F.lit(None).cast("double")
    if kind != "string":
        return c.cast("double")
    kept = F.regexp_replace(c, r"[^\d.\-]", "")
    return F.when(kept.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), kept.try_cast("double"))


def amount_matches(gold: Column, predicted: Column) -> Column:
    """Both known and within :data:`TOLERANCE`, in doubles."""
    return F.coalesce(F.abs(gold - predicted) <= TOLERANCE, F.lit(False))


def field_hits(gold: dict[str, Column], predicted: dict[str, Column], gold_kind: str = "double", predicted_kind: str = "string") -> Column:
    """How many of the three fields match."""
    amounts = amount_matches(parse_amount(gold["amount"], gold_kind), parse_amount(predicted["amount"], predicted_kind))
    same = [norm(gold[k]) == norm(predicted[k]) for k in ("merchant", "date")]
    return sum((x.cast("int") for x in (*same, amounts)), F.lit(0))


def field_accuracy(hits: Column) -> Column:
    return hits / F.lit(float(len(FIELDS)))


def passes_gate(hits: Column) -> Column:
    """Whether a prediction may become a demonstration: every field right."""
    return hits == len(FIELDS)


exact_match = passes_gate
