"""Reports: JSON rows, the printed forms of a result, and what a run cost."""

from __future__ import annotations

import time
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def json_row(df: DataFrame) -> Column:
    """All columns as one JSON object with sorted keys; nulls are written."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def as_json(df: DataFrame) -> DataFrame:
    return df.select(json_row(df).alias("json"))


#: Digits of each figure in a report: fixed values.
DIGITS = {"mean": 2, "volatility": 3, "model_uncertainty": 3, "std_error": 3, "t_statistic": 3, "p_value": 4, "ci_low": 2, "ci_high": 2}


def presented(summary: DataFrame) -> DataFrame:
    """A summary with its figures rounded for display, from the binary value and ties to even; labels keep what the full figures said."""
    digits = [DIGITS.get(c) for c in summary.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c if d is None else pa.array([None if v is None else round(v, d) for v in c.to_pylist()], c.type) for c, d in zip(batch.columns, digits, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return summary.mapInArrow(run, summary.schema)


def sentiment_report(row: dict, origins: Sequence[str] = ()) -> str:
    """One document's summary as a short paragraph."""
    said = [f"{row['polarity'].capitalize()}, {row['mean']:+.2f} on a scale from -10 to 10, over {row['n_segments']} segments that differ by {row['volatility']:.2f}."]
    said.append(f"{row['n_samples']} samples put the model's own spread at {row['model_uncertainty']:.2f}.")
    if row["p_value"] is None:
        said.append("Too little text to test against neutral.")
    else:
        within = f", 95 % between {row['ci_low']:+.2f} and {row['ci_high']:+.2f}" if row["ci_low"] is not None else ""
        said.append(f"Difference from neutral: {row['confidence']} (p {row['p_value']:.4f}{within}).")
    said += [f"Read from {', '.join(origins)}."] if origins else []
    return " ".join([*said, *([row["explanation"]] if row.get("explanation") else [])])


def as_fields(result: object) -> dict:
    """A prediction as a dictionary: rows and mappings as they are, anything else as the text of its only field."""
    if hasattr(result, "asDict"):
        return result.asDict()
    return dict(result) if isinstance(result, Mapping) else {"result": str(result)}


def fields_report(result: object) -> str:
    """A result's fields, one a line, sorted by name."""
    row = as_fields(result)
    return "\n".join(f"{k}: {row[k]}" for k in sorted(row))


def evaluation_report(evaluated: DataFrame, skill: str) -> DataFrame:
    """(skill, score, n) of a one-row evaluation."""
    return evaluated.select(F.lit(skill).alias("skill"), F.col("score_frac").alias("score"), "n")


def optimization_report(baseline: float | None, after: float | None) -> str:
    if baseline is None or after is None:
        return "Nothing measured: there was no evaluation set."
    return f"Score {baseline:.4f} before and {after:.4f} after, a lift of {after - baseline:+.4f}."


@dataclass
class RunMetrics:
    name: str
    model: str = ""
    elapsed_s: float = 0.0
    calls: int = 0
    usage: int = 0


@contextmanager
def observed(df: DataFrame, name: str, model: str = "", usage: Column | None = None) -> Iterator[tuple[DataFrame, RunMetrics]]:
    """``df`` with its rows counted, and their ``usage`` (tokens, say) summed, while it runs; the figures are there after the block."""
    seen, metrics, began = Observation(f"{name}-{time.time_ns()}"), RunMetrics(name, model), time.monotonic()
    spent = F.coalesce(F.sum(usage), F.lit(0)) if usage is not None else F.sum(F.lit(0))
    yield df.observe(seen, F.count(F.lit(1)).alias("calls"), spent.cast("bigint").alias("usage")), metrics
    metrics.elapsed_s = time.monotonic() - began
    metrics.calls, metrics.usage = seen.get["calls"], seen.get["usage"] or 0
