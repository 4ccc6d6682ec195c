"""A store of model responses that outlives a run.

Responses are addressed by content: the call's key is a hash of the model's name, the
sample index and the segment.  The store is a :class:`quernel.sources.store.BatchStore`: a
batch counts when all of it is written, so a lost run loses at most its open batch, and a
second run asks for nothing.  New calls are found by an anti-join that reads only the buckets
of the batch at hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators.scoring import Scorer, asked_texts, calls_of, score_with
from quernel.sources.store import BatchStore, in_batches


def response_key(model: str, segment: Column, sample_idx: Column) -> Column:
    """What tells calls apart across runs: 128 bits of model, sample index and segment."""
    return F.md5(F.concat_ws("#", F.lit(model), sample_idx.cast("string"), segment))


class ResponseStore(BatchStore):
    """(call, raw, rationale) by the call's key."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, "call", "raw string, rationale string")


def score_stored(samples: DataFrame, scorer: Scorer, store: ResponseStore, model: str = "default", batches: int = 4, **options) -> DataFrame:
    """:func:`score_with`, asking only for what ``store`` doesn't hold; adds ``raw`` and ``rationale``.

    Distinct calls are asked in ``batches`` parts of the key space, each of them a job that commits what it got.
    """
    key = response_key(model, F.col("segment"), F.col("sample_idx"))
    kind = samples.schema["sample_idx"].dataType.simpleString()
    calls = lambda texts: calls_of(texts, kind).withColumn("call", key)
    held = store.read()
    # Keys are compared before any text moves: where all are known, none does.
    if not store.batches() or not samples.select(key.alias("call")).distinct().join(held.select("call"), "call", "left_anti").isEmpty():
        in_batches(asked_texts(samples), store, lambda new: score_with(new, scorer, keep=["call"], **options), batches, calls)
    known = store.read().select(F.unhex("call").alias("__call"), "raw", "rationale")
    return samples.withColumn("__call", F.unhex(key)).join(known, "__call").drop("__call")
