"""Model calls as replayable operators: resampling, deduplication, retry, stand-ins.

A scorer is a plain function over a batch of (segment, sample index) pairs.  It is
passed explicitly to each operator, so one job can use several models and nothing
is configured process-wide.  The sample index is part of what is scored: repeated
samples of one segment are distinct calls, also behind a cache.
"""

from __future__ import annotations

import asyncio
import time
from collections.abc import Awaitable, Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.errors import CallFailed

R = TypeVar("R")
Scorer = Callable[[Sequence[str], Sequence[int]], Sequence[tuple[object, str]]]

#: Statuses and kinds of failures that pass: fixed values.
TRANSIENT_STATUS = (408, 409, 429)
TRANSIENT_KINDS = ("timeout", "connection")
LONGEST_WAIT = 10.0


def is_retryable(status: Column, kind: Column | None = None) -> Column:
    """Whether a failed call may succeed later: a timeout, a lost connection, or a status that says so."""
    by_status = status.isin(*TRANSIENT_STATUS) | (status >= 500)
    by_kind = kind.isin(*TRANSIENT_KINDS) if kind is not None else F.lit(False)
    return F.coalesce(by_kind, F.lit(False)) | F.coalesce(by_status, F.lit(False))


def backoff(attempt: Column) -> Column:
    """Seconds to wait after the attempt of this number, from 1."""
    return F.least(F.lit(LONGEST_WAIT), F.pow(F.lit(2.0), attempt - 1))


def transient(error: BaseException) -> bool:
    if isinstance(error, (TimeoutError, ConnectionError)):
        return True
    status = getattr(error, "status", None) or getattr(error, "status_code", None)
    return getattr(error, "kind", None) in TRANSIENT_KINDS or (isinstance(status, int) and (status in TRANSIENT_STATUS or status >= 500))


def wait_after(error: Exception, attempt: int, retries: int) -> float:
    """Seconds to wait after a failed attempt; raises ``error`` where no other attempt is due."""
    if attempt > retries or not transient(error):
        raise error
    return min(LONGEST_WAIT, 2.0 ** (attempt - 1))


def call_with_retry(call: Callable[[], R], retries: int = 2, sleep: Callable[[float], None] = time.sleep) -> R:
    """``call()``, again after transient failures only, at most ``retries`` more times."""
    for attempt in range(1, retries + 2):
        try:
            return call()
        except Exception as error:
            sleep(wait_after(error, attempt, retries))
    raise CallFailed("no attempt was allowed")


def counted_call(call: Callable[[], R], retries: int = 2, sleep: Callable[[float], None] = time.sleep) -> tuple[R | None, int, str | None]:
    """(answer, attempts, error): like :func:`call_with_retry`, but a call that fails for good is told, not raised."""
    for attempt in range(1, retries + 2):
        try:
            return call(), attempt, None
        except Exception as error:
            try:
                sleep(wait_after(error, attempt, retries))
            except Exception as last:
                return None, attempt, f"{type(last).__name__}: {last}"
    raise CallFailed("no attempt was allowed")


async def await_with_retry(call: Callable[[], Awaitable[R]], retries: int = 2, sleep: Callable[[float], Awaitable] = asyncio.sleep) -> R:
    """:func:`call_with_retry` for calls that are awaited; other calls go on meanwhile."""
    for attempt in range(1, retries + 2):
        try:
            return await call()
        except Exception as error:
            await sleep(wait_after(error, attempt, retries))
    raise CallFailed("no attempt was allowed")


def concurrent(call: Callable[[str, int], Awaitable[tuple[object, str]]], at_once: int = 8, retries: int = 2) -> Scorer:
    """A scorer of batches out of a coroutine function for one segment and sample index.

    Up to ``at_once`` calls of a batch are under way together, and each is retried alone.
    Give it to :func:`score_with` with ``retries=0``, or a batch would be sent again.
    """

    async def batch(segments: Sequence[str], indexes: Sequence[int]) -> list[tuple[object, str]]:
        free = asyncio.Semaphore(at_once)

        async def one(segment: str, index: int) -> tuple[object, str]:
            async with free:
                return await await_with_retry(lambda: call(segment, index), retries)

        return await asyncio.gather(*[one(s, i) for s, i in zip(segments, indexes, strict=True)])

    return lambda segments, indexes: asyncio.run(batch(segments, indexes))


def stub_score(segment: Column, sample_idx: Column) -> Column:
    """A deterministic stand-in for a model: a whole number from -10 to 10 by hash.

    It exercises the plumbing and the statistics and says nothing about sentiment.
    """
    digest = F.md5(F.concat(segment, F.lit("#"), sample_idx.cast("string")))
    return (F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(21)) - 10).cast("double")


#: Words of the lexicon scorer: fixed values.
GOOD = ("good", "great", "excellent", "love", "thrilled", "flawless", "happy", "best", "works")
BAD = ("bad", "terrible", "awful", "hate", "broken", "worst", "angry", "fails", "poor")


def lexicon_score(segment: Column) -> Column:
    """A tiny word-list scorer in the JVM: five points a word, cut to the scale."""
    words = F.regexp_extract_all(F.lower(segment), F.lit("[a-z]+"), F.lit(0))
    count = lambda listed: F.size(F.filter(words, lambda w: w.isin(*listed)))
    return F.greatest(F.lit(-10.0), F.least(F.lit(10.0), (count(GOOD) - count(BAD)) * 5.0))


def resample(segments: DataFrame, passes: int, keep: Sequence[str] | None = None) -> DataFrame:
    """Each row ``max(1, passes)`` times, numbered by ``sample_idx`` from 0."""
    columns = list(keep or segments.columns)
    return segments.select(*columns, F.explode(F.sequence(F.lit(0), F.lit(max(1, passes) - 1))).alias("sample_idx"))


def score_with(samples: DataFrame, scorer: Scorer, *, retries: int = 2, parallelism: int | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``raw`` (text) and ``rationale`` to rows with ``segment`` and ``sample_idx``.

    Of the rows' own columns only those of ``keep`` come back, where given.  ``parallelism`` bounds how many partitions, and so model clients, run at once.
    Retries happen inside the batch: Spark's own would send whole partitions again.
    """
    source = samples.repartition(parallelism) if parallelism else samples
    own = list(keep or source.columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*own).schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = call_with_retry(lambda f=frame: scorer(f["segment"].tolist(), f["sample_idx"].tolist()), retries)
            yield frame[own].assign(raw=[None if s is None else str(s) for s, _ in got], rationale=[r or "" for _, r in got])

    return source.mapInPandas(run, f"{fields}, raw string, rationale string")


Call = Callable[[str, int], tuple[object, str]]


def score_each(samples: DataFrame, call: Call, *, retries: int = 2, parallelism: int | None = None, at_once: int = 8, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Score rows by a function for one segment and sample index, each row retried alone.

    Adds ``raw``, ``rationale``, ``attempts`` and ``error``.  A call that fails for good leaves ``raw`` null and
    its reason in ``error``, and the rows beside it are scored all the same.  Up to ``at_once`` calls of a
    task wait together.  Attempts are part of the rows, so those of a task that Spark runs again, as after
    the loss of an executor, are counted once: what the result took, not what was lost on the way.
    """
    source = samples.repartition(parallelism) if parallelism else samples
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for frame in frames:
                one = lambda s, i: counted_call(lambda: call(s, i), retries, sleep)
                got = list(pool.map(one, frame["segment"].tolist(), frame["sample_idx"].tolist()))
                raw = [None if a is None or a[0] is None else str(a[0]) for a, _, _ in got]
                yield frame.assign(raw=raw, rationale=["" if a is None else a[1] or "" for a, _, _ in got], attempts=[n for _, n, _ in got], error=[e for _, _, e in got])

    return source.mapInPandas(run, f"{fields}, raw string, rationale string, attempts int, error string")


def call_costs(scored: DataFrame, keys: Sequence[str] = (), *, price_sent: float = 0.0, price_received: float = 0.0) -> DataFrame:
    """What scored rows took, in all or by ``keys``: (keys..., calls, attempts, failed, sent, received, cost).

    ``sent`` counts the characters of every attempt, ``received`` those of answers; prices are for a million.
    """
    received = F.coalesce(F.char_length("raw"), F.lit(0)) + F.coalesce(F.char_length("rationale"), F.lit(0))
    told = scored.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        F.coalesce(F.sum(F.col("attempts").cast("bigint")), F.lit(0)).alias("attempts"),
        F.count(F.when(F.col("error").isNotNull(), 1)).alias("failed"),
        F.coalesce(F.sum(F.char_length("segment").cast("bigint") * F.col("attempts")), F.lit(0)).alias("sent"),
        F.coalesce(F.sum(received.cast("bigint")), F.lit(0)).alias("received"),
    )
    return told.withColumn("cost", (F.col("sent") * price_sent + F.col("received") * price_received) / 1e6)


#: Sample indexes that share a row of :func:`asked_texts`, as bits of a long.
BITS = 63


def asked_texts(samples: DataFrame) -> DataFrame:
    """(segment, sample_idx, bits): each distinct segment once for up to :data:`BITS` sample indexes, so that texts move once."""
    index = F.col("sample_idx").cast("bigint")
    return samples.select("segment", F.floor(index / BITS).alias("sample_idx"), F.expr(f"shiftleft(1L, CAST(pmod(CAST(sample_idx AS BIGINT), {BITS}) AS INT))").alias("bit")).groupBy("segment", "sample_idx").agg(F.bit_or("bit").alias("bits"))


def calls_of(texts: DataFrame, kind: str = "int") -> DataFrame:
    """(segment, sample_idx): the distinct calls that :func:`asked_texts` holds, with indexes of this type."""
    set_ = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit("bits", i) == 1)
    indexes = F.when(F.col("sample_idx").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(F.transform(set_, lambda i: F.col("sample_idx") * BITS + i))
    return texts.select("segment", F.explode(indexes.cast(f"array<{kind}>")).alias("sample_idx"))


def score_distinct(samples: DataFrame, scorer: Scorer, **options) -> DataFrame:
    """:func:`score_with`, each distinct (segment, sample index) once, joined back.

    This is the response cache: copies of a segment cost one call.  Answers are told apart
    by 128 bits of hash, so that segments are not sent back as texts.
    """
    key = {"__call": F.unhex(call_key()), "__len": F.char_length("segment")}
    calls = calls_of(asked_texts(samples), samples.schema["sample_idx"].dataType.simpleString())
    scored = score_with(calls.withColumns(key), scorer, keep=list(key), **options)
    return samples.withColumns(key).join(scored, list(key)).drop(*key)


def call_key(segment: str = "segment", sample_idx: str = "sample_idx") -> Column:
    """What tells model calls apart: 128 bits of the segment and the sample index."""
    return F.md5(F.concat_ws("#", F.col(sample_idx).cast("string"), F.col(segment)))


def calls_since(calls: DataFrame, start: int, n: int | None = None, index: str = "call_idx") -> DataFrame:
    """The calls from number ``start`` on, and of these the last ``n`` where given."""
    added = calls.where(F.col(index) >= start)
    return added if n is None else added.orderBy(F.desc(index)).limit(n)


def distinct_calls(samples: DataFrame) -> DataFrame:
    """How many calls a table of samples asks for, and how many remain after deduplication."""
    per_call = samples.groupBy(call_key()).agg(F.count("*").alias("n"))
    return per_call.agg(F.sum("n").alias("calls"), F.count("*").alias("distinct_calls"))
