"""Ordered turns: what came before each one, counts, first occurrences, the last ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_history(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", fields: tuple[str, ...] = ("role", "text")) -> DataFrame:
    """Add ``history``, all earlier turns of the conversation in order, and its size."""
    before = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    history = F.collect_list(F.struct(*fields)).over(before)
    return turns.withColumn("history", history).withColumn("n_history", F.size("history").cast("bigint"))


def with_turn_number(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    return turns.withColumn("turn_no", F.row_number().over(Window.partitionBy(conversation).orderBy(turn)))


def turn_counts(turns: DataFrame, conversation: str = "conv_id") -> DataFrame:
    return turns.groupBy(conversation).agg(F.count("*").alias("n_turns"))


def distinct_in_order(items: DataFrame, value: str, position: str) -> DataFrame:
    """Each value once, at its first position."""
    return items.groupBy(value).agg(F.min(position).alias(position))


def last_n(items: DataFrame, n: int, position: str = "pos") -> DataFrame:
    """The ``n`` rows with the highest positions: a bounded sort in every task, then a merge."""
    return items.orderBy(F.desc(position)).limit(n)


def most_recent_first(items: DataFrame, position: str = "pos") -> DataFrame:
    return items.orderBy(F.desc(position))


def seeded_history(stored: DataFrame, seed: DataFrame) -> DataFrame:
    """Stored prompts, then those of a session (both (pos, prompt)), each prompt once at its first place."""
    both = stored.select(F.lit(0).alias("part"), "pos", "prompt").unionByName(seed.select(F.lit(1).alias("part"), "pos", "prompt"))
    first = both.groupBy("prompt").agg(F.min(F.struct("part", "pos")).alias("first"))
    return first.select("prompt", "first.part", "first.pos")


def respond(turns: DataFrame, responder: Callable[[list[dict], str], str]) -> DataFrame:
    """Add ``answer`` to rows with ``history`` and ``text`` by a model's function."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in turns.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            histories = [[dict(t) if isinstance(t, dict) else t.asDict() for t in h] for h in frame["history"]]
            yield frame.assign(answer=[responder(h, t) for h, t in zip(histories, frame["text"], strict=True)])

    return turns.mapInPandas(run, f"{schema}, answer string")
