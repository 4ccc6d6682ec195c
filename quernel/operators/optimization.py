"""Choosing demonstrations and prompts against a metric.

The search itself is driver-side orchestration; every scoring round is one job.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quernel.errors import BadInput
from quernel.functions.metrics import passes_gate
from quernel.operators.evaluation import evaluate
from quernel.sources.scratch import read_text, save_text

MAX_BOOTSTRAPPED, MAX_LABELED = 4, 8
#: Of the hash's range the part that is tried first.
SLICE = 1 / 64

#: Scores examples under a program: records with the key, ``hits`` and ``score``.
Run = Callable[["Program", DataFrame], DataFrame]


def order_by_hash(key: Column, seed: int = 0) -> Column:
    """A fixed shuffle of rows that any engine can repeat: md5 of seed and key."""
    return F.md5(F.concat_ws("#", F.lit(str(seed)), key.cast("string")))


def place(key: Column, seed: int = 0) -> Column:
    """Where a row stands in that shuffle, from 0 up to 1: the first 52 bits of the hash."""
    return F.conv(F.substring(order_by_hash(key, seed), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def bootstrap_demos(scored: DataFrame, key: str = "example_id", bootstrapped: int = MAX_BOOTSTRAPPED, labeled: int = MAX_LABELED, seed: int = 0) -> DataFrame:
    """(key, kind, position): demonstrations from training rows.

    Rows whose prediction passes the gate come first, up to ``bootstrapped``; rows
    that didn't become one of these fill up as labelled ones to ``labeled`` in all.
    They are looked for in hash order, slice by slice, so a job holds no more of the
    rows than it takes to find them, and all of them only where too few pass.
    """
    order = order_by_hash(F.col(key), seed)
    rows = scored.withColumn("__o", order)

    def least(found: DataFrame, n: int) -> list:
        """The first ``n`` of these rows, tried in slices of the hash's range that grow until there are as many."""
        at, got, low, high = place(F.col(key), seed), [], 0.0, SLICE
        while low < 1 and len(got) < n:
            got += found.where((at >= low) & (at < high)).orderBy("__o", key).select(key, "__o").limit(n - len(got)).collect()
            low, high = high, min(1.0, high * 4)
        return [(r["__o"], r[key]) for r in got]

    passed = least(rows.where(passes_gate(F.col("hits"))), bootstrapped)
    used = [k for _, k in passed if k is not None]
    rest = least(rows.where(F.coalesce(~F.col(key).isin(used), F.lit(True))) if used else rows, max(0, labeled))
    chosen = [*((k, "bootstrapped") for _, k in passed), *((k, "labeled") for _, k in rest)][: max(bootstrapped, labeled)]
    schema = f"{key} {scored.schema[key].dataType.simpleString()}, kind string, position int"
    return scored.sparkSession.createDataFrame([(k, kind, i) for i, (k, kind) in enumerate(chosen)], schema)


@dataclass
class Bootstrap:
    """Demonstrations as (key, kind, round), and how many rows were scored for them."""

    demos: list[tuple[object, str, int]] = field(default_factory=list)
    scored: int = 0


def bootstrap_rounds(run: Run, train: DataFrame, *, key: str = "example_id", bootstrapped: int = MAX_BOOTSTRAPPED, labeled: int = MAX_LABELED, max_rounds: int = 1, first: float = 1 / 64, growth: int = 4, seed: int = 0) -> Bootstrap:
    """Demonstrations from training rows that pass under a teacher, in rounds.

    The teacher of a round is the last round's program, that is, one with the demonstrations found until then.
    Rows are tried in hash order in batches that grow, each one a job, until enough have passed; rows that have
    passed aren't tried again.  Rows that never passed fill up as labelled ones to ``labeled`` in all.
    """
    out, at = Bootstrap(), place(F.col(key), seed)
    for number in range(1, max_rounds + 1):
        known = [k for k, _, _ in out.demos]
        teacher = Program(demos=_rows_of(train, known, key))
        low, high = 0.0, first
        while low < 1 and len(out.demos) < bootstrapped:
            left = train.where((at >= low) & (at < high) & ~F.col(key).isin(known)) if known else train.where((at >= low) & (at < high))
            seen = Observation()
            records = run(teacher, left).observe(seen, F.count("*").alias("n"))
            passed = records.where(passes_gate(F.col("hits"))).orderBy(order_by_hash(F.col(key), seed), key).select(key).limit(bootstrapped - len(out.demos)).collect()
            out.demos += [(r[key], "bootstrapped", number) for r in passed]
            out.scored += seen.get.get("n", 0)
            low, high = high, min(1.0, high * growth)
        if len(out.demos) == len(known) or len(out.demos) >= bootstrapped:
            break
    known = [k for k, _, _ in out.demos]
    rest = train.where(~F.col(key).isin(known)) if known else train
    fill = rest.orderBy(order_by_hash(F.col(key), seed), key).select(key).limit(max(0, labeled - len(known))).collect()
    out.demos += [(r[key], "labeled", 0) for r in fill]
    return out


def _rows_of(train: DataFrame, keys: list, key: str) -> list[dict]:
    """The training rows of a few keys, in the keys' order."""
    if not keys:
        return []
    rows = {r[key]: r.asDict() for r in train.where(F.col(key).isin(keys)).collect()}
    return [rows[k] for k in keys]


def candidate_scores(scored: DataFrame) -> DataFrame:
    """(candidate, n, score) of every candidate's scored examples."""
    return scored.groupBy("candidate").agg(F.count("*").alias("n"), F.avg("score").alias("score"))


def best_candidate(scores: DataFrame) -> DataFrame:
    """The candidate with the highest score; ties go to the name that sorts first."""
    return scores.orderBy(F.desc(F.round("score", 9)), "candidate").limit(1)


def lift(baseline: DataFrame, after: DataFrame) -> DataFrame:
    """One row: baseline, after, lift; both inputs are one-row evaluations."""
    b, a = baseline.select(F.col("score_frac").alias("baseline")), after.select(F.col("score_frac").alias("after"))
    both = b.withColumn("k", F.lit(1)).join(a.withColumn("k", F.lit(1)), "k").drop("k")
    return both.withColumn("lift", F.col("after") - F.col("baseline"))


@dataclass
class Program:
    """A compiled program: its state only."""

    instructions: str = ""
    demos: list[dict] = field(default_factory=list)

    def save(self, path: str | Path) -> None:
        """Write to the file system that owns the path, which on a cluster is the shared one."""
        save_text(SparkSession.active(), str(path), json.dumps({"instructions": self.instructions, "demos": self.demos}, indent=2, sort_keys=True, default=str))

    @classmethod
    def load(cls, path: str | Path) -> Program:
        return cls(**json.loads(read_text(SparkSession.active(), str(path))))


@dataclass(frozen=True)
class Optimized:
    program: Program
    baseline: float | None
    after: float | None
    save_path: str | None


def optimize(run: Run, train: DataFrame, *, dev: DataFrame | None = None, method: str = "bootstrap", instructions: tuple[str, ...] = ("",), save_path: str | Path | None = None, key: str = "example_id", seed: int = 0, max_rounds: int = 1) -> Optimized:
    """Check, baseline, compile, measure again, save.

    ``run(program, examples)`` gives scored records (with ``hits`` and ``score``).
    ``bootstrap`` picks demonstrations in up to ``max_rounds`` rounds; ``search`` also chooses one of the
    ``instructions``, with these demonstrations or without, by successive halving on ``dev`` or else ``train``.
    """
    if train.isEmpty():
        raise BadInput("the training set is empty")

    def measured(program: Program) -> float | None:
        return evaluate(run(program, dev)).first()["score_frac"] if dev is not None else None

    baseline = measured(Program())
    if method not in ("bootstrap", "search"):
        raise ValueError(f"unknown method {method!r}")
    found = bootstrap_rounds(run, train, key=key, max_rounds=max_rounds, seed=seed)
    demos = _rows_of(train, [k for k, _, _ in found.demos], key)
    program = Program(demos=demos)
    if method == "search":
        from quernel.operators.search import one_by_one, successive_halving

        options = [Program(i, d) for i in instructions for d in ([], demos)]
        best, _ = successive_halving(one_by_one(run), options, dev if dev is not None else train, key=key, seed=seed)
        program = options[best]
    after = measured(program)
    if save_path is not None:
        program.save(save_path)
    return Optimized(program, baseline, after, str(save_path) if save_path is not None else None)
