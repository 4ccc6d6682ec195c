"""Searching programs against a metric without trying every program on every row.

:func:`successive_halving` scores all programs on a small slice of the validation rows, lets
the best part go on to a slice several times as large, and so on to all rows.  Slices are cut
by the hash of a row's key, one inside the next, so a row is never scored twice under one
program and no row needs a number.  Every rung is one job over (program, row) pairs, which
returns one sum a program.

Where instructions and sets of demonstrations make too many programs even for one slice,
:func:`search_programs` lets a surrogate propose them: Bayesian linear regression of the mean
score on which instruction and which demonstrations a program has.  It picks the programs
with the best mixture of predicted score and uncertainty, batch by batch, and halving
decides among all that were tried.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.errors import BadInput
from quernel.operators.optimization import Program, place

#: Share of the validation rows on the first rung, and how much each next one has more of.
FIRST_SHARE, GROWTH = 1 / 64, 4

#: Scores rows under programs: (programs, rows with a column ``candidate``, which program to take) to rows with ``candidate`` and ``score``.
Trial = Callable[[Sequence[Program], DataFrame], DataFrame]


@dataclass
class Tried:
    """What is known of one program: rows scored, sum of scores, and the last rung it reached."""

    n: int = 0
    total: float = 0.0
    rung: int = -1

    @property
    def score(self) -> float:
        return round(self.total / self.n, 9) if self.n else float("-inf")


@dataclass
class Trials:
    """Programs and their records; every call of :meth:`score` is one job."""

    trial: Trial
    examples: DataFrame
    key: str = "example_id"
    seed: int = 0
    programs: list[Program] = field(default_factory=list)
    records: list[Tried] = field(default_factory=list)
    calls: int = 0

    def add(self, programs: Sequence[Program]) -> list[int]:
        first = len(self.programs)
        self.programs += programs
        self.records += [Tried() for _ in programs]
        return list(range(first, len(self.programs)))

    def score(self, candidates: Sequence[int], low: float, high: float, rung: int) -> int:
        """Score these programs on the rows whose place is in [low, high); how many rows there were for each."""
        at = place(F.col(self.key), self.seed)
        rows = self.examples.where((at >= low) & (at < high))
        pairs = rows.withColumn("candidate", F.explode(F.array(*[F.lit(c) for c in candidates])))
        sums = self.trial(self.programs, pairs).groupBy("candidate").agg(F.count("*").alias("n"), F.sum("score").alias("total")).collect()  # one row a program
        for r in sums:
            record = self.records[r["candidate"]]
            record.n, record.total = record.n + r["n"], record.total + r["total"]
            self.calls += r["n"]
        for c in candidates:
            self.records[c].rung = rung
        return max((r["n"] for r in sums), default=0)

    def ranked(self, candidates: Sequence[int]) -> list[int]:
        """Best first; ties go to the program that was added first."""
        return sorted(candidates, key=lambda c: (-self.records[c].score, c))

    def halve(self, candidates: Sequence[int], share: float, growth: int = GROWTH, seen: bool = False) -> int:
        """The best program by rungs of growing size; ``seen`` if all of them have been scored on the first one."""
        alive, low, high, rung = list(candidates), 0.0, min(1.0, share), 0
        while True:
            met = 1 if seen and rung == 0 else self.score(alive, low, high, rung)
            if high >= 1.0:
                return self.ranked(alive)[0]
            if met:  # a slice without rows decides nothing
                alive = self.ranked(alive)[: max(1, -(-len(alive) // growth))]
            low, high, rung = high, min(1.0, high * growth), rung + 1


def successive_halving(trial: Trial, programs: Sequence[Program], examples: DataFrame, *, share: float = FIRST_SHARE, growth: int = GROWTH, key: str = "example_id", seed: int = 0) -> tuple[int, Trials]:
    """(the best program's number, all trials)."""
    if not programs:
        raise BadInput("no program to choose from")
    trials = Trials(trial, examples, key, seed)
    return trials.halve(trials.add(programs), share, growth), trials


Choice = tuple[int, tuple[int, ...]]


@dataclass(frozen=True)
class Space:
    """Programs of one of the instructions and up to ``most`` of the demonstrations, in their order."""

    instructions: Sequence[str]
    demos: Sequence[dict]
    most: int = 4

    def program(self, choice: Choice) -> Program:
        return Program(self.instructions[choice[0]], [self.demos[d] for d in choice[1]])

    def features(self, choices: Sequence[Choice]) -> np.ndarray:
        """A constant, which instruction, which demonstrations."""
        x = np.zeros((len(choices), 1 + len(self.instructions) + len(self.demos)))
        x[:, 0] = 1
        for row, (i, ds) in zip(x, choices, strict=True):
            row[1 + i] = 1
            row[[1 + len(self.instructions) + d for d in ds]] = 1
        return x

    def draw(self, r: random.Random) -> Choice:
        n = r.randint(0, min(self.most, len(self.demos)))
        return r.randrange(len(self.instructions)), tuple(sorted(r.sample(range(len(self.demos)), n)))

    def near(self, choice: Choice, r: random.Random) -> Choice:
        """With another instruction, or with one demonstration more, less or exchanged."""
        i, ds = choice
        if r.random() < 0.5 or not self.demos:
            return r.randrange(len(self.instructions)), ds
        kept, d = set(ds), r.randrange(len(self.demos))
        kept ^= {d}
        while len(kept) > self.most:
            kept.remove(r.choice(sorted(kept - {d})))
        return i, tuple(sorted(kept))

    def size(self) -> int:
        """How many programs there are."""
        from math import comb

        return len(self.instructions) * sum(comb(len(self.demos), n) for n in range(min(self.most, len(self.demos)) + 1))


class Surrogate:
    """Bayesian linear regression of mean scores: predicts a score and how uncertain it is."""

    def __init__(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, noise: float = 0.25, spread: float = 0.05):
        self.mean = float(np.average(y, weights=n)) if n.sum() else 0.0
        weights = n / noise
        self.covariance = np.linalg.inv(np.eye(x.shape[1]) / spread + (x * weights[:, None]).T @ x)
        self.coefficients = self.covariance @ (x.T @ (weights * (y - self.mean)))

    def bound(self, x: np.ndarray, width: float = 1.0) -> np.ndarray:
        """Upper ends of the predictions."""
        return self.mean + x @ self.coefficients + width * np.sqrt(np.einsum("ij,jk,ik->i", x, self.covariance, x))


def propose(space: Space, tried: dict[Choice, Tried], batch: int, r: random.Random, pool: int = 512) -> list[Choice]:
    """``batch`` programs that weren't tried: at random at first, then those with the highest upper bound in a pool of
    random ones and neighbours of the best."""
    fresh: dict[Choice, None] = {}
    best = sorted(tried, key=lambda c: -tried[c].score)[:8]
    for _ in range(20 * pool):
        if len(fresh) >= min(pool if tried else batch, space.size() - len(tried)):
            break
        choice = space.near(r.choice(best), r) if best and r.random() < 0.5 else space.draw(r)
        if choice not in tried:
            fresh[choice] = None
    options = list(fresh)
    scored = [c for c in tried if tried[c].n]
    if scored and options:
        known = Surrogate(space.features(scored), np.array([tried[c].score for c in scored]), np.array([float(tried[c].n) for c in scored]))
        order = np.argsort(-known.bound(space.features(options)), kind="stable")
        options = [options[i] for i in order]
    return options[:batch]


def search_programs(trial: Trial, space: Space, examples: DataFrame, *, batch: int = 16, rounds: int = 4, share: float = FIRST_SHARE, growth: int = GROWTH, key: str = "example_id", seed: int = 0) -> tuple[Program, Trials]:
    """(the best program found, all trials): ``rounds`` batches proposed by the surrogate, then halving."""
    if not space.instructions:
        raise BadInput("no instruction to choose from")
    r, trials, tried = random.Random(seed), Trials(trial, examples, key, seed), {}
    for _ in range(rounds):
        chosen = propose(space, tried, batch, r)
        if not chosen:
            break
        numbers = trials.add([space.program(c) for c in chosen])
        trials.score(numbers, 0.0, share, 0)
        tried |= {c: trials.records[n] for c, n in zip(chosen, numbers, strict=True)}
    best = trials.halve(range(len(trials.programs)), share, growth, seen=True)
    return trials.programs[best], trials


def one_by_one(run: Callable[[Program, DataFrame], DataFrame]) -> Trial:
    """A trial out of a function for one program; its plan has a branch for each, so few programs only."""

    def trial(programs: Sequence[Program], pairs: DataFrame) -> DataFrame:
        parts = [run(p, pairs.where(F.col("candidate") == i).drop("candidate")).select(F.lit(i).alias("candidate"), "score") for i, p in enumerate(programs)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    return trial


def by_candidate(values: Sequence[Column]) -> Column:
    """Of one value a program the one of the row's ``candidate``, for trials made of Columns."""
    return F.get(F.array(*values), F.col("candidate"))
