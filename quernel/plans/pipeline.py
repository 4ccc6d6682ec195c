"""A pipeline is a chain of functions from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Pipeline:
    steps: tuple[Step, ...] = ()

    def then(self, step: Step) -> Pipeline:
        return Pipeline((*self.steps, step))

    def __call__(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = df.transform(step)
        return df
