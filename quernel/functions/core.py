"""Building blocks for column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body uses it.

    A lambda's variable is the one thing in an expression that is never expanded again.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
