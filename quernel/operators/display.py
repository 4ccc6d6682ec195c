"""Figures as people see them: rounded from the binary value, ties to even, as in Python.

These are the last step over a few rows, in Arrow batches; nothing is computed from them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.pandas.functions import pandas_udf


def printed(c: Column, form: str, digits: int | None = None) -> Column:
    """A number in a format such as ``+.2f``, after rounding it to ``digits`` where given."""

    @pandas_udf("string")
    def written(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else format(v if digits is None else round(v, digits), form))

    return written(c)
