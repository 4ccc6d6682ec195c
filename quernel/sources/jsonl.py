"""JSON Lines with typed rows, line numbers and a quarantine for what doesn't fit."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.errors import BadInput
from quernel.functions.text import LINE_END, OTHER_ENDS, strip

#: Rows of the expense set: every field is needed.
EXPENSE = {"text": "string", "merchant": "string", "date": "string", "amount": "double"}
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _places(paths: pd.Series, splits: pd.Series, lines: pd.Series, last: tuple) -> tuple[pd.Series, tuple]:
    """Lines before each row in its split, for rows in the order of reading; ``last`` is the split that the row before was in, and its lines so far."""
    new = (paths != paths.shift(fill_value=last[0])) | (splits != splits.shift(fill_value=last[1]))
    before = lines.cumsum() - lines + last[2]
    # Since the start of a split only: less what was there then.
    places = before - before.where(new).ffill().fillna(0).astype("int64")
    return places, (paths.iloc[-1], splits.iloc[-1], int(places.iloc[-1] + lines.iloc[-1]))


def _place(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    last = ("", -1, 0)
    for paths, splits, lines in batches:
        if len(lines):
            lines, last = _places(paths, splits, lines, last)
        yield lines


def numbered_lines(spark: SparkSession, path: str, stripped: bool = True) -> DataFrame:
    """(path, line, value) of the files under ``path``; blank lines are numbered and then dropped.

    Values lose white space at both ends; if not ``stripped``, they don't, and only empty lines go.

    Files are read by splits.  A line's number is its place in the split, which is counted while the
    split is read, plus the number of lines in the splits before it, of which only the counts are
    brought together: one for each split but a file's first.  Texts aren't shuffled.
    """
    try:
        rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), (F.col("_metadata.file_block_length") < F.col("_metadata.file_size")).alias("cut"), F.make_valid_utf8("value").alias("value"))
    except AnalysisException as error:
        raise BadInput(f"{path}: there is no such file") from error
    # Line ends that the reader doesn't know are rare, so the pattern is kept for rows that have one.
    ends = reduce(or_, [F.contains("value", F.lit(c)) for c in OTHER_ENDS])
    parts = rows.withColumn("lines", F.when(ends, F.split("value", LINE_END, -1)).otherwise(F.array("value")))
    counts = parts.where("cut").groupBy("path", "split").agg(F.sum(F.size("lines")).alias("n"))
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("path", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")).where("split > 0")
    # Not deterministic for the optimizer: the rows must be all there, in the order of reading.
    place = F.pandas_udf(_place, "bigint").asNondeterministic()
    placed = parts.select("path", "split", "lines", place("path", "split", F.size("lines").cast("bigint")).alias("first"))
    before = F.when(F.col("split") == 0, 0).otherwise(F.coalesce("before", F.raise_error(F.lit("the files were cut differently when their lines were counted"))))
    each = placed.join(F.broadcast(starts), ["path", "split"], "left").select("path", (before + F.col("first")).alias("at"), F.posexplode(F.transform("lines", strip) if stripped else "lines").alias("pos", "value"))
    return each.select("path", (F.col("at") + F.col("pos") + 1).alias("line"), "value").where("value <> ''")


def _typed(v: Column, name: str, kind: str) -> Column:
    """A field as its type, or null where it is missing or doesn't fit.

    Texts must be texts.  Numbers may be written as texts of digits; booleans count as 0 and 1.
    """
    raw = F.try_variant_get(v, f"$.{name}", "variant")
    is_a = F.schema_of_variant(raw)
    text = F.try_variant_get(v, f"$.{name}", "string")
    if kind == "string":
        return F.when(is_a == "STRING", text)
    written = F.when(strip(text).rlike(NUMBER), strip(text).try_cast("double"))
    truth = F.when(text == "true", 1.0).when(text == "false", 0.0)
    return F.when(is_a == "STRING", written).when(is_a == "BOOLEAN", truth).otherwise(F.try_variant_get(v, f"$.{name}", "double"))


def parse(lines: DataFrame, fields: dict[str, str] = EXPENSE) -> DataFrame:
    """Add the ``fields`` and ``error``: null, ``invalid JSON`` or ``schema error: ...``."""
    # Parsed once a row: a generator's output is never expanded again, not by a filter on ``error`` either.
    row = F.transform(F.array(F.try_parse_json("value")), lambda v: F.struct(v.isNull().alias("broken"), *[_typed(v, k, kind).alias(f"field{i}") for i, (k, kind) in enumerate(fields.items())]))
    parsed = lines.select("*", F.explode(row).alias("__v"))
    typed = parsed.withColumns({k: F.col("__v")[f"field{i}"] for i, k in enumerate(fields)})
    missing = F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in fields]))
    error = F.when(F.col("__v")["broken"], "invalid JSON").when(F.size(missing) > 0, F.concat(F.lit("schema error: "), F.array_join(missing, ", ")))
    return typed.withColumn("error", error).drop("__v")


def good_rows(parsed: DataFrame, fields: dict[str, str] = EXPENSE) -> DataFrame:
    return parsed.where("error IS NULL").select("path", "line", *fields)


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.where("error IS NOT NULL").select("path", "line", "error", "value")


def load(spark: SparkSession, path: str, fields: dict[str, str] = EXPENSE) -> DataFrame:
    """All rows, or an error that names the first bad line as ``path:line: reason``."""
    parsed = parse(numbered_lines(spark, path), fields)
    # One pass finds the least bad line and counts the good ones.
    bad = F.when(F.col("error").isNotNull(), F.struct("path", "line", "error"))
    told = parsed.agg(F.min(bad).alias("first"), F.count(F.when(F.col("error").isNull(), 1)).alias("good")).first()
    if told["first"]:
        raise BadInput(f"{told['first']['path']}:{told['first']['line']}: {told['first']['error']}")
    if not told["good"]:
        raise BadInput(f"{path}: no valid rows")
    return good_rows(parsed, fields)


def run_input(spark: SparkSession, text: str | None = None, path: str | None = None) -> dict:
    """Inputs of a single run: a text wins over a file, which must hold a JSON object."""
    if text is not None:
        return {"text": text}
    if path is None:
        raise BadInput("a text or an input file is needed")
    import json

    try:
        content = spark.read.text(path, wholetext=True).first()
        found = json.loads(content["value"] if content else "")
    except (AnalysisException, ValueError) as error:
        raise BadInput(f"{path}: not readable as JSON: {error}") from error
    if not isinstance(found, dict):
        raise BadInput(f"{path}: a JSON object is needed")
    return found
