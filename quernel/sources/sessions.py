"""Chat sessions and prompt histories as tables."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.errors import BadInput
from quernel.functions.text import SESSION_NAME, decode_utf8
from quernel.sources.jsonl import numbered_lines

TURNS = "array<struct<text:string,answer:string>>"
MOST_PROMPTS = 1000


def session_turns(content: Column) -> Column:
    """The turns that a session's JSON holds: items with both a text and an answer, as
    strings; empty for JSON that isn't a list, null for what isn't JSON."""
    v = F.try_parse_json(content)
    items = F.try_variant_get(v, "$", "array<variant>")
    field = lambda t, k: F.try_variant_get(t, f"$.{k}", "string")
    has = lambda t, k: F.try_variant_get(t, f"$.{k}", "variant").isNotNull()
    full = F.filter(items, lambda t: has(t, "text") & has(t, "answer"))
    turns = F.transform(full, lambda t: F.struct(F.coalesce(field(t, "text"), F.lit("None")).alias("text"), F.coalesce(field(t, "answer"), F.lit("None")).alias("answer")))
    return F.when(v.isNull(), F.lit(None).cast(TURNS)).otherwise(F.coalesce(turns, F.array().cast(TURNS)))


def load_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """(session, turns, readable) of the JSON files in a folder; none for a folder that isn't there."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    except AnalysisException:
        return spark.createDataFrame([], f"session string, turns {TURNS}, readable boolean")
    turns = session_turns(decode_utf8(F.col("content")))
    name = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    return found.select(name.alias("session"), turns.alias("turns")).withColumn("readable", F.col("turns").isNotNull())


def session_json(turns: Column) -> Column:
    """Turns as the JSON that :func:`session_turns` reads."""
    return F.to_json(turns, {"ignoreNullFields": "false"})


def append_turn(turns: Column, text: Column, answer: Column) -> Column:
    return F.array_append(F.coalesce(turns, F.array().cast(TURNS)), F.struct(text.alias("text"), answer.alias("answer")))


def save_session(spark: SparkSession, folder: str, name: str, turns: list[dict[str, str]]) -> None:
    """Write one session's file anew; an empty list clears it."""
    import json

    from quernel.errors import BadInput
    from quernel.sources.scratch import save_text

    if not re.match(SESSION_NAME, name):
        raise BadInput(f"invalid session name {name!r}")
    save_text(spark, f"{folder.rstrip('/')}/{name}.json", json.dumps(turns, ensure_ascii=False, indent=2))


def prompt_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, prompt) of history files' lines that aren't empty, by place from 0; none for a missing file.

    Files are read by splits, like JSON Lines.
    """
    try:
        lines = numbered_lines(spark, path, stripped=False)
    except BadInput:
        return spark.createDataFrame([], "path string, pos bigint, prompt string")
    return lines.select("path", (F.col("line") - 1).alias("pos"), F.col("value").alias("prompt"))


def save_prompts(history: DataFrame, path: str) -> None:
    """Write the last prompts, newest last, as lines of text."""
    from quernel.operators.conversations import last_n

    rows = last_n(history, MOST_PROMPTS).orderBy("pos").select("prompt")
    rows.coalesce(1).write.mode("overwrite").text(path)
