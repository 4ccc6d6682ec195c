"""Skill folders: a description file with a header block, validated row by row.

A bad description never hides the others: it becomes a row of errors.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions.core import let
from quernel.functions.text import LINE_END, SPACE, decode_utf8, strip

FENCE = "---"
FIELDS = ("name", "description", "entrypoint", "model", "trainset", "devset", "metric", "version")
NAME = r"^[a-z][a-z0-9_-]*$"
BUILTIN, USER = "builtin", "user"


def _block(value: Column) -> Column:
    """The text of a block scalar: ``|`` keeps line ends, ``>`` folds them; ``-`` drops the last one."""

    def chomped(kept: Column) -> Column:
        folded = F.regexp_replace(F.regexp_replace(kept, r"(?<!\n)\n(?!\n)", " "), r"\n(\n+)", "$1")
        text = F.when(value.rlike(r"^[ \t]*>"), folded).otherwise(kept)
        return F.when(value.rlike(r"^[ \t]*[|>]-") | (kept == ""), text).otherwise(F.concat(text, F.lit("\n")))

    def unindented(body: Column) -> Column:
        indent = F.regexp_extract(body, r"^(?:[ \t]*\n)*( *)[^ \n]", 1)
        return F.regexp_replace(F.regexp_replace(body, F.concat(F.lit("(?m)^"), indent), F.lit("")), r"\s+$", "")

    body = F.regexp_replace(F.regexp_extract(value, r"(?s)^[^\n]*\n(.*)$", 1), r"(?m)^#[^\n]*\n?", "")
    return let(let(body, unindented), chomped)


def _scalar(value: Column) -> Column:
    """What follows a key: a block, a quoted or a plain text; the last two may go on over lines. Empty for no value."""
    double = rf"""^[{SPACE}]*"((?:[^"\\]++|\\.)*+)"[{SPACE}]*(?:[{SPACE}]#.*)?$"""
    single = rf"""^[{SPACE}]*'((?:[^']++|'')*+)'[{SPACE}]*(?:[{SPACE}]#.*)?$"""

    def escaped(inside: Column) -> Column:
        return F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), inside, F.lit('"]')), "array<string>"), F.lit(0)), inside)

    def in_line(line: Column) -> Column:
        plain = strip(F.regexp_replace(line, rf"[{SPACE}]#.*$", ""))
        return (
            F.when(line.rlike(double), let(F.regexp_extract(line, double, 1), escaped))
            .when(line.rlike(single), F.replace(F.regexp_extract(line, single, 1), F.lit("''"), F.lit("'")))
            .otherwise(let(plain, lambda p: F.when(p.isin("~", "null"), "").otherwise(p)))
        )

    def any_kind(v: Column) -> Column:
        line = F.regexp_replace(F.regexp_replace(v, r"\n[ \t]*#[^\n]*", ""), r"[ \t]*\n\s*", " ")
        return F.when(v.rlike(r"^[ \t]*[|>][+-]?[ \t]*(?:#[^\n]*)?(?:\n|$)"), _block(v)).otherwise(let(line, in_line))

    return let(value, any_kind)


def _pairs(header: Column) -> Column:
    """The header's entries as structs: key, value, and whether there is a colon."""

    def leveled(h: Column) -> Column:
        return F.regexp_replace(h, F.concat(F.lit("(?m)^"), F.regexp_extract(h, r"(?:^|\n)( *)[^\s#]", 1)), F.lit(""))

    entries = F.filter(F.split(let(F.regexp_replace(header, LINE_END, "\n"), leveled), r"\n(?=[^\s#])", -1), lambda x: strip(F.regexp_replace(x, r"(?m)^[ \t]*#[^\n]*", "")) != "")
    return F.transform(entries, lambda x: F.struct(strip(F.regexp_extract(x, r"^([^:]*):", 1)).alias("k"), _scalar(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1)).alias("v"), x.contains(":").alias("ok")))


def _checked(body: Column, parts: Column, pair: Column) -> Column:
    """The manifest's struct from its body, the parts between fences and the header's entries."""
    has = lambda k: F.exists(pair, lambda p: p["k"] == k)
    value = lambda k: F.get(F.transform(F.filter(pair, lambda p: p["k"] == k), lambda p: F.nullif(p["v"], F.lit(""))), F.lit(0))
    extra = F.filter(F.transform(pair, lambda p: p["k"]), lambda k: ~k.isin(*FIELDS))
    error = (
        F.when(~body.startswith(FENCE), "the header block is missing")
        .when(F.size(parts) < 3, "the header block is not closed")
        .when(F.exists(pair, lambda p: ~p["ok"]), "the header block must be a mapping")
        .when(F.size(extra) > 0, F.concat(F.lit("unknown fields: "), F.array_join(extra, ", ")))
        .when(~has("name") | ~has("description"), "name and description are needed")
        .when(~F.coalesce(value("name").rlike(NAME), F.lit(False)), "the name is not valid")
        .when(~F.coalesce(value("metric"), F.lit(":")).contains(":"), "a metric is module:attribute")
    )
    entry = F.coalesce(value("entrypoint"), F.lit("skill:build"))
    own = [value(k).alias(k) for k in FIELDS if k != "entrypoint"]
    module, attr = F.split_part(entry, F.lit(":"), F.lit(1)), F.when(entry.contains(":"), F.regexp_extract(entry, "^[^:]*:(.*)$", 1)).otherwise("build")
    return F.struct(*own, entry.alias("entrypoint"), module.alias("module"), attr.alias("attr"), error.alias("error"))


def parse_manifest(text: Column) -> Column:
    """A struct of the header's fields and ``error`` (null where the manifest is valid).

    The header is a mapping of texts between two fences, in the part of YAML that such
    headers use: plain, quoted and block texts, comments, values that go on over
    indented lines.  Flow and nested collections are refused as unknown or invalid.
    Every step is computed once a text, however many fields are made of it.
    """

    def of(body: Column) -> Column:
        return let(F.split(body, FENCE, 3), lambda parts: let(_pairs(F.get(parts, F.lit(1))), lambda pair: _checked(body, parts, pair)))

    return let(F.regexp_replace(text, rf"^[{SPACE}]+", ""), of)


def scan(spark: SparkSession, builtin: str | None, user: str | None) -> DataFrame:
    """(source, directory, text) of every folder directly under the two that has a description file."""
    out = spark.createDataFrame([], "source string, directory string, text string")
    for source, root in ((BUILTIN, builtin), (USER, user)):
        if root is None:
            continue
        try:
            found = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/SKILL.md")
        except AnalysisException:
            continue
        out = out.unionByName(found.select(F.lit(source).alias("source"), F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("directory"), decode_utf8(F.col("content")).alias("text")))
    return out


def discover(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid skills, and (source, directory, error) of the others."""
    read = found.withColumn("m", parse_manifest(F.col("text")))
    good = read.where("m.error IS NULL").select("source", "directory", *[f"m.{k}" for k in (*FIELDS, "module", "attr")])
    bad = read.where("m.error IS NOT NULL").select("source", "directory", F.col("m.error").alias("error"))
    return good, bad


def dataset_path(directory: Column, relative: Column) -> Column:
    """A skill's data file, or null where it names none."""
    return F.when(relative.isNotNull(), F.concat_ws("/", F.regexp_replace(directory, "/+$", ""), relative))
