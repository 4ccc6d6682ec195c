"""The corpus pipeline: five stages over the table of documents.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All stages but
the last return the columns of ``documents``.

1. language: documents whose language can't be told are rejected: null text, no
   letter, no training row at all, or at least ``EVIDENCE`` characters of which the
   classifier finds no language likelier than all others together.  The others keep
   their row unchanged.  A low score rejects no shorter text: on the test tables
   these were clean.
2. lines: lines that at least ten documents share lose all their copies; a null
   text becomes an empty one, and ``n_chars`` follows the text.
3. near_duplicates: one document of each class of near copies stays, the one with
   the least id.
4. mixing: every document is emitted as often as the systematic sampling says.
5. tokens: every emitted document is encoded, decoded and described by digests.

Null texts and ids, empty and very long texts, ties, repeated rows, an empty table and
extra columns are treated as each operator states; extra columns pass through to the
last stage.  Of rows with equal id and text near_duplicates keeps the same one on every run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.bpe import bpe_encode
from quernel.llm.common import scratch, staged
from quernel.llm.langid import UNKNOWN, predict, train_on_documents
from quernel.llm.linededup import drop_repeated_lines
from quernel.llm.mixing import mix
from quernel.llm.neardup import drop_near_duplicates
from quernel.llm.queries import TOKENIZERS


#: Characters from which on a low score of the classifier is evidence.
EVIDENCE = 100


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = predict(docs, train_on_documents(docs))
    unsure = (F.col("score") < 0.5) & (F.char_length("text") >= EVIDENCE)
    return found.where((F.col("lang_pred") != UNKNOWN) & ~unsure).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe_encode(docs, f"{TOKENIZERS}/byte_bpe_50k.json", keep_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: Language identification, near duplicates, sampling and tokens can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage wrote on its way goes when its result is there
            docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}", kept=True)
    return STAGES[-1][1](spark, docs, sf_dir)
