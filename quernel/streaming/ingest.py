"""Sentiment over files as they arrive.  The scoring of a document needs nothing but
its own row, so the batch transform runs unchanged on a stream, without state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernel.operators.scoring import stub_score
from quernel.operators.sentiment import sentiment


def documents_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string", files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def sentiment_stream(docs: DataFrame, scorer: Callable[[Column, Column], Column] = stub_score) -> DataFrame:
    return sentiment(docs, scorer)


def polarity_counts(scored: DataFrame) -> DataFrame:
    """Running counts of labels, for complete output mode."""
    return scored.groupBy("polarity").agg(F.count("*").alias("n"))


def write_stream(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append results as Parquet, once each, and stop when all present files are done."""
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
