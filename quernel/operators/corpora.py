"""Corpora larger than a row: segmenting and scoring many documents as one text.

The rule is that of :func:`quernel.sources.documents.corpus` and
:func:`quernel.functions.text.segments`: texts are joined by blank lines, in order; two or
more paragraphs are the units, a single one is cut into sentences; consecutive units are
joined to segments.  Here no task sees a corpus.  A document only says how many units it
has; the number of its first unit is the count before it, summed in two levels: over blocks
of documents that lie next to each other, and within a block.  A unit's segment is its number
divided by the units a segment takes, and only the units of one segment meet.

Null and blank texts have no unit.  Documents of equal order go by their text's MD5, and
repeated rows are all kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.errors import BadInput
from quernel.functions.text import DEFAULT_MAX_SEGMENTS, paragraphs, sentences
from quernel.sources.scratch import staged


def _same(a: str, b: str, columns: Sequence[str]):
    """Null-safe equality of the columns of two aliased tables."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def numbered_units(docs: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """(keys..., __number, __total, __unit): every corpus's units by number from 0, and how many it has.

    ``keys`` tell corpora apart; without any, all documents are one.
    """
    corpus, place = [f"__k{i}" for i in range(max(1, len(keys)))], [f"__o{i}" for i in range(len(order))]
    named = [F.col(k).alias(c) for k, c in zip(keys, corpus, strict=True)] if keys else [F.lit(0).alias("__k0")]
    rows = docs.select(*named, *[F.col(o).alias(p) for o, p in zip(order, place, strict=True)], F.col(text).cast("string").alias("__text")).where(F.col("__text").isNotNull())
    own = [*corpus, *place, "__digest"]
    # Equal rows become one with a number of copies, so that a row's keys are its own.
    texts = rows.withColumn("__digest", F.md5("__text")).groupBy(*own).agg(F.first("__text").alias("__text"), F.count("*").alias("__copies"))
    light = rows.select(*corpus, *place, F.md5("__text").alias("__digest"), F.size(paragraphs(F.col("__text"))).cast("bigint").alias("__n"))
    light = light.where(F.col("__n") > 0).groupBy(*own).agg(F.first("__n").alias("__each"), F.sum("__n").alias("__n"))
    # Block numbers come from one writing of the ordered table; a second evaluation could cut it elsewhere.
    blocks = staged(light.repartitionByRange(*own).withColumn("__block", F.spark_partition_id()), "blocks")
    sums = blocks.groupBy(*corpus, "__block").agg(F.sum("__n").alias("__in_block"))
    whole = Window.partitionBy(*corpus)
    earlier = whole.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"__before": F.coalesce(F.sum("__in_block").over(earlier), F.lit(0)), "__total": F.sum("__in_block").over(whole)})
    inside = Window.partitionBy(*corpus, "__block").orderBy(*place, "__digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("__within", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    placed = placed.alias("p").join(sums.alias("s"), _same("p", "s", [*corpus, "__block"])).select(*[F.col(f"p.{c}").alias(c) for c in own], (F.col("__before") + F.col("__within")).alias("__first"), "__each", "__total")
    units = paragraphs(F.col("__text"))
    found = texts.alias("t").join(placed.alias("p"), _same("t", "p", own)).select(*[F.col(f"t.{c}").alias(c) for c in corpus], "__copies", "__first", "__each", "__total", units.alias("__units"))
    single = F.col("__total") == 1
    found = found.withColumn("__units", F.when(single, sentences(F.get("__units", F.lit(0)))).otherwise(F.col("__units")))
    found = found.withColumn("__total", F.when(single, F.size("__units").cast("bigint")).otherwise(F.col("__total")))
    copies = found.select(*corpus, "__first", "__each", "__total", "__units", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__copies") - 1)).alias("__copy"))
    parts = copies.select(*corpus, "__first", "__each", "__total", "__copy", F.posexplode("__units").alias("__pos", "__unit"))
    number = F.col("__first") + F.col("__copy") * F.col("__each") + F.col("__pos")
    return parts.select(*[F.col(c).alias(k) for k, c in zip(keys, corpus, strict=False)], number.alias("__number"), "__total", "__unit")


def corpus_segments(docs: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("doc_id",), text: str = "text", *, max_segments: int | None = None, units_per_segment: int | None = None) -> DataFrame:
    """(keys..., seg_idx, segment) of every corpus.

    ``max_segments`` is the rule for one text (:data:`DEFAULT_MAX_SEGMENTS` by default): segments grow with the corpus.
    With ``units_per_segment`` their number grows instead, and a segment stays as small as so many units.
    """
    if max_segments is not None and units_per_segment is not None:
        raise BadInput("give max_segments or units_per_segment, not both")
    most = max(1, max_segments if max_segments is not None else DEFAULT_MAX_SEGMENTS)
    units = numbered_units(docs, keys, order, text)
    per = F.lit(max(1, units_per_segment)) if units_per_segment is not None else F.ceil(F.col("__total") / most)
    rows = units.select(*keys, F.floor(F.col("__number") / per).alias("seg_idx"), F.struct("__number", "__unit").alias("u"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("u")), lambda u: u["__unit"]), " ")
    return rows.groupBy(*keys, "seg_idx").agg(joined.alias("segment"))
