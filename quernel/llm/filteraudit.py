"""Filter interaction audit (operator 12).

Which of several filters a document fails is a bit mask, and all that an audit of any
order of the filters asks for follows from how many documents of a part have each mask.
The subset-zeta transform sums these counts over the subsets of every mask, one pass a
filter; the documents that survive a set of filters are those whose mask is a subset of
the other filters.  A step of an order is then the difference between two neighbouring
sets, for documents as for labelled ones.  The corpus is read once and only counts by
(part, mask, labels) are grouped, with partial sums before the shuffle.

Null texts count as empty, null parts as the empty string.  A document with a null id has
no smaller copy, is none for others, and has no labels.  Of rows with one id and one text
none is smaller than the other; each row counts.  Labels that name an id more than once
hold if any row does; labels of unknown ids are left out.  Very long texts are cut into
words whole, inside the row.  An empty table gives no rows.  Only the named columns are
used, so extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.core import let
from quernel.llm.common import UPPER, WHITESPACE_CLASS

#: Filters up to which all orders are listed: 720 of six.
MOST_LISTED = 6


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{WHITESPACE_CLASS}+", -1), lambda w: w != "")


def quality_failures(text: Column, min_words: int = 200, distinct_percent: int = 50, upper_percent: int = 3, signs: str = r"[#$%&*|]") -> Column:
    """An array of booleans: too few words, too few distinct ones, too many capitals, a sign."""
    capitals = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))

    def of(found: Column) -> Column:
        n = F.size(found)
        return F.array(
            n < min_words,
            F.size(F.array_distinct(found)) * 100 < n * distinct_percent,
            capitals * 100 > F.char_length(text) * upper_percent,
            text.rlike(signs),
        )

    return let(words(text), of)


def failure_masks(docs: DataFrame, labels: DataFrame, good: Column, toxic: Column, id_column: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): how many documents fail which of the four filters of :func:`quality_failures` (bits 0
    to 3) and of ``identical to a smaller id's text`` (bit 4), and carry the labels.

    Rows are told apart by 256 bits of their text.  No key is hot: copies are counted before they move, and the
    least id of a text joins the one row that has it.
    """
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), whole.alias("whole"))
    bits = let(quality_failures(F.col("whole")), lambda f: sum((F.when(f[i], 1 << i).otherwise(0) for i in range(4)), F.lit(0)))
    # In lambdas a new name hides a column of the same name, so none is used twice.
    rows = rows.select("id", "part", F.unhex(F.sha2("whole", 256)).alias("text"), bits.alias("mask"))
    rows = rows.groupBy("id", "part", "text", "mask").agg(F.count("*").alias("n"))
    least = rows.where(F.col("id").isNotNull()).groupBy("text").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marked = rows.join(least, ["text", "id"], "left")
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    marked = marked.select("id", "part", "n", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))
    # Null ids match no label; they are dealt by what else they have, not all to one task.
    marked = marked.groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    marked = marked.withColumn("deal", F.when(F.col("id").isNull(), F.xxhash64("part", "mask", "n")).otherwise(F.lit(0)))
    known = labels.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(good, F.lit(False)).alias("good"), F.coalesce(toxic, F.lit(False)).alias("toxic"))
    known = known.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).withColumn("deal", F.lit(0).cast("bigint"))
    both = marked.join(known, ["id", "deal"], "left")
    return both.groupBy("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.sum("n").alias("n"))


def subset_zeta(counts: Column, bits: int) -> Column:
    """For every mask the sum of ``counts`` over its subsets, by one pass a bit."""

    def one(values: Column, bit: int) -> Column:
        has = lambda m: m.bitwiseAND(F.lit(1 << bit)) != 0
        return let(values, lambda v: F.transform(v, lambda x, m: x + F.when(has(m), F.get(v, m - (1 << bit))).otherwise(0)))

    for bit in range(bits):
        counts = one(counts, bit)
    return counts


def audit_orders(masks: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per part, order of the filters and step, from rows (part, mask, good, toxic, n).

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): documents left
    after the step, removed by it, failing its filter but removed earlier, failing no other filter; labelled ones
    removed by it; and what its filter removes, summed over all orders.
    """
    k = len(names)
    if k > MOST_LISTED:
        raise ValueError(f"all orders of more than {MOST_LISTED} filters are too many rows")
    everything = (1 << k) - 1

    def by_mask(chosen: Column, name: str) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(chosen & (F.col("mask") == m), F.col("n"))), F.lit(0)) for m in range(1 << k)]).alias(name)

    kinds = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counted = masks.groupBy("part").agg(*[by_mask(c, f"n_{name}") for name, c in kinds.items()])
    summed = counted.select("part", F.col("n_all").alias("exact"), *[subset_zeta(F.col(f"n_{name}"), k).alias(name) for name in kinds])

    def survivors(kind: str, of: Column) -> Column:
        """Documents that pass all filters of a set."""
        return F.get(F.col(kind), F.lit(everything).bitwiseXOR(of))

    # Before filter f each set of s others comes in s! (k - 1 - s)! orders.
    shapley = []
    for f in range(k):
        terms = [(survivors("all", F.lit(t)) - survivors("all", F.lit(t | 1 << f))) * (factorial(t.bit_count()) * factorial(k - 1 - t.bit_count())) for t in range(1 << k) if not t >> f & 1]
        shapley.append(sum(terms[1:], terms[0]))
    steps = [("".join(names[f] for f in order), i + 1, f, sum(1 << g for g in order[:i])) for order in permutations(range(k)) for i, f in enumerate(order)]
    listed = F.explode(F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(f).alias("f"), F.lit(t).alias("before")) for o, s, f, t in steps]))
    rows = summed.withColumn("shapleys", F.array(*shapley)).select("*", listed.alias("at")).select("*", "at.*")
    bit = F.element_at(F.array(*[F.lit(1 << f) for f in range(k)]), F.col("f") + 1)
    after = F.col("before").bitwiseOR(bit)
    lost = lambda kind: survivors(kind, F.col("before")) - survivors(kind, after)
    failing = survivors("all", F.lit(0)) - survivors("all", bit)
    return rows.select(
        "part", "filter_order", "step", survivors("all", after).alias("kept"), lost("all").alias("removed"), (failing - lost("all")).alias("redundant"),
        F.get("exact", bit).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shapleys", F.col("f")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, good: Column, toxic: Column, id_column: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The audit of the five filters A to E (:func:`failure_masks`) in all 120 orders, for each part."""
    return audit_orders(failure_masks(docs, labels, good, toxic, id_column, text, part), "ABCDE")
