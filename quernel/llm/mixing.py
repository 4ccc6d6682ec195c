"""Mixing sources to target weights by systematic sampling (operator 9).

Sources in code-point order (null last) get the weights in turn.  Together they
share ``share`` times the corpus, in words; no source gets more than ``most``
times its own size, and what it would have got beyond that is shared among the
others by weight.  Each document's expected number of copies is its source's
target over its source's size.  The copies are prefix-summed within the source,
one random offset is added, and the document is emitted once for each integer
boundary that its interval crosses.

Documents are laid out by size class within the source, so the words taken stay
close to the target.  The prefix sum has three levels, so that no task gets a
whole source: size classes within a source (a few hundred at most), slots of about
``SLOT_ROWS`` rows within a class, and rows within their slot.  Expected copies are
integers in units of 2**-24, so all sums are exact and reruns agree.  Words are
counted once: the rows are written with their size to the shared folder.  Only the
sources' sizes (a row a source) come to the driver, where the targets are shared out.
No step uses Python workers.

Null texts have size 0, very long texts are counted whole in one pass.  A source of
size 0 has target 0, a null source is one like any other.  Equal rows share a slot
and are numbered in any order, being alike.  Extra columns are kept; those named as
the result's are replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import NON_WHITESPACE_CLASS, free_name, scratched, staged

UNIT_BITS = 24
SLOT_ROWS = 256
#: Rows of the class plan up to which it is broadcast (under 8 MB); a larger one is joined by shuffle.
BROADCAST_ROWS = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{NON_WHITESPACE_CLASS}++")), F.lit(0)).cast("long")


def number_of(digits: Column) -> Column:
    """Hexadecimal digits as a number."""
    return F.conv(digits, 16, 10).cast("bigint")


def size_class(size: Column) -> Column:
    """Eight classes a doubling: the binary length of size + 1, and the three bits after its first."""
    bits = F.bin(size + 1)
    return (F.char_length(bits) * 8 + F.conv(F.rpad(F.substring(bits, 2, 3), 3, "0"), 2, 10).cast("int")).cast("int")


def shares(sizes: list[int], weights: list[int], total: Fraction, most: int) -> list[Fraction]:
    """Targets: ``total`` shared by weight, none above ``most`` times its size, and
    the excess shared again by weight among the rest until none is above."""
    out: dict[int, Fraction] = {}
    left = Fraction(total)
    while len(out) < len(sizes):
        open_ = [i for i in range(len(sizes)) if i not in out]
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] > most * sizes[i] * weight]
        for i in over or open_:
            out[i] = Fraction(most * sizes[i]) if over else left * weights[i] / weight
        left -= sum(out[i] for i in over)
    return [out[i] for i in range(len(sizes))]


def _targets(sized: DataFrame, names: dict[str, str], weights: tuple[int, ...], share: Fraction, most: int) -> DataFrame:
    """(source, source_size, target, expected) of every source: the one thing that is summed on the driver, a row a source."""
    rows = sized.groupBy(names["source"]).agg(F.sum(names["size"]).alias("words")).collect()
    rows = sorted(rows, key=lambda r: (r[0] == "", r[0].encode()))
    sizes = [r["words"] for r in rows]
    got = shares(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), most)
    expected = [int(t * (1 << UNIT_BITS)) // size if size else 0 for t, size in zip(got, sizes, strict=True)]
    columns = {"source": pa.array([r[0] for r in rows], pa.string()), "source_size": pa.array(sizes, pa.int64()), "target": pa.array(map(float, got), pa.float64()), "expected": pa.array(expected, pa.int64())}
    # As an Arrow table this becomes a relation inside the JVM; a list of rows would start Python workers on the executors.
    return sized.sparkSession.createDataFrame(pa.table({names[k]: v for k, v in columns.items()}))


def _class_plan(sized: DataFrame, names: dict[str, str], targets: DataFrame) -> DataFrame:
    """A row for each source and size class: its slots, the documents in classes before it, and its source's figures."""
    earlier = Window.partitionBy(names["source"]).orderBy(names["class"]).rowsBetween(Window.unboundedPreceding, -1)
    n = F.col(names["n"])
    classes = sized.groupBy(names["source"], names["class"]).agg(F.count("*").alias(names["n"]))
    placed = classes.withColumns({names["before"]: F.coalesce(F.sum(n).over(earlier), F.lit(0)), names["slots"]: F.ceil(n / SLOT_ROWS)})
    return staged(placed.drop(names["n"]).join(targets, names["source"]), "mix-classes", kept=True)


@scratched
def copies(docs: DataFrame, text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 17, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``, how often
    the mix emits the row; columns of ``docs`` with these names are replaced.
    ``keep`` names the columns of ``docs`` to return, all by default."""
    made = ["size", "source_size", "target", "copies"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    own = docs.columns if keep is None else list(keep)
    names = {k: free_name(docs, f"__{k}") for k in ("source", "class", "slots", "slot", "before", "expected", "source_size", "target", "size", "row", "k", "start", "n")}
    scalar = [F.col(f"`{c}`").cast("string") for c in docs.columns if docs.schema[c].dataType.typeName() not in ("map", "array", "struct", "variant")]
    name = F.col(f"`{source}`").cast("string")
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("+"), c), F.lit("-")) for c in scalar]))
    sized = docs.select(
        *[F.col(f"`{c}`") for c in own],
        F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), name)).alias(names["source"]),
        word_count(F.col(f"`{text}`").cast("string")).alias(names["size"]),
        row.alias(names["row"]),
    )
    sized = staged(sized.withColumn(names["class"], size_class(F.col(names["size"]))), "mix-sized", kept=True)
    plan = _class_plan(sized, names, _targets(sized, names, weights, share, most))
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan
    keys = [names["source"], names["class"]]
    placed = sized.join(plan, keys).withColumn(names["slot"], number_of(F.substring(names["row"], 1, 15)) % F.col(names["slots"]))

    counts = placed.groupBy(*keys, names["slot"]).agg(F.count("*").alias(names["n"]))
    earlier = Window.partitionBy(*keys).orderBy(names["slot"]).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, names["slot"], F.coalesce(F.sum(names["n"]).over(earlier), F.lit(0)).alias(names["start"]))

    inside = Window.partitionBy(*keys, names["slot"]).orderBy(names["size"], names["row"])
    numbered = placed.withColumn(names["k"], F.row_number().over(inside)).join(starts, [*keys, names["slot"]])
    offset = number_of(F.substring(F.md5(F.concat_ws("#", F.lit(str(seed)), F.col(names["source"]))), 1, UNIT_BITS // 4))
    upto = F.col(names["before"]) + F.col(names["start"]) + F.col(names["k"])
    boundary = lambda index: F.shiftright(offset + index * F.col(names["expected"]), UNIT_BITS)
    return numbered.select(
        *[F.col(f"`{c}`") for c in own],
        F.col(names["size"]).alias("size"),
        F.col(names["source_size"]).alias("source_size"),
        F.col(names["target"]).alias("target"),
        (boundary(upto) - boundary(upto - 1)).cast("int").alias("copies"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the sampling emits it."""
    drawn = copies(docs, **options)
    times = free_name(drawn, "__times")
    repeated = drawn.where(F.col("copies") > 0).withColumn(times, F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.drop(times, "copies", "size", "source_size", "target")
