"""Line deduplication with levelled sorted runs of line hashes (operator 8).

A line's key is the line without ASCII white space at its ends and with A-Z
lower-cased.  :class:`LineRuns` keeps how many documents hold each key, as sorted
runs in levels: every batch of documents is merge-anti-joined with all runs, the
keys that no run has become a run of level 0, and a level that is full is compacted
into one run of the next.  :func:`drop_repeated_lines` feeds a table through it and
removes the lines of every key that enough documents have.

Everything is DataFrame operations.  Lines travel as 128-bit hashes; the texts are
shuffled once, to meet their own list of dropped places.  Null and empty texts are
one empty line.  Empty keys are never dropped.  A document is a row: repeated rows
count once each, and all lose the same lines.  A document that loses all its lines
has the empty text.  Very long texts are split as a whole, as one row's array.  Extra
columns are kept; ``n_lines`` and ``n_dropped`` of the input are replaced.  An empty
table gives an empty result.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.common import WHITESPACE, ascii_lower, children, free_name, hash128, remove, scratched, shared_path, staged

KEY = ["a", "b"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITESPACE)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(text: Column, min_chars: int = 1) -> Column:
    """The 128-bit key hash of each line; null for keys under ``min_chars`` code points."""
    keys = F.transform(lines_of(text), line_key)
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, hash128(k)))


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Within the block scans of runs keep the order in which the runs were written, and unions
    promise no partitioning (the planner may take it away from bucketed scans afterwards and lose rows)."""
    wanted = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.unionOutputPartitioning": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class LineRuns:
    """Line keys as levelled sorted runs in a folder that all executors share.

    A run is a Parquet table (a, b, n) in hash buckets that are sorted by key, all
    runs in as many buckets, so runs are merged bucket by bucket without an exchange.
    A key is in one key run only: :meth:`add` merge-anti-joins a batch with all of
    them, what is left becomes a run of level 0, and how often the batch has the other
    keys becomes a tally run.  ``fanout`` runs of a level are compacted into one of the
    next.  Each step ends with a new manifest, so a folder can be opened again by a
    later batch or a restarted driver, which repeats at most the batch that was open.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, min_docs: int = 10, fanout: int = 3):
        if fanout < 2:
            raise ValueError("a level needs at least two runs")
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.folder = folder or shared_path(spark, "line-runs")
        manifests = [x for x in children(spark, self.folder) if x.startswith("manifest-") and "_SUCCESS" in children(spark, f"{self.folder}/{x}")]
        state = json.loads(spark.read.text(f"{self.folder}/{manifests[-1]}").first()[0]) if manifests else {}
        self.generation: int = len(manifests) and int(manifests[-1].split("-")[1])
        self.buckets: int = state.get("buckets", int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: dict[str, list[list[str]]] = state.get("levels", {"keys": [[]], "tallies": [[]]})
        self.batches: list[str] = state.get("batches", [])
        self.replaced: list[str] = []

    def runs(self, kind: str = "keys") -> list[DataFrame]:
        return [self._read(name) for level in self.levels[kind] for name in level]

    def _read(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} (a BIGINT, b BIGINT, n BIGINT) USING parquet CLUSTERED BY (a, b) SORTED BY (a, b) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame) -> str:
        name = f"quernel_lines_{uuid.uuid4().hex}"
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            rows = rows.repartition(self.buckets, *KEY)  # else a run's bucket would be dealt to several files
        rows.select("a", "b", "n").write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _commit(self) -> None:
        self.generation += 1
        state = json.dumps({"buckets": self.buckets, "levels": self.levels, "batches": self.batches})
        self.spark.range(1, numPartitions=1).select(F.lit(state)).write.text(f"{self.folder}/manifest-{self.generation:08d}")
        for name in self.replaced:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, f"{self.folder}/{name}")
        self.replaced = []

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` (with columns a and b) whose key is in no run yet."""
        return reduce(lambda left, run: left.join(run.select(*KEY).hint("merge"), KEY, "left_anti"), self.runs(), keys)

    def add(self, keys: DataFrame, batch: str | None = None, fresh: bool = False) -> DataFrame | None:
        """Add a batch, one row (a, b) for each document and distinct key in it, and return, if asked for ``fresh``
        ones, the keys that no earlier batch had.  A named batch that the folder has already is passed over."""
        if batch is not None and batch in self.batches:
            return self.spark.range(0).select(*[F.col("id").alias(c) for c in (*KEY, "n")])
        with _sorted_scans(self.spark):
            own = counted = self._write(keys.groupBy(*KEY).agg(F.count("*").alias("n")))
            if self.runs():
                own = self._write(self.unseen(self._read(counted)))
                again = self._read(counted).join(self._read(own).select(*KEY).hint("merge"), KEY, "left_anti")
                self.levels["tallies"][0].append(self._write(again))
                self.replaced.append(counted)
            self.levels["keys"][0].append(own)
            self.batches.append(batch or own)
            self._commit()
            new = staged(self._read(own), "line-fresh", kept=True) if fresh else None  # the run itself may be compacted away
            for kind in self.levels:
                self._compact(kind)
        return new

    def _compact(self, kind: str) -> None:
        """Merge the runs of every full level, two at a time, into one of the next; counts of a key add up."""
        levels = self.levels[kind]
        for level in itertools.count():
            if level == len(levels) or len(levels[level]) < self.fanout:
                break
            merged = levels[level][0]
            for name in levels[level][1:]:
                left, right = self._read(merged), self._read(name).withColumnRenamed("n", "more").hint("merge")
                both = left.join(right, KEY, "full").select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))
                self.replaced += [merged] if merged not in levels[level] else []
                merged = self._write(both)
            self.replaced += levels[level]
            levels[level] = []
            if level + 1 == len(levels):
                levels.append([])
            levels[level + 1].append(merged)
            self._commit()

    def repeated(self) -> DataFrame:
        """Keys (a, b) found in at least ``min_docs`` documents of all batches so far, as a table of its own."""
        with _sorted_scans(self.spark):
            parts = [run.where(F.col("n") >= self.min_docs).select(*KEY) for run in self.runs()]
            if tallies := self.runs("tallies"):
                summed = self._write(reduce(DataFrame.unionByName, tallies).groupBy(*KEY).agg(F.sum("n").alias("n")))
                more = self._read(summed).withColumnRenamed("n", "more").hint("merge")
                parts += [run.where(F.col("n") < self.min_docs).join(more, KEY).where(F.col("n") + F.col("more") >= self.min_docs).select(*KEY) for run in self.runs()]
                self.replaced.append(summed)
            none = self.spark.range(0).select(*[F.col("id").alias(c) for c in KEY])
            return staged(reduce(DataFrame.unionByName, parts, none), "line-repeated", kept=True)

    def delete(self) -> None:
        """Remove the folder with all runs."""
        for name in children(self.spark, self.folder):
            if name.startswith("quernel_lines_"):
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.folder)


@scratched
def drop_repeated_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """Remove all lines whose key is in at least ``min_docs`` documents.

    Returns the columns of ``docs`` with ``text`` replaced, and ``n_lines`` (before
    dropping) and ``n_dropped``; columns of ``docs`` with these names are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    body = F.col(f"`{text}`").cast("string")
    row = free_name(docs, "__row")
    identity = hash128(*[F.col(f"`{c}`").cast("string") for c in docs.columns if _hashable(docs, c)])
    keyed = docs.select(identity.alias("row"), line_hashes(body, min_chars).alias("lines"), F.pmod(F.xxhash64(body), F.lit(batches)).alias("batch"))
    keyed = staged(keyed, "line-keys", kept=True, by=["batch"])

    runs = LineRuns(spark, min_docs=min_docs)
    for batch in range(batches):
        own = keyed.where(F.col("batch") == batch)
        runs.add(own.select(F.explode(F.array_distinct(F.filter("lines", lambda x: x.isNotNull()))).alias("key")).select("key.a", "key.b"), str(batch))

    places = keyed.select("row", F.posexplode("lines").alias("pos", "key")).where(F.col("key").isNotNull()).select("row", "pos", "key.a", "key.b")
    repeated = runs.repeated()
    runs.delete()
    dropped = places.join(repeated, KEY).groupBy("row").agg(F.collect_set("pos").alias("dropped"))
    dropped = dropped.select(F.col("row.a").alias(f"{row}_a"), F.col("row.b").alias(f"{row}_b"), F.col("dropped").alias(f"{row}_dropped"))

    lines, gone = lines_of(body), F.col(f"{row}_dropped")
    left = F.array_except(F.sequence(F.lit(0), F.size(F.col(f"{row}_lines")) - 1), gone)
    kept = F.when(gone.isNull(), F.coalesce(body, F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col(f"{row}_lines"), i)), "\n"))
    joined = docs.withColumn(row, identity).withColumns({f"{row}_a": F.col(f"{row}.a"), f"{row}_b": F.col(f"{row}.b")}).drop(row)
    joined = joined.join(dropped, [f"{row}_a", f"{row}_b"], "left").withColumn(f"{row}_lines", lines)
    return joined.select(
        *[kept.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
        F.size(f"{row}_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
    )


def _hashable(df: DataFrame, column: str) -> bool:
    """Columns that tell rows apart: those that cast to text."""
    return df.schema[column].dataType.typeName() not in ("map", "array", "struct", "variant")
