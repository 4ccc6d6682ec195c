"""Results that outlive a run: a folder of committed batches, by the hash of what was asked.

A store is a folder that driver and executors share:

* ``batches/<id>`` holds the rows of one batch as Parquet, cut into buckets by the first two
  hexadecimal digits of the key;
* ``commits/<id>`` is a small file that is written when the batch is complete, and names the
  batches that it replaces.

A batch counts only with its commit, so readers never see half of one, a lost run loses at
most its open batch, and runs can append side by side.  Should two of them have stored one
key, the batch that sorts first is taken.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quernel.sources.scratch import files_in, read_text, remove, save_text, shared_path

BUCKETS = 256


def bucket_of(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 2), 16, 10).cast("int")


class BatchStore:
    """Rows of ``fields`` (a DDL string) under a hexadecimal ``key``, one a key."""

    def __init__(self, spark: SparkSession, folder: str, key: str, fields: str):
        self.spark, self.folder, self.key = spark, folder, key
        self.fields = [f.name for f in StructType.fromDDL(fields)]
        self.schema = f"{key} string, {fields}, bucket int"

    def batches(self) -> list[str]:
        """The batches that count, in order."""
        committed = [c for c in files_in(self.spark, f"{self.folder}/commits") if not c.startswith(".")]
        replaced = {old for c in committed for old in read_text(self.spark, f"{self.folder}/commits/{c}").split()}
        return [c for c in committed if c not in replaced]

    def append(self, rows: DataFrame, replacing: list[str] | None = None) -> str:
        """Store rows, one a key, as one batch; it counts once all of it is written."""
        batch = uuid.uuid4().hex
        kept = rows.select(self.key, *self.fields, bucket_of(F.col(self.key)).alias("bucket"))
        # By the next two digits as well: a bucket is some files, neither one task nor a file for every task.
        kept = kept.repartition("bucket", F.substring(self.key, 3, 2))
        kept.write.partitionBy("bucket").parquet(f"{self.folder}/batches/{batch}")
        save_text(self.spark, f"{self.folder}/commits/{batch}", "\n".join(replacing or []))
        return batch

    def buckets(self) -> dict[str, set[int]]:
        """The buckets that each batch that counts has rows in."""
        named = lambda batch: (n.partition("=") for n in files_in(self.spark, f"{self.folder}/batches/{batch}"))
        return {batch: {int(value) for name, _, value in named(batch) if name == "bucket" and value.isdigit()} for batch in self.batches()}

    def read(self) -> DataFrame:
        """(key, fields..., bucket), one row a key; only buckets that several batches have rows in are grouped for that."""
        held, rows = self.buckets(), None
        for batch in held:
            part = self.spark.read.schema(self.schema).parquet(f"{self.folder}/batches/{batch}").withColumn("batch", F.lit(batch))
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        times = Counter(b for own in held.values() for b in own)
        several = F.coalesce(F.col("bucket").isin([b for b, n in times.items() if n > 1]), F.lit(False))
        first = F.min_by(F.struct(*self.fields), "batch")
        alone = rows.where(~several).select(self.key, *self.fields, "bucket")
        if max(times.values(), default=0) < 2:
            return alone
        return alone.unionByName(rows.where(several).groupBy("bucket", self.key).agg(first.alias("r")).select(self.key, *[f"r.{f}" for f in self.fields], "bucket"))

    def compact(self) -> None:
        """All batches as one, sorted by key; the old ones stay until :meth:`clean`, for readers that hold them."""
        old = self.batches()
        if len(old) > 1:
            self.append(self.read().repartitionByRange(self.key).sortWithinPartitions(self.key), replacing=old)

    def clean(self) -> None:
        """Remove what no commit counts: replaced batches, and those of lost runs.  No run may be open meanwhile."""
        kept = set(self.batches())
        for batch in files_in(self.spark, f"{self.folder}/batches"):
            if batch not in kept:
                remove(self.spark, f"{self.folder}/batches/{batch}")
        for batch in kept:
            save_text(self.spark, f"{self.folder}/commits/{batch}", "")
        for commit in files_in(self.spark, f"{self.folder}/commits"):
            if commit not in kept:
                remove(self.spark, f"{self.folder}/commits/{commit}")


def in_batches(asked: DataFrame, store: BatchStore, answer: Callable[[DataFrame], DataFrame], batches: int = 4, calls: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Put ``answer`` to the rows of ``asked`` that ``store`` doesn't hold, and keep what it gives.

    ``asked``, or what ``calls`` makes of it, has the store's key, once each.  It is written once, then taken in ``batches``
    parts of the key space.  Each part looks up its own buckets only, asks for the rest in one job, and commits.
    """
    spark, key = store.spark, store.key
    path = shared_path(spark, "asked")
    asked.write.parquet(path)
    written = spark.read.schema(asked.schema).parquet(path)
    rows = (calls(written) if calls else written).withColumn("bucket", bucket_of(F.col(key)))
    step = -(-BUCKETS // max(1, batches))
    for low in range(0, BUCKETS, step):
        part = (F.col("bucket") >= low) & (F.col("bucket") < low + step)
        new = rows.where(part).drop("bucket")
        if any(low <= b < low + step for own in store.buckets().values() for b in own):
            new = new.join(store.read().where(part).select(key), key, "left_anti")
        if not new.isEmpty():
            store.append(answer(new))
    remove(spark, path)
