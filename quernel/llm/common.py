"""Helpers that the operators share: the cluster's shared folder and row keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: space, tab, LF, VT, FF, CR.
WHITESPACE = " \t\n\x0b\f\r"
WHITESPACE_CLASS = r"[\x20\x09-\x0D]"
NON_WHITESPACE_CLASS = r"[^\x20\x09-\x0D]"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is missing (local tests) a temporary folder of this
    machine is taken and set for the running context.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(folder)
        return folder.rstrip("/")
    if not sc.getCheckpointDir():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quernel-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/quernel-{label}-{uuid.uuid4().hex}"


#: Paths to remove at the end of each open :func:`scratch`, innermost last; operators in other threads have their own.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def staged(df: DataFrame, label: str, kept: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts
    the lineage and survives the loss of any executor.

    The innermost open :func:`scratch` removes the table at its end; with ``kept``,
    for what a lazy result still reads, only the one around it does.  ``by`` names
    columns that cut the table into folders.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.partitionBy(*by).parquet(path)
    open_ = _scratch.get()[:-1] if kept else _scratch.get()
    if open_:
        open_[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove what :func:`staged` wrote meanwhile from the shared folder."""
    paths: list[str] = []
    before = _scratch.set((*_scratch.get(), paths))
    try:
        yield
    finally:
        _scratch.reset(before)
        for path in paths:
            remove(spark, path)


def scratched(operator: Callable) -> Callable:
    """An operator, a function of a DataFrame first, within a :func:`scratch` of its own."""

    @wraps(operator)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        with scratch(df.sparkSession):
            return operator(df, *args, **options)

    return run


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder with the file system that owns it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it isn't there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(target)) if fs.exists(target) else []


def dealt(rows: DataFrame) -> DataFrame:
    """A table that is read in fewer tasks than there are cores, as a single row group is, dealt to all of them; others as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.rdd().getNumPartitions() < cores else rows


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def hash128(*cols: Column) -> Column:
    """A struct of two independently seeded 64-bit hashes; nulls are hashed by their place."""
    filled = [x for c in cols for x in (c.isNull(), c)]
    return F.struct(F.xxhash64(F.lit(1), *filled).alias("a"), F.xxhash64(F.lit(2), *filled).alias("b"))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    name, taken = base, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
