"""Document sources: literals, files, several sources in order, one corpus.

Every source gives ``(origin, text)``; ``kind_ord`` and ``arg_ord`` keep the order
in which sources were named: literals, then files, then pages.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence
from functools import reduce
from html.parser import HTMLParser
from itertools import islice

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf, pandas_udf

from quernel.errors import BadInput
from quernel.functions.text import HIDDEN_TAGS, collapse_lines, content_kind, decode_utf8, is_blank, normalize_newlines, strip, suffix_kind
from quernel.sources.scratch import file_system

SCHEMA = "origin string, text string, kind_ord int, arg_ord long"


class _Visible(HTMLParser):
    """Text nodes outside hidden elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.nodes = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN_TAGS

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in HIDDEN_TAGS))

    def handle_data(self, data):
        if not self.hidden and not data.isspace():
            self.nodes.append(data.strip())


def visible_text(html: str) -> str:
    """The text nodes of a page that a reader would see, one a line."""
    page = _Visible()
    page.feed(html)
    page.close()
    return "\n".join(n for n in page.nodes if n)


#: Pages that are Python strings at a time; a batch of thousands stays in Arrow.
PAGES_AT_ONCE = 64


def _visible_text(html: pa.Array) -> pa.Array:
    part = lambda at: [None if h is None else visible_text(h) for h in html.slice(at, PAGES_AT_ONCE).to_pylist()]
    return pa.concat_arrays([pa.array(part(at), pa.string()) for at in range(0, len(html), PAGES_AT_ONCE)] or [pa.array([], pa.string())])


def _pdf_pages(content: pd.Series) -> pd.Series:
    try:
        from pypdf import PdfReader
    except ImportError as error:
        raise BadInput("reading PDF needs the optional package pypdf") from error

    def pages(data: bytes) -> str:
        return "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)

    return content.map(lambda d: None if d is None else pages(d))


def html_to_text(html: Column) -> Column:
    """Visible text by the parser, which knows nesting and every character reference."""
    return collapse_lines(arrow_udf(_visible_text, "string")(html))


def pdf_to_text(content: Column) -> Column:
    return collapse_lines(pandas_udf(_pdf_pages, "string")(content))


def _as_text(found: DataFrame, kind: str) -> DataFrame:
    """``text`` from ``content`` that is all of one kind."""
    body = decode_utf8(F.col("content"))
    return found.withColumn("text", {"text": lambda: normalize_newlines(body), "html": lambda: html_to_text(body), "pdf": lambda: pdf_to_text(F.col("content"))}[kind]())


def _by_kind(found: DataFrame) -> DataFrame:
    """``text`` from ``content`` by ``kind``; the parsers' plans are only part of it where a row needs them."""
    return reduce(DataFrame.unionByName, [_as_text(found.where(F.col("kind") == kind), kind) for kind in ("text", "html", "pdf")])


def literals(spark: SparkSession, texts: Sequence[str]) -> DataFrame:
    """Literal texts, stripped, without blank ones."""
    rows = spark.createDataFrame([("text", t, 0, i) for i, t in enumerate(texts)], SCHEMA)
    return rows.withColumn("text", strip(F.col("text"))).where("text <> ''")


def files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Text, HTML and PDF files, told apart by their suffix, in the order in which they are named."""
    full = []
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(target) or not fs.getFileStatus(target).isFile():
            raise BadInput(f"{path}: {'not a file' if fs.exists(target) else 'there is no such file'}")
        full.append(_bare(fs.makeQualified(target).toString()))
    places = spark.createDataFrame([(p, i) for i, p in enumerate(full)], "place string, arg_ord long")
    return _read_files(spark, list(dict.fromkeys(full)), places)


#: A task reads about so many bytes, of so many files at most; contents leave it in batches of so many bytes.
TASK_BYTES, TASK_FILES, BATCH_BYTES = 32 << 20, 10_000, 4 << 20
#: Names of a listing in a batch.
NAMES_AT_ONCE = 10_000
WILD = re.compile(r"[*?\[{\\]")


def files_under(spark: SparkSession, pattern: str) -> DataFrame:
    """All files that a pattern such as ``folder/*.html`` matches, however many, without an order of their own.

    The driver holds no names: tasks list folders, one a folder, and names are dealt to the tasks that read them.
    Only a store that Arrow can't open is left to Spark's own reader, whose driver holds a record a file.
    """
    steps = _steps(spark, pattern)
    if not all(_opens(root) for root, _ in steps):
        try:
            return _read_files(spark, [pattern], None)
        except AnalysisException as error:
            raise BadInput(f"{pattern}: no file matches") from error
    found = []
    for root, names in steps:
        listed = _listed(spark, root, names)
        for kind, n, size in listed.groupBy("kind").agg(F.count("size"), F.sum("size")).collect():
            tasks = max(spark.sparkContext.defaultParallelism, (size or 0) // TASK_BYTES, n // TASK_FILES)
            rows = listed.where((F.col("kind") == kind) & F.col("size").isNotNull()).select("path").repartition(tasks)
            found.append(_as_text(rows.mapInArrow(_reader(root), "path string, content binary"), kind))
    if not found:
        raise BadInput(f"{pattern}: no file matches")
    return reduce(DataFrame.unionByName, found).select(F.col("path").alias("origin"), "text", F.lit(1).alias("kind_ord"), F.lit(0).cast("long").alias("arg_ord"))


def _steps(spark: SparkSession, pattern: str) -> list[tuple[str, list[str]]]:
    """A pattern, by its alternatives that span folders: the folder before its first wildcard, and every name from there as a regular expression."""
    glob, out = spark.sparkContext._jvm.org.apache.hadoop.fs, []
    for one in glob.GlobExpander.expand(pattern):
        names = one.split("/")
        n = next((i for i, name in enumerate(names) if WILD.search(name)), len(names))
        fs, target = file_system(spark, "/".join(names[:n]) + "/" if n else ".")
        out.append((_bare(fs.makeQualified(target).toString()), [glob.GlobPattern(name).compiled().pattern() for name in names[n:] if name]))
    return out


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and path for a qualified folder, whose name need not be escaped if it is local."""
    return (pafs.LocalFileSystem(), folder.removeprefix("file:")) if folder.startswith("file:/") else pafs.FileSystem.from_uri(folder)


def _opens(root: str) -> bool:
    """Whether Arrow reaches a folder; a local one that isn't there is no other store's."""
    try:
        fs, base = _store(root)
        return root.startswith("file:/") or root.endswith(base) and fs.get_file_info(base).type != pafs.FileType.NotFound
    except (OSError, ValueError, NotImplementedError):
        return False


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _listed(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """(path, size, kind) of all that matches: files, those of a folder that matches, and without a size what has nothing to read itself."""

    def matching(fs: pafs.FileSystem, place: str, name: str | None) -> list[pafs.FileInfo]:
        if name is None:
            return [x for x in [fs.get_file_info(place)] if x.type != pafs.FileType.NotFound]
        try:
            return [x for x in fs.get_file_info(pafs.FileSelector(place, allow_not_found=True)) if re.fullmatch(name, x.base_name, re.DOTALL)]
        except NotADirectoryError:
            return []

    def opened(fs: pafs.FileSystem, x: pafs.FileInfo) -> Iterator[tuple[str, int | None]]:
        if x.is_file:
            yield x.path, None if _hidden(x.base_name) else x.size
            return
        yield x.path, None
        for own in fs.get_file_info(pafs.FileSelector(x.path)):
            if not _hidden(own.base_name) and (own.is_file or "=" in own.base_name):
                yield from opened(fs, own)

    def step(name: str | None, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, base = _store(root)
            prefix = root.removesuffix(base)
            places = (path.removeprefix(prefix) for batch in batches for path in batch["path"].to_pylist())
            hits = (x for place in places for x in matching(fs, place, name))
            rows = (row for x in hits for row in opened(fs, x)) if last else ((x.path, None) for x in hits if not x.is_file)
            while part := list(islice(rows, NAMES_AT_ONCE)):
                yield pa.RecordBatch.from_pydict({"path": pa.array([prefix + path for path, _ in part], pa.string()), "size": pa.array([size for _, size in part], pa.int64())})

        return run

    found = spark.createDataFrame([(root,)], "path string")
    for i, name in enumerate(names or [None]):
        dealt = found.repartition(spark.sparkContext.defaultParallelism) if i else found.coalesce(1)
        found = dealt.select("path").mapInArrow(step(name, i + 1 >= len(names)), "path string, size long")
    return found.withColumn("kind", suffix_kind(F.col("path")))


def _reader(root: str):
    """Paths to paths and contents, a bounded number of bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _store(root)
        prefix, paths, bodies, size = root.removesuffix(base), [], [], 0
        for path in (path for batch in batches for path in batch["path"].to_pylist()):
            with fs.open_input_stream(path.removeprefix(prefix), compression=None) as file:
                bodies.append(file.read())
            paths.append(path)
            size += len(bodies[-1])
            if size >= BATCH_BYTES or len(paths) >= TASK_FILES:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(bodies, pa.binary())], ["path", "content"])
                paths, bodies, size = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(bodies, pa.binary())], ["path", "content"])

    return run


def _bare(path: str) -> str:
    """A qualified path in one spelling: Spark writes ``file:///x`` where Hadoop writes ``file:/x``."""
    return re.sub("^file:/+", "file:/", path)


def _read_files(spark: SparkSession, paths: list[str], places: DataFrame | None) -> DataFrame:
    """Files by Spark's own reader; its driver holds a record a file, so it is for the ones that are named."""
    found = spark.read.format("binaryFile").load(paths).withColumn("place", F.regexp_replace("path", "^file:/+", "file:/"))
    found = found.join(F.broadcast(places), "place") if places is not None else found.withColumn("arg_ord", F.lit(0).cast("long"))
    rows = found.select(F.col("path").alias("origin"), "content", suffix_kind(F.col("path")).alias("kind"), "arg_ord")
    return _by_kind(rows).select("origin", "text", F.lit(1).alias("kind_ord"), "arg_ord")


def write_files(rows: DataFrame, folder: str, name: str = "name", text: str = "text") -> int:
    """Write each row's text as the file ``name`` in a folder that all executors share; returns how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
        fs.create_dir(base, recursive=True)
        made: set[str] = set()
        for batch in batches:
            slices = (batch.slice(at, PAGES_AT_ONCE) for at in range(0, batch.num_rows, PAGES_AT_ONCE))
            for own, body in (pair for part in slices for pair in zip(*(c.to_pylist() for c in part.columns), strict=True)):
                if "/" in own and (inner := own.rsplit("/", 1)[0]) not in made:
                    fs.create_dir(f"{base}/{inner}", recursive=True)
                    made.add(inner)
                with fs.open_output_stream(f"{base}/{own}") as out:  # a second attempt writes the same file
                    out.write((body or "").encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return rows.select(name, F.col(text).cast("string")).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def fetched(pages: DataFrame) -> DataFrame:
    """Text of fetched pages (origin, content, content_type, arg_ord), told apart by content type."""
    rows = pages.withColumn("kind", content_kind(F.col("content_type")))
    return _by_kind(rows).select("origin", "text", F.lit(2).alias("kind_ord"), "arg_ord")


def with_text(docs: DataFrame, strict: bool = False) -> DataFrame:
    """Stripped documents that have text; ``strict`` fails on the first that has none, naming it."""
    stripped = docs.withColumn("text", strip(F.col("text")))
    blank = is_blank(F.col("text"))
    if strict:
        message = F.concat(F.lit("no text in "), F.coalesce("origin", F.lit("a source")))
        return stripped.withColumn("text", F.when(blank, F.raise_error(message).cast("string")).otherwise(F.col("text")))
    return stripped.where(~blank)


def union_in_order(*sources: DataFrame) -> DataFrame:
    """All sources in the order of their kinds and, within a kind, in which they were named."""
    if not sources:
        raise BadInput("at least one text, file or page is needed")
    return reduce(DataFrame.unionByName, sources).orderBy("kind_ord", "arg_ord")


def corpus(docs: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("kind_ord", "arg_ord"), text: str = "text") -> DataFrame:
    """Each group's texts as one, joined by blank lines in the given order.

    A group becomes one string, so groups must be of bounded size (a request, a
    conversation), not a source of a web corpus.
    """
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t"))))
    joined = F.array_join(F.transform(rows, lambda r: r["__t"]), "\n\n")
    return docs.groupBy(*keys).agg(joined.alias("corpus"), F.count("*").alias("n_sources"))
