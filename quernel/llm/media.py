"""Media columns over archives in a shared folder (operator 1).

:func:`write_media` stores one media file per row: the row's payload as an 8-bit
greyscale PNG of width :data:`WIDTH`, kept as a member of a ZIP archive, one
archive a task.  :class:`MediaArchiveSource` is a Spark data source that reads
such archives back.  Planning is by size alone: every archive is cut into byte
ranges, and a range owns the members whose offset lies in it, so the driver never
lists members.  A task reads the entries of its range from the index that lies beside the
archive (from the archive's directory where there is none), fetches each member by offset,
checks the CRC that the entry states, retries a failed, short or damaged read on its own
with a newly opened file, and passes the members on in Arrow batches of bounded size.

Null texts count as empty; an empty payload is one row of padding.  Ties and
repeated rows are separate members.  An empty table gives archives without
members, or none.  A null id stays null.  A very long text is one member, which a task
holds whole while it writes or reads it.  Only the id and the text are stored, so extra
columns may have any name; :func:`with_media_features` replaces columns named as its own.
"""

from __future__ import annotations

import binascii
import hashlib
import os
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple, TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quernel.llm.common import shared_path

R = TypeVar("R")

#: Samples in a row of the image; payloads are padded to a multiple of it.
WIDTH = 576
PAD = 255
#: Fixed values of the PNG format.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed layout of a ZIP member's local header: 30 bytes, then name and extra field.
LOCAL_HEADER = struct.Struct("<4s5H3I2H")

#: What a read cut short, of a member or of a directory, can raise besides errors of the file system.
READ_ERRORS = (OSError, EOFError, struct.error, zipfile.BadZipFile, pa.ArrowInvalid)

#: Entries in a row group of an archive's index.
INDEX_ROWS = 4096
BATCH_BYTES = 4 << 20
#: Byte ranges up to which more archives make more of them.
MOST_RANGES = 200_000
ATTEMPTS = 4


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", binascii.crc32(kind + data))


def padded(data: bytes, width: int = WIDTH) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of ``width``."""
    return data + bytes([PAD]) * (-len(data) % width or (0 if data else width))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """A greyscale PNG, 8 bits a sample, whose pixels are the payload's bytes."""
    height = len(payload) // width
    if height * width != len(payload) or not height:
        raise ValueError("the payload must be a positive multiple of the width")
    rows = np.zeros((height, width + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, width)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows, level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The pixels of a PNG that :func:`encode_png` wrote; other kinds are refused."""
    if media[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG")
    at, body, head = 8, [], b""
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != binascii.crc32(kind + data):
            raise ValueError(f"damaged chunk {kind!r}")
        head = data if kind == b"IHDR" else head
        body += [data] if kind == b"IDAT" else []
        at += 12 + n
    width, height, *form = struct.unpack(">IIBBBBB", head)
    if form != [8, 0, 0, 0, 0]:
        raise ValueError("only 8-bit greyscale without interlace is supported")
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are supported")
    return rows[:, 1:].tobytes()


def media_feature(payload: bytes) -> str:
    """Integer statistics of the samples around the mid level 128, so that every
    machine gets the same string: count, mean and mean square in thousandths,
    least, greatest, and crossings of the mid level."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256).astype(object)
    level = np.arange(256).astype(object) - 128
    n, above = len(x), x >= 128
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    mean, power = int((counts * level).sum()) * 1000 // n, int((counts * level * level).sum()) * 1000 // n
    return f"n={n};mean={mean};power={power};min={x.min()};max={x.max()};crossings={crossings}"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def write_media(docs: DataFrame, folder: str, id_column: str = "doc_id", text: str = "text", level: int = 1) -> str:
    """Store each row's text as a media member under ``folder`` (a URI that all
    executors share) and return the path of the manifest, one row an archive.

    Only archives of committed tasks are in the manifest, so a lost executor or a
    second attempt leaves nothing that a reader would see.
    """
    source = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text}`").cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        path, members = f"{base}/{uuid.uuid4().hex}.zip", 0
        entries = pa.schema([("offset", pa.int64()), ("size", pa.int64()), ("crc", pa.int64()), ("name", pa.string())])
        with fs.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            for batch in batches:
                for key, data in zip(batch.column(0), batch.column(1), strict=True):
                    name = f"{members}-{'' if key.as_py() is None else key.as_py()}.png"
                    archive.writestr(zipfile.ZipInfo(name), encode_png(padded(data.as_py() or b""), level=level))
                    members += 1
            with fs.open_output_stream(f"{path}.index") as out_index, pq.ParquetWriter(out_index, entries) as index:
                for at in range(0, members, INDEX_ROWS):
                    part = archive.filelist[at : at + INDEX_ROWS]
                    index.write_table(pa.table([[m.header_offset for m in part], [m.file_size for m in part], [m.CRC for m in part], [m.filename for m in part]], schema=entries))
        size = fs.get_file_info(path).size
        yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "members": [members]})

    manifest = f"{folder}/manifest"
    source.mapInArrow(run, "path string, bytes long, members long").write.parquet(manifest)
    return manifest


class Member(NamedTuple):
    """An archive's entry for one member."""

    offset: int
    size: int
    crc: int
    name: str


class ArchiveRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class MediaArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", 8 << 20))

    def partitions(self) -> list[ArchiveRange]:
        """Byte ranges of every archive that the manifest names."""
        fs, base = _open(f"{self.folder}/manifest")
        found = pq.read_table(base, filesystem=fs, columns=["path", "bytes", "members"]).to_pylist()
        # The driver holds an object a range, so ranges grow with the archives beyond MOST_RANGES of them.
        step = max(self.range_bytes, -(-sum(x["bytes"] for x in found) // MOST_RANGES))
        return [ArchiveRange(x["path"], at, at + step) for x in found if x["members"] for at in range(0, x["bytes"], step)] or [ArchiveRange("", 0, 0)]

    def read(self, partition: ArchiveRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = _open(self.folder)
        names, media, held = [], [], 0
        for member in self._members(fs, partition):
            names.append(member.name)
            media.append(self._fetch(fs, partition.path, member))
            held += len(media[-1])
            if held >= BATCH_BYTES:
                yield self._batch(names, media)
                names, media, held = [], [], 0
        if names:
            yield self._batch(names, media)

    @staticmethod
    def _batch(names: list[str], media: list[bytes]) -> pa.RecordBatch:
        keys = [int(k) if (k := n.split("-", 1)[1].removesuffix(".png")) else None for n in names]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names, pa.string()), pa.array(media, pa.binary())], names=["id", "member", "media"])

    @staticmethod
    def _retried(read: Callable[[], R]) -> R:
        """``read()``, again after a failed or short read."""
        for attempt in range(ATTEMPTS - 1):
            try:
                return read()
            except READ_ERRORS:
                time.sleep(0.1 * 2**attempt)
        return read()

    def _members(self, fs: pafs.FileSystem, partition: ArchiveRange) -> list[Member]:
        """The range's members in order of their offset."""

        def entries() -> list[Member]:
            if fs.get_file_info(f"{partition.path}.index").type == pafs.FileType.NotFound:
                with fs.open_input_file(partition.path) as f, zipfile.ZipFile(f) as archive:
                    found = [Member(m.header_offset, m.file_size, m.CRC, m.filename) for m in archive.infolist()]
                return sorted(m for m in found if partition.start <= m.offset < partition.end)
            with fs.open_input_file(f"{partition.path}.index") as f, pq.ParquetFile(f) as index:
                groups = []
                for g in range(index.num_row_groups):
                    offsets = index.metadata.row_group(g).column(0).statistics
                    if offsets.max >= partition.start and offsets.min < partition.end:
                        groups.append(g)
                rows = index.read_row_groups(groups).to_pylist()
            return [m for m in (Member(**r) for r in rows) if partition.start <= m.offset < partition.end]

        return self._retried(entries)

    def _fetch(self, fs: pafs.FileSystem, path: str, member: Member) -> bytes:
        """One member by its offset; a failed, short or damaged read is tried again by itself."""

        def body() -> bytes:
            try:
                f = self._handle(fs, path)
                head = LOCAL_HEADER.unpack(f.read_at(LOCAL_HEADER.size, member.offset))
                data = f.read_at(member.size, member.offset + LOCAL_HEADER.size + head[-2] + head[-1])
                if len(data) != member.size or binascii.crc32(data) != member.crc:
                    raise OSError(f"damaged member {member.name} of {path}")
                return data
            except READ_ERRORS:
                self._opened = None
                raise

        return self._retried(body)

    _opened: tuple[str, pa.NativeFile] | None = None

    def _handle(self, fs: pafs.FileSystem, path: str) -> pa.NativeFile:
        if self._opened is None or self._opened[0] != path:
            self._opened = (path, fs.open_input_file(path))
        return self._opened[1]


class MediaArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``: id, member, media."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "id long, member string, media binary"

    def reader(self, schema) -> MediaArchiveReader:
        return MediaArchiveReader(self.options)


def read_media(spark: SparkSession, folder: str, range_bytes: int = 8 << 20) -> DataFrame:
    spark.dataSource.register(MediaArchiveSource)
    return spark.read.format("media_archive").option("rangeBytes", range_bytes).load(folder)


def with_media_features(media: DataFrame, column: str = "media") -> DataFrame:
    """Decode a media column and add ``n_bytes`` (without padding),
    ``payload_bytes``, ``payload_sha256``, ``tail_crc32``, ``media_bytes``,
    ``media_sha256`` and ``feature``; the media column itself is dropped.

    The padding byte 255 never occurs in UTF-8, so the unpadded length needs no
    record of its own.
    """
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kept = [c for c in media.columns if c != column and c not in names]
    fields = ", ".join([*(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in kept), "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for cell in batch.column(batch.num_columns - 1):
                stored = cell.as_py()
                payload = decode_png(stored)
                rows.append((len(payload.rstrip(bytes([PAD]))), len(payload), hashlib.sha256(payload).hexdigest(), binascii.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), media_feature(payload)))
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*kept, *names])

    return media.select(*[f"`{c}`" for c in kept], f"`{column}`").mapInArrow(run, fields)


def media_columns(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every row's text as media in the shared folder, read it back and
    return ``id_column`` with the features; other columns are left out."""
    spark = docs.sparkSession
    folder = shared_path(spark, "media")
    write_media(docs, folder, id_column, text)
    found = with_media_features(read_media(spark, folder).select("id", "media"))
    return found.withColumnRenamed("id", id_column)
