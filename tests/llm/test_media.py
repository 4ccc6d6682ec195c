import binascii
import hashlib
import zlib

import pyarrow.parquet as pq
import pytest

from quernel.llm import media
from quernel.llm.common import shared_path


def png(payload):
    """A greyscale PNG of width 576 by its format: unfiltered rows in one compressed chunk."""
    part = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + binascii.crc32(kind + data).to_bytes(4, "big")
    rows = b"".join(b"\0" + payload[i : i + 576] for i in range(0, len(payload), 576))
    head = (576).to_bytes(4, "big") + (len(payload) // 576).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows, 1)) + part(b"IEND", b"")


def feature(payload):
    x = [b - 128 for b in payload]
    crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:], strict=False))
    return f"n={len(x)};mean={sum(x) * 1000 // len(x)};power={sum(v * v for v in x) * 1000 // len(x)};min={min(payload)};max={max(payload)};crossings={crossings}"


def brute(text):
    data = (text or "").encode()
    payload = data + b"\xff" * (-len(data) % 576 if data else 576)
    stored = png(payload)
    return (len(data), len(payload), hashlib.sha256(payload).hexdigest(), binascii.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload))


def test_rows_and_edges(odd_docs, odd_rows, no_docs):
    got = media.media_columns(odd_docs)
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted([(r[0], *brute(r[1])) for r in odd_rows], key=str)
    assert got.columns == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    assert media.media_columns(no_docs).count() == 0


def test_png_round_trip():
    for n in (1, 5):
        payload = bytes(range(256)) * 9 * n
        assert media.decode_png(media.encode_png(payload)) == payload
    with pytest.raises(ValueError):
        media.encode_png(b"123")
    broken = bytearray(media.encode_png(bytes(576)))
    broken[50] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(broken))


def test_many_bytes_do_not_make_more_ranges(spark, odd_docs, monkeypatch):
    folder = shared_path(spark, "steps")
    media.write_media(odd_docs, folder)
    monkeypatch.setattr(media, "MOST_RANGES", 5)
    assert len(media.MediaArchiveReader({"path": folder, "rangebytes": 10}).partitions()) <= 5 + 3


def test_ranges_cover_members_once(spark, odd_docs):
    folder = shared_path(spark, "ranges")
    media.write_media(odd_docs, folder)
    whole = sorted(r["member"] + str(r["id"]) for r in media.read_media(spark, folder).collect())
    cut = media.read_media(spark, folder, range_bytes=300)
    assert sorted(r["member"] + str(r["id"]) for r in cut.collect()) == whole
    assert cut.rdd.getNumPartitions() > 10


def test_a_failed_member_is_read_again_alone(spark, odd_docs, monkeypatch):
    folder = shared_path(spark, "retry")
    manifest = media.write_media(odd_docs, folder)
    reader = media.MediaArchiveReader({"path": folder})
    fails, handle = [2], media.MediaArchiveReader._handle

    def flaky(self, fs, path):
        if fails[0]:
            fails[0] -= 1
            raise OSError("gone")
        return handle(self, fs, path)

    monkeypatch.setattr(media.MediaArchiveReader, "_handle", flaky)
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    got = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert got == odd_docs.count() and fails == [0]
    path = next(x["path"] for x in pq.read_table(manifest.removeprefix("file:")).to_pylist() if x["members"])
    with open(path, "r+b") as f:
        f.seek(60)
        f.write(b"\x00\x01\x02")
    with pytest.raises(OSError, match="damaged"):
        [b for p in reader.partitions() for b in reader.read(p)]


@pytest.mark.parametrize("short", ["header", "body", "index", "directory"])
def test_short_reads_are_tried_again(spark, odd_docs, monkeypatch, short):
    """A read that returns less than was asked for, in every place where bytes are read."""
    import os

    folder = shared_path(spark, f"short-{short}")
    manifest = media.write_media(odd_docs, folder)
    paths = [x["path"] for x in pq.read_table(manifest.removeprefix("file:")).to_pylist() if x["members"]]
    if short == "directory":
        for path in paths:
            os.remove(f"{path}.index")
    cuts = {"header": 1, "body": 1, "index": 1, "directory": 1}

    class Short:
        """A file whose next read of one kind is cut."""

        def __init__(self, f):
            self.f = f

        def read_at(self, n, at):
            kind = "header" if n == media.LOCAL_HEADER.size else "body"
            data = self.f.read_at(n, at)
            if kind == short and cuts[kind]:
                cuts[kind] -= 1
                return data[: len(data) // 2]
            return data

    def opened(self, fs, path):
        return Short(fs.open_input_file(path))

    monkeypatch.setattr(media.MediaArchiveReader, "_handle", opened)
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    if short in ("index", "directory"):
        whole = {p: open(p if short == "directory" else f"{p}.index", "rb").read() for p in paths}
        for p in paths:
            with open(p if short == "directory" else f"{p}.index", "wb") as f:
                f.write(whole[p][: len(whole[p]) // 2])

        def heal(s):
            for p in paths:
                with open(p if short == "directory" else f"{p}.index", "wb") as f:
                    f.write(whole[p])

        monkeypatch.setattr(media.time, "sleep", heal)
        cuts[short] = 0
    reader = media.MediaArchiveReader({"path": folder, "rangebytes": 5000})
    got = [m for p in reader.partitions() for b in reader.read(p) for m in b.column("media").to_pylist()]
    assert len(got) == odd_docs.count() and cuts[short] == 0
    for m in got:
        media.decode_png(m)


def test_a_range_reads_its_own_entries(spark, monkeypatch):
    monkeypatch.setattr(media, "INDEX_ROWS", 3)
    folder = shared_path(spark, "entries")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string").coalesce(1)
    media.write_media(docs, folder)  # the writer's workers keep the module's own number of rows
    reader = media.MediaArchiveReader({"path": folder, "rangebytes": 2000})
    fs, _ = media._open(folder)
    parts = [p for p in reader.partitions() if p.path]
    found = [reader._members(fs, p) for p in parts]
    assert len(parts) > 3 and sorted(m.name for part in found for m in part) == sorted(f"{i}-{i}.png" for i in range(40))
    assert all(p.start <= m.offset < p.end for p, part in zip(parts, found, strict=True) for m in part)
