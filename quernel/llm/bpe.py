"""Byte-level BPE encoding and decoding with a public vocabulary (operator 6).

Each pre-token is merged with a priority queue of merge ranks over a doubly
linked list of symbols: the lowest rank, then the leftmost place, is merged
first, and queue entries whose pair has changed meanwhile are skipped.  Decoding
concatenates the vocabulary's byte strings.

Null texts count as empty: no ids, and the hashes of empty byte strings.  Special
token strings inside a text become their special ids, as the public library does
by default; vocabularies whose special tokens strip or normalise around themselves are
refused.  Rows are handled independently, so ties, repeated rows and an empty table
need no rule beyond that.  A very long text is encoded whole, and a pre-token of n
bytes takes n log n steps.  Extra columns are kept; those named as the result's are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in printable else chr(spare))
        spare += b not in printable
    return out


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class BytePairCodec:
    """Encoder and decoder for one vocabulary.  ``cached`` bounds the memory of
    pre-tokens: the cache is emptied when it holds that many."""

    def __init__(self, vocabulary: bytes, cached: int = 1 << 18):
        spec = json.loads(vocabulary)
        ids, symbols = spec["model"]["vocab"], byte_symbols()
        self.byte_id = [ids[s] for s in symbols]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {ids[a] << 24 | ids[b]: (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        back = {s: b for b, s in enumerate(symbols)}
        self.strings: dict[int, bytes] = {i: bytes(back[c] for c in s) for s, i in ids.items() if all(c in back for c in s)}
        if any(t.get(flag) for t in spec["added_tokens"] for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("special tokens that take in white space or need word bounds are not supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings.update({i: s.encode() for s, i in self.special.items()})
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.cached = cached
        codec = self

        class Known(dict):
            def __missing__(self, token: str) -> bytes:
                packed = pack(codec.merge(token.encode()))
                if len(token) <= 64:
                    if len(self) >= codec.cached:
                        self.clear()
                    self[token] = packed
                return packed

        self.known = Known()

    def merge(self, token: bytes) -> list[int]:
        """The ids of one pre-token."""
        n = len(token)
        symbol = [self.byte_id[b] for b in token]
        if n < 2:
            return symbol
        get, push, pop = self.merges.get, heapq.heappush, heapq.heappop
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at, made_at, queue = [-1] * n, [0] * n, []
        for i in range(n - 1):
            hit = get(symbol[i] << 24 | symbol[i + 1])
            if hit:
                rank_at[i], made_at[i] = hit
                queue.append(hit[0] << 40 | i)
        heapq.heapify(queue)
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFFFF
            if rank_at[i] != entry >> 40:
                continue  # stale: the pair that starts here has changed
            j = after[i]
            symbol[i] = made_at[i]
            after[i] = k = after[j]
            rank_at[j] = -1
            symbol[j] = -1
            if k < n:
                before[k] = i
                hit = get(symbol[i] << 24 | symbol[k])
                if hit:
                    rank_at[i], made_at[i] = hit
                    push(queue, hit[0] << 40 | i)
                else:
                    rank_at[i] = -1
            else:
                rank_at[i] = -1
            h = before[i]
            if h >= 0:
                hit = get(symbol[h] << 24 | symbol[i])
                if hit:
                    rank_at[h], made_at[h] = hit
                    push(queue, hit[0] << 40 | h)
                else:
                    rank_at[h] = -1
        return [s for s in symbol if s >= 0]

    def encode_packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.split_special is None or not self.split_special.search(text):
            return b"".join(map(self.known.__getitem__, self.pattern.findall(text)))
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += map(self.known.__getitem__, self.pattern.findall(text[at : m.start()]))
            out.append(self.special[m[0]].to_bytes(4, "little"))
            at = m.end()
        out += map(self.known.__getitem__, self.pattern.findall(text[at:]))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    def decode_packed(self, packed: bytes) -> bytes:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, BytePairCodec] = {}


def codec_for(vocabulary: bytes) -> BytePairCodec:
    """The codec of this worker process for a vocabulary, built once."""
    key = hashlib.sha256(vocabulary).hexdigest()
    if key not in _codecs:
        _codecs[key] = BytePairCodec(vocabulary)
    return _codecs[key]


def bpe_encode(docs: DataFrame, vocabulary_path: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode and decode every whole ``text`` of ``docs``.

    Keeps the other columns and adds ``n_tokens``, ``ids`` (binary, little-endian
    unsigned 32-bit; only with ``keep_ids``), ``ids_sha256`` and
    ``decoded_sha256``; columns of ``docs`` with these names are replaced.  The
    vocabulary (2 MB, of fixed size) is read on the driver and sent once to each
    executor.
    """
    with open(vocabulary_path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    made = ["n_tokens", *["ids"] * keep_ids, "ids_sha256", "decoded_sha256"]
    kept = [c for c in docs.columns if c != text and c.lower() not in made]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    kinds = {"n_tokens": T.LongType(), "ids": T.BinaryType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, kinds[c]) for c in made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(vocabulary.value)
        for batch in batches:
            step = 256
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                columns = {c: [] for c in made}
                for value in part.column(part.num_columns - 1):
                    packed = codec.encode_packed(value.as_py() or "")
                    columns["n_tokens"].append(len(packed) // 4)
                    if keep_ids:
                        columns["ids"].append(packed)
                    columns["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                    decoded = codec.decode_packed(packed).decode("utf-8", "replace").encode()
                    columns["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                types = {"n_tokens": pa.int64(), "ids": pa.binary(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(columns[c], types[c]) for c in made]], names=[*kept, *made])

    return source.mapInArrow(run, schema)
