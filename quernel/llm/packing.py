"""Best-fit packing of token sequences (operator 13).

Documents are tokenised, ended by an end token, and cut only where they are longer
than a sequence.  Which pieces share a sequence depends on their lengths alone, so the
plan is made on a histogram: how many pieces there are of each length, at most
``capacity`` rows however large the corpus is.  :func:`reduce_by_dominance` first fixes
bins after Martello and Toth: with the longest piece ``L``, a set ``F`` of at most two
others is final if it dominates every feasible set beside ``L``, that is, if the members
of any such set can be replaced, group by group, by members of ``F`` that are at least as
long.  A fixed set is taken as often as its members allow in one step, for the condition
can only get easier as pieces go.  What no set dominates is packed by best fit,
longest first.

Pieces then find their place without being collected: a piece's rank among the pieces of
its length is the count of those in earlier tasks plus its number in its own task, and a
table of runs (length, ranks from, sequences from, offset), bounded by the histogram,
gives sequence and offset.

Null texts count as empty and are the end token alone.  Ties (equal lengths) are ordered
by task and place there; any order gives as many sequences.  Rows with equal or null ids
are separate documents.  A very long text is tokenised whole in one task and cut into
full sequences and a rest.  An empty table gives no pieces.  Only the id and the text
are used, so extra columns may have any name.
"""

from __future__ import annotations

import binascii
import hashlib
import re
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from quernel.llm.bpe import byte_symbols, pack
from quernel.llm.common import scratched, staged

CAPACITY = 2048
END = 0

#: Texts with other characters, or with a special token's start, go through the library as a whole.
UNUSUAL = re.compile(r"[^\t-\r -~\xA0-ſ]|<\|")
#: Fixed value: the vocabulary's pre-token pattern, spelled out for the characters that pass UNUSUAL, lower-cased.
PATTERN = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zA-ZªµºÀ-ÖØ-öø-ſ]+|[0-9²³¹¼½¾]|[^\s0-9²³¹¼½¾a-zA-ZªµºÀ-ÖØ-öø-ſ]+")


class WordCodec:
    """Ids of whole texts for one vocabulary that drops white space and keeps words apart.

    Such a vocabulary gives a piece between white space the same ids wherever it stands, so
    pieces are remembered.  Two generations of at most ``cached`` pieces bound the memory.
    """

    def __init__(self, vocabulary: str, cached: int = 1 << 17):
        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        model, symbols = self.library.model, byte_symbols()
        older: dict[str, bytes] = {}

        class Known(dict):
            def __missing__(self, piece: str) -> bytes:
                nonlocal older
                packed = older.get(piece)
                if packed is None:
                    ids: list[int] = []
                    for word in PATTERN.findall(piece):
                        ids += [t.id for t in model.tokenize(word if word.isascii() else "".join(symbols[b] for b in word.encode()))]
                    packed = array("I", ids).tobytes() if pack([1])[0] == 1 else pack(ids)
                if len(piece) <= 64:
                    if len(self) >= cached:
                        older = dict(self)
                        self.clear()
                    self[piece] = packed
                return packed

        self.known = Known()

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if UNUSUAL.search(text):
            return pack(self.library.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.known.__getitem__, text.lower().split()))


_codecs: dict[str, WordCodec] = {}


def codec_for(vocabulary: str) -> WordCodec:
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = WordCodec(vocabulary)
    return _codecs[key]


def token_pieces(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], task, nth) of every piece.

    ``nth`` numbers the pieces of one length within the task that made them.  It holds only
    for one evaluation: write the table before using it twice.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())  # a few MB, of fixed size
    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.spark_partition_id().alias("task"), F.col(f"`{text}`").cast("string").alias("text"))
    key = source.schema["id"].dataType
    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, "task", "nth"]
    kinds = {"id": key, "piece": T.IntegerType(), "start": T.LongType(), "length": T.LongType(), "ids_crc32": T.LongType(), "ids": T.BinaryType(), "task": T.IntegerType(), "nth": T.LongType()}
    closing = pack([end])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, seen = codec_for(vocabulary.value), [0] * (capacity + 1)
        types = [to_arrow_type(kinds[n]) for n in names]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                columns: list[list] = [[] for _ in names]
                add = [c.append for c in columns]
                for key, task, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    packed = codec.encode_packed(value or "") + closing
                    total = len(packed) // 4
                    for piece, start in enumerate(range(0, total, capacity)):
                        ids = packed[4 * start : 4 * (start + capacity)]
                        length = len(ids) // 4
                        row = (key, piece, start, length, binascii.crc32(ids), *[ids] * keep_ids, task, seen[length])
                        for put, v in zip(add, row, strict=True):
                            put(v)
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return source.mapInArrow(run, T.StructType([T.StructField(n, kinds[n]) for n in names]))


#: A bin's content, and how many bins have it: lengths with their number, longest first.
Pattern = tuple[tuple[int, int], ...]


def _pattern(lengths: list[int]) -> Pattern:
    return tuple(sorted(Counter(lengths).items(), reverse=True))


def _dominating(length: int, counts: list[int], present: list[int], capacity: int) -> list[int] | None:
    """Partners that, with a piece of this length, dominate all feasible sets that hold it; None if none of at most two do.

    ``present`` lists the lengths with pieces, ascending.
    """
    room = capacity - length

    def free(x: int, *taken: int) -> int:
        return counts[x] - (x == length) - taken.count(x)

    def longest(most: int, *taken: int) -> int:
        for x in reversed(present[: bisect_right(present, most)]):
            if free(x, *taken) > 0:
                return x
        return 0

    def two_shortest(above: int) -> list[int]:
        found: list[int] = []
        for x in present[bisect_right(present, above) :]:
            found += [x] * min(2, free(x))
            if len(found) >= 2:
                break
        return found[:2]

    best = longest(room)
    if not best:
        return []
    shortest = two_shortest(0)
    if len(shortest) < 2 or sum(shortest) > room or best == room:
        return [best]  # nothing, or nothing longer, fits beside it; or it fills the bin
    third = _three_shortest(counts, present, length)
    if third is not None and third <= room:
        return None  # three others can fit: sets of two don't dominate all of these
    if best >= _longest_pair(counts, present, length, room):
        return [best]
    second = longest(room - best, best)
    # Every feasible pair has a member no longer than the second one, unless the two shortest beyond it fit.
    if second and (len(beyond := two_shortest(second)) < 2 or sum(beyond) > room):
        return [best, second]
    return None


def _three_shortest(counts: list[int], present: list[int], length: int) -> int | None:
    total, left = 0, 3
    for x in present:
        n = min(left, counts[x] - (x == length))
        total, left = total + n * x, left - n
        if not left:
            return total
    return None


def _longest_pair(counts: list[int], present: list[int], length: int, room: int) -> int:
    """The greatest sum of two other pieces that fit together; 0 if none do."""
    others = [x for x in present[: bisect_right(present, room)] for _ in range(min(2, counts[x] - (x == length)))]
    low, high, most = 0, len(others) - 1, 0
    while low < high:
        both = others[low] + others[high]
        if both > room:
            high -= 1
        else:
            low, most = low + 1, max(most, both)
    return most


def reduce_by_dominance(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[Counter[Pattern], dict[int, int]]:
    """Bins that some best packing has, and the histogram of what remains.

    A best packing of the remainder, together with these bins, is a best packing of all.
    """
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    present = [x for x in range(1, capacity + 1) if counts[x]]
    fixed: Counter[Pattern] = Counter()
    changed = True
    while changed:
        changed = False
        for length in present[::-1]:
            while counts[length]:
                partners = _dominating(length, counts, present, capacity)
                if partners is None:
                    break
                need = Counter([length, *partners])
                times = min(counts[x] // n for x, n in need.items())
                fixed[_pattern([length, *partners])] += times
                changed = True
                for x, n in need.items():
                    counts[x] -= n * times
                    if not counts[x]:
                        present.remove(x)
    return fixed, {x: counts[x] for x in present}


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> Counter[Pattern]:
    """Longest first, each piece to the fullest bin that has room; equal bins are filled in one step."""
    open_: dict[int, Counter[Pattern]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if n:
            if room not in open_:
                open_[room] = Counter()
                insort(rooms, room)
            open_[room][pattern] += n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, pattern, bins = capacity, (), left
            else:
                room = rooms[at]
                pattern, bins = open_[room].popitem()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            # The fullest bin stays the fullest while it has room for another one.
            each = room // length
            full = min(bins, left // each)
            put(room - each * length, (*pattern, (length, each)), full)
            left, bins = left - full * each, bins - full
            if left and bins:
                put(room - left * length, (*pattern, (length, left)), 1)
                left, bins = 0, bins - 1
            if pattern:
                put(room, pattern, bins)
    return sum(open_.values(), Counter())


def lower_bound(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """Sequences that no packing can do without, after Martello and Toth: for each threshold, pieces too
    long to share with the threshold stand alone, and the room of the middle ones must take the rest."""
    most = -(-sum(x * n for x, n in histogram.items()) // capacity)
    for least in range(1, capacity // 2 + 1):
        alone = sum(n for x, n in histogram.items() if x > capacity - least)
        middle = {x: n for x, n in histogram.items() if capacity / 2 < x <= capacity - least}
        small = sum(x * n for x, n in histogram.items() if least <= x <= capacity / 2)
        room = sum((capacity - x) * n for x, n in middle.items())
        most = max(most, alone + sum(middle.values()) + max(0, -(-(small - room) // capacity)))
    return most


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> Counter[Pattern]:
    fixed, rest = reduce_by_dominance(histogram, capacity)
    return fixed + best_fit(rest, capacity)


def runs_of(bins: Counter[Pattern]) -> dict[int, np.ndarray]:
    """For each length its runs, by rank: (first rank, pieces a sequence, first sequence, offset)."""
    ranks: Counter[int] = Counter()
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for pattern, copies in sorted(bins.items(), reverse=True):
        offset = 0
        for length, each in pattern:
            runs.setdefault(length, []).append((ranks[length], each, sequence, offset))
            ranks[length] += each * copies
            offset += each * length
        sequence += copies
    return {length: np.array(r, np.int64) for length, r in runs.items()}


def _placed(ranked: DataFrame, runs: dict[int, np.ndarray]) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``length`` and ``rank``, which is dropped."""
    table = ranked.sparkSession.sparkContext.broadcast(runs)
    kept = [c for c in ranked.columns if c != "rank"]
    schema = T.StructType([*(ranked.schema[c] for c in kept), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                own, of = lengths == length, table.value[int(length)]
                first, each, base, start = of[np.searchsorted(of[:, 0], ranks[own], "right") - 1].T
                nth = ranks[own] - first
                sequence[own], offset[own] = base + nth // each, start + nth % each * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.select(*kept, "rank").mapInArrow(run, schema)


@scratched
def pack_documents(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, keep_ids: bool = True) -> DataFrame:
    """Every piece with its sequence and its offset there: (``id_column``, piece, start, length, ids_crc32[, ids], sequence_id, offset)."""
    pieces = staged(token_pieces(docs, vocabulary_path, id_column, text, capacity, end, keep_ids), "pieces", kept=True)
    in_task = staged(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths", kept=True)
    histogram = {r["length"]: r["n"] for r in in_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = in_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = pieces.join(earlier, ["task", "length"]).withColumn("rank", F.col("earlier") + F.col("nth")).drop("task", "nth", "earlier")
    placed = _placed(ranked.select("id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, "rank"), runs_of(plan_bins(histogram, capacity)))
    return placed.withColumnRenamed("id", id_column)
