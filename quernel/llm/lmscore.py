"""Cross-entropy difference of two matched n-gram models (operator 5).

A target model (texts that are wanted) and a background model (all texts) share
one vocabulary, the 256 bytes, one order and one smoothing, so their per-token
losses can be compared; a document's score is the mean of target loss minus
background loss, and lower means more like the target.

Counts of byte n-grams up to order 4 are exact and keyed by the n-gram itself, so the
models grow with the corpus and are never whole in one place.  Documents are dealt to
blocks of about ``BLOCK`` bytes by hash of the id.  A block counts its distinct
n-grams, these counts are summed over all blocks by n-gram in a shuffle, and the sums
go back to the blocks that have the n-gram, so that a task holds no more n-grams than
its block has.  Probabilities back off with a Dirichlet prior:
p(w|c) = (n(cw) + k p'(w|c')) / (n(c) + k), where n(c) counts the tokens that follow the
context, at the start of a document too, so that the probabilities after any context add
up to 1.  A document's own counts are taken out of a model that was counted over it, so that
no document is scored by what it brought along.

Null and empty texts have no token and the score 0.  An empty target gives the
uniform distribution for the target.  Repeated rows, as ties, get equal scores.  Rows with
the same id share a block; rows with a null id are dealt by their text and are in no
target.  A very long text is one row of a block and is counted piece by piece, with no
n-gram lost between pieces.  An empty table gives an empty result.  Only the id and the
text are read, so extra columns may have any name; the id's name is kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = 4
SIZES = (1 << 8, 1 << 16)
#: Places in a table of all n-grams of orders 1 and 2.
STARTS = np.concatenate([[0], np.cumsum(SIZES)])
PRIOR = 20.0
CHUNK = 1 << 22
#: Bytes of text in a block of documents, about.
BLOCK = 1 << 22
START = b"\n" * (ORDER - 1)


def _slots(key: np.ndarray, order: int) -> np.ndarray:
    """The n-grams of an order packed as the low bytes of ``key``."""
    return (key & np.uint32((1 << 8 * order) - 1)).astype(np.int64)


def _grams(key: np.ndarray, order: int) -> np.ndarray:
    """The same, distinct over all orders; 0 is no n-gram and stands for the number of tokens."""
    return _slots(key, order) | order << 32


def _contexts(key: np.ndarray, length: int) -> np.ndarray:
    """What comes before the last byte of ``key``, so many bytes of it; told apart from n-grams, which may end a document."""
    return _slots(key >> np.uint32(8), length) | ORDER + length << 32


def _packed(data: bytes) -> np.ndarray:
    """For each byte after the first ORDER - 1 the last ORDER bytes as one integer."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    n = len(b) - ORDER + 1
    return b[:n] << np.uint32(24) | b[1 : n + 1] << np.uint32(16) | b[2 : n + 2] << np.uint32(8) | b[3 : n + 3]


def _pieces(text: bytes) -> Iterator[np.ndarray]:
    data = START + text
    for at in range(0, len(text), CHUNK):
        yield _packed(data[at : at + CHUNK + ORDER - 1])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their summed counts."""
    if len(parts) == 1:
        return parts[0]
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, back, np.concatenate([n for _, n in parts]))
    return keys, n


def _tally(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the highest order in order, and how often they occur."""
    found, held, size = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))], [], 0
    for text in texts:
        for keys in _pieces(text):
            held.append(keys)
            size += len(keys)
            if size >= CHUNK:
                found = [_summed([*found, np.unique(np.concatenate(held), return_counts=True)])]
                held, size = [], 0
    return _summed([*found, np.unique(np.concatenate(held), return_counts=True)]) if held else found[0]


def _texts(part: pa.Table) -> tuple[list[int | None], list[bytes | None], list[bool]]:
    """Ids, texts and membership in the target of a block's documents."""
    ids, texts, marks = (part.column(c).to_pylist() for c in ("id", "text", "mark"))
    known = {i for i, m in zip(ids, marks, strict=True) if m}
    rows = [r for r, m in enumerate(marks) if not m]
    return [ids[r] for r in rows], [texts[r] for r in rows], [ids[r] in known for r in rows]


def _count_block(part: pa.Table) -> pa.Table:
    """(block, gram, target, n): the block's n-grams of all orders, their contexts, and its tokens."""
    _, texts, inside = _texts(part)
    halves = [_tally(t for t, x in zip(texts, inside, strict=True) if t and x == side) for side in (True, False)]
    keys, n = (np.concatenate(x) for x in zip(*halves, strict=True))
    target = np.concatenate([halves[0][1], np.zeros_like(halves[1][1])])
    tokens = np.zeros(1, np.int64)
    grams, back = np.unique(np.concatenate([*(_grams(keys, k) for k in range(1, ORDER + 1)), *(_contexts(keys, k) for k in range(1, ORDER)), tokens]), return_inverse=True)
    sums = []
    for x in (target, n):
        sums.append(np.zeros(len(grams), np.int64))
        np.add.at(sums[-1], back, np.concatenate([*[x] * (2 * ORDER - 1), [x.sum()]]))
    block = part.column("block")[0].as_py()
    return pa.table({"block": pa.array(np.full(len(grams), block), pa.int32()), "gram": pa.array(grams), "target": pa.array(sums[0]), "n": pa.array(sums[1])})


class NgramModel:
    """Counts of n-grams in order; without ``grams`` those of all n-grams of orders 1 and 2."""

    def __init__(self, counts: np.ndarray, grams: np.ndarray | None = None, tokens: int | None = None):
        self.grams = np.concatenate([np.arange(n) | k + 1 << 32 for k, n in enumerate(SIZES)]) if grams is None else grams
        self.counts = np.append(counts, 0)
        self.tokens = int(counts[: SIZES[0]].sum()) if tokens is None else tokens

    def losses(self, slots: list[np.ndarray], contexts: list[np.ndarray], own: list, own_contexts: list, own_tokens: int) -> np.ndarray:
        """Loss in nats of each distinct n-gram, without the ``own`` counts as far as the model has them."""
        without = lambda at, own: (n := self.counts[at]) - np.minimum(own, n)
        p = (without(slots[0], own[0]) + 1) / (self.tokens - min(own_tokens, self.tokens) + SIZES[0])
        for k in range(1, ORDER):
            p = (without(slots[k], own[k]) + PRIOR * p) / (without(contexts[k], own_contexts[k]) + PRIOR)
        return -np.log(p)


def _places(grams: np.ndarray, keys: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Places of n-grams and their contexts of all orders; what isn't there is one place after the end."""

    def place(wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(grams, wanted)
        return np.where(np.append(grams, -1)[at] == wanted, at, len(grams))

    return [place(_grams(keys, k + 1)) for k in range(ORDER)], [np.zeros(0, np.int64), *[place(_contexts(keys, k)) for k in range(1, ORDER)]]


class _Scratch:
    """What the documents of a block share: places of its n-grams, and an array for a document's own counts."""

    def __init__(self):
        self.grams = None

    def places(self, grams: np.ndarray, keys: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        if self.grams is not grams:
            self.grams, self.table = grams, np.zeros(len(grams) + 1, np.int64)
            first, end = np.searchsorted(grams, [ORDER << 32, ORDER + 1 << 32])
            self.longest = (grams[first:end] & 0xFFFFFFFF).astype(np.uint32)
            self.all = _places(grams, self.longest)
        at = np.searchsorted(self.longest, keys)
        if len(at) and (at[-1] == len(self.longest) or (self.longest[at] != keys).any()):
            return _places(grams, keys)
        return tuple([x[at] if len(x) else x for x in part] for part in self.all)

    def counted(self, slots: list[np.ndarray], contexts: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        places = [*slots, *contexts[1:]]
        for at in places:
            np.add.at(self.table, at, n)
        own, own_contexts = [self.table[at] for at in slots], [self.table[at] if len(at) else at for at in contexts]
        for at in places:
            self.table[at] = 0
        return own, own_contexts


def document_losses(text: bytes, target: NgramModel, background: NgramModel, scratch: _Scratch, inside: bool = False) -> tuple[int, float, float]:
    """Tokens, mean target loss (without own counts if ``inside`` the target), mean background loss without own counts."""
    keys, n = _tally([text])
    total = len(text)
    slots, contexts = scratch.places(background.grams, keys)
    own, own_contexts = scratch.counted(slots, contexts, n)
    nothing = [0] * ORDER
    by_target = target.losses(slots, contexts, own, own_contexts, total) if inside else target.losses(slots, contexts, nothing, nothing, 0)
    by_all = background.losses(slots, contexts, own, own_contexts, total)
    return total, float((by_target * n).sum() / total), float((by_all * n).sum() / total)


def _score_block(part: pa.Table, counts: pa.Table) -> pa.Table:
    counts = counts.sort_by("gram")
    grams, target, n = (counts.column(c).to_numpy() for c in ("gram", "target", "n"))  # the first is the number of tokens
    models = [NgramModel(x[1:], grams[1:], int(x[0])) for x in (target, n)]
    scratch = _Scratch()
    ids, texts, inside = _texts(part)
    rows = [document_losses(t, *models, scratch, x) if t else (0, 0.0, 0.0) for t, x in zip(texts, inside, strict=True)]
    values = [ids, inside, *([r[i] for r in rows] for i in range(3))]
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64())
    return pa.table([pa.array(v, kind) for v, kind in zip(values, kinds, strict=True)], names=["id", "in_target", "n_tokens", "ce_target", "ce_background"])


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, wanted: Column, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Score all of ``docs`` by a target model of the rows that ``labels`` marks as ``wanted``:
    (id, in_target, n_tokens, ce_target, ce_background, score) of every row."""
    key = F.col(f"`{id_column}`").cast("long")
    body = docs.select(key.alias("id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    size = body.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    place = F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id"))
    block = F.pmod(place, F.lit(-(-size // BLOCK) or 1)).cast("int").alias("block")
    marks = labels.where(wanted).select(key.alias("id"), F.lit(None).cast("binary").alias("text")).where("id IS NOT NULL")
    parts = body.select(block, "id", "text", F.lit(False).alias("mark")).unionByName(marks.dropDuplicates(["id"]).select(block, "id", "text", F.lit(True).alias("mark")))
    found = parts.groupBy("block").applyInArrow(_count_block, "block int, gram long, target long, n long")
    everywhere = Window.partitionBy("gram")
    counts = found.select("block", "gram", F.sum("target").over(everywhere).alias("target"), F.sum("n").over(everywhere).alias("n"))
    scored = parts.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_score_block, "id long, in_target boolean, n_tokens long, ce_target double, ce_background double")
    return scored.select(F.col("id").alias(id_column), "in_target", "n_tokens", "ce_target", "ce_background", (F.col("ce_target") - F.col("ce_background")).alias("score"))
