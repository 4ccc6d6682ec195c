"""Exact top-k inner-product search without random access (operator 3).

Each dimension of a block of candidates is a sorted list, read from its high end
for queries with a positive component there and from its low end for the others.
All lists are read on in steps, to the same depth.  After a step every candidate has
a lower bound (what it has not shown yet counts as the list's worst value) and an
upper bound (as the value reached last).  A query stops when the candidates whose
upper bound reaches its k-th lower bound are few; what the lists hold beyond that
stays unread, and only these few candidates get their final scores.  The bounds of a
block of queries are matrix products over what was read, and all sums are exact
integers.

Candidates are cut into blocks of bounded size by the signs of their leading
components, so that similar vectors share a block.  A query is first searched in the
block of its own signs, which gives it a lower bound of its k-th score.  The ends of a
block's lists bound all scores in it: a query goes on only to blocks whose bound
reaches its own, and there reading stops against the bound that it brings along.
Neither side is ever whole in one place; a block hands on at most k rows a query.

Vectors that are null, or hold null or non-finite components, or have no id, take
no part.  Shorter vectors count as padded with zeros; very long ones are a row's array.
Ties go to the smaller id.  Rows with the same id are all candidates for other ids,
none for their own, and repeated rows are dealt to several blocks like any others;
equal query rows answer once.  Scores beyond 64 bits are cut to the range of long.
Extra columns are ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import scratch, staged

CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 4096
#: Block summaries that are compared with a block of queries at once.
SUMMARY_BLOCK = 1024
#: Queries whose bounds are held at once.
STRIP = 256
#: Share of each list that is read by the end of each step; from the half on each step halves the rest.
DEPTHS = (0.25, 0.5, 0.625, 0.75, 0.875, 0.9375, 0.96875, 1.0)
#: A query stops when no more than so many candidates, by k, can still qualify.
FEW = 8
EXACT = float(1 << 53)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of doubles as a matrix, padded with zeros."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(flat.offsets.to_numpy())
    values = flat.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths]) if len(lengths) else []] = values
    return out


def _widest(column: pa.ChunkedArray) -> int:
    return max((len(x) for x in column), default=0)


class SortedLists:
    """The sorted lists of a block's dimensions and what has been read of them so far, from either end."""

    def __init__(self, candidates: np.ndarray):
        self.rows = np.argsort(candidates, axis=0, kind="stable")
        self.values = np.take_along_axis(candidates, self.rows, axis=0)
        self.low, self.high = self.values[0], self.values[-1]
        self.depth = 0
        # What a query may assume of a component, by the end it reads from: most and least.
        self.top = [np.tile(self.high, (len(candidates), 1)), np.tile(self.low, (len(candidates), 1))]
        self.bottom = [np.tile(self.low, (len(candidates), 1)), np.tile(self.high, (len(candidates), 1))]
        self.unread = [np.ones(candidates.shape, bool), np.ones(candidates.shape, bool)]

    def read(self, depth: int) -> None:
        """Read on to ``depth`` entries from each end of every list."""
        n = len(self.rows)
        for own, unread, part, last in ((self.top, self.unread[0], slice(n - depth, n - self.depth), n - depth), (self.bottom, self.unread[1], slice(self.depth, depth), depth - 1)):
            rows, values = self.rows[part], self.values[part]
            for known in own:
                np.put_along_axis(known, rows, values, axis=0)
            np.put_along_axis(unread, rows, False, axis=0)
            np.copyto(own[0], self.values[last], where=unread)
        self.depth = depth

    def bounds(self, positive: np.ndarray, negative: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds of all scores of the queries, given as their positive and negative parts."""
        return positive @ self.top[0].T + negative @ self.bottom[0].T, positive @ self.top[1].T + negative @ self.bottom[1].T


def search_block(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each query the rows of its k best candidates, their scores, and the share of the lists that it read.

    ``least`` are lower bounds of the queries' k-th scores from elsewhere; candidates below them may be left out.
    """
    m, n = len(queries), len(candidates)
    out: list = [(np.zeros(0, int), np.zeros(0), 0.0)] * m
    if n == 0 or m == 0:
        return out
    bound = np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0) * queries.shape[1]
    if not bound < EXACT:
        return [(*_resolve_big(q, candidates, ids, np.flatnonzero(ids != i), k), 1.0) for q, i in zip(queries, query_ids, strict=True)]
    least = np.full(m, -np.inf) if least is None else least
    lists = SortedLists(candidates)
    waiting = np.arange(m)
    for depth in DEPTHS:
        lists.read(max(lists.depth, 1, int(n * depth)))
        still = []
        for strip in np.split(waiting, range(STRIP, len(waiting), STRIP)):
            own = ids[None, :] == query_ids[strip, None]
            upper, lower = lists.bounds(np.maximum(queries[strip], 0), np.minimum(queries[strip], 0))
            lower[own] = -np.inf
            kth = np.partition(lower, n - k, axis=1)[:, n - k] if n >= k else np.full(len(strip), -np.inf)
            possible = (upper >= np.maximum(kth, least[strip])[:, None]) & ~own
            done = (possible.sum(axis=1) <= FEW * k) | (lists.depth == n)
            for at in np.flatnonzero(done):
                i, rows = strip[at], np.flatnonzero(possible[at])
                scores = candidates[rows] @ queries[i]
                best = np.lexsort((ids[rows], -scores))[:k]
                out[i] = (rows[best], scores[best], lists.depth / n)
            still.append(strip[~done])
        waiting = np.concatenate(still)
        if not len(waiting):
            break
    return out


def _resolve_big(query: np.ndarray, candidates: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores too large for exact doubles, with integers of any size."""
    q = [int(x) for x in query]
    scores = [min(max(sum(a * int(b) for a, b in zip(q, candidates[r], strict=True)), -(1 << 63)), (1 << 63) - 1) for r in rows]
    best = sorted(range(len(rows)), key=lambda i: (-scores[i], ids[rows[i]]))[:k]
    return rows[best] if best else np.zeros(0, int), np.array([scores[i] for i in best], dtype=object)


def _answers(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """(query_id, tag, vec_id, score): the best of a block for each query; ``least`` of the queries may be null."""
    query_ids, ids = queries.column("id").to_numpy(), candidates.column("id").to_numpy()
    width = max(_widest(queries.column("v")), _widest(candidates.column("v")))
    least = np.array([-np.inf if x is None else x for x in queries.column("least").to_pylist()], float)
    found = search_block(_matrix(queries.column("v"), width), query_ids, _matrix(candidates.column("v"), width), ids, k, least)
    sizes = [len(r) for r, *_ in found]
    picked = np.concatenate([np.zeros(0, int), *(r for r, *_ in found)]).astype(int)
    scores = [int(s) for _, own, _ in found for s in own]
    return pa.table(
        {
            "query_id": pa.array(np.repeat(query_ids, sizes), pa.int64()),
            "tag": pa.array(np.repeat(queries.column("tag").to_numpy(), sizes), pa.int64()),
            "vec_id": pa.array(ids[picked], pa.int64()),
            "score": pa.array(scores, pa.int64()),
        }
    )


ANSWER = "query_id long, tag long, vec_id long, score long"
ENDS = "block long, high array<double>, low array<double>"


def _ends(part: pa.Table) -> pa.Table:
    """The ends of the lists of each block in a table of (block, high, low)."""
    block = part.column("block").to_numpy()
    width = _widest(part.column("high"))
    high, low = (_matrix(part.column(c), width) for c in ("high", "low"))
    order = np.argsort(block, kind="stable")
    blocks, starts = np.unique(block[order], return_index=True)
    top, bottom = np.maximum.reduceat(high[order], starts), np.minimum.reduceat(low[order], starts)
    return pa.table({"block": pa.array(blocks, pa.int64()), "high": pa.array(list(top), pa.list_(pa.float64())), "low": pa.array(list(bottom), pa.list_(pa.float64()))})


def block_ends(blocked: DataFrame) -> DataFrame:
    """(block, high, low): the ends of every block's lists, combined within tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                t = pa.table({"block": batch.column(0), "high": batch.column(1), "low": batch.column(1)})
                yield from _ends(t).to_batches()

    return blocked.select("block", "v").mapInArrow(run, ENDS).groupBy("block").applyInArrow(_ends, ENDS)


def _within_reach(queries: pa.Table, ends: pa.Table) -> pa.Table:
    """(block, qb, id, tag, least, v): the queries for each block in which one of its scores could reach ``least``."""
    width = max(_widest(queries.column("v")), _widest(ends.column("high")))
    q, high, low = _matrix(queries.column("v"), width), _matrix(ends.column("high"), width), _matrix(ends.column("low"), width)
    least = np.array([-np.inf if x is None else x for x in queries.column("least").to_pylist()], float)
    home, blocks = queries.column("home").to_numpy(), ends.column("block").to_numpy()
    with np.errstate(all="ignore"):
        most = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T)
        short = most + slack < least[:, None]
    which, block = np.nonzero(~short & (home[:, None] != blocks[None, :]))
    sent = queries.select(["qb", "id", "tag", "least", "v"]).take(pa.array(which))
    return sent.add_column(0, "block", pa.array(blocks[block], pa.int64()))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Each query row's ``k`` best other rows: query_id, rank, vec_id, score.

    Components become floor(scale * x).  ``is_query`` says which rows are queries;
    all rows are candidates.
    """
    with scratch(vectors.sparkSession):
        v = F.col(f"`{vector}`")
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        valid = vectors.where(v.isNotNull() & F.col(f"`{id_column}`").isNotNull()).where(finite)
        whole = F.transform(v, lambda x: _floor(x.cast("double") * F.lit(scale)))
        rows = valid.select(F.col(f"`{id_column}`").cast("long").alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
        signs = F.transform(F.slice("v", 1, 24), lambda x, i: F.when(x > 0, F.pow(F.lit(2.0), i).cast("int")).otherwise(0))
        rows = staged(rows.withColumn("signs", F.aggregate(signs, F.lit(0), lambda a, x: a + x)), "topk-rows")
        n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
        cell = F.pmod("signs", F.lit(1 << min(24, max(0, (n // CANDIDATE_BLOCK).bit_length() - 1))))
        sizes = staged(rows.groupBy(cell.alias("cell")).agg(F.ceil(F.count("*") / CANDIDATE_BLOCK).alias("parts")), "topk-cells")
        place = lambda *of: F.shiftleft(F.col("cell").cast("long"), 32) + F.pmod(F.xxhash64(*of), F.col("parts"))
        celled = rows.withColumn("cell", cell).join(sizes, "cell")
        # Equal rows differ by their place in the staged table, so that many of them don't meet in one block.
        blocked = staged(celled.select("id", "v", place("id", F.monotonically_increasing_id()).alias("block")), "topk-blocks")
        asked = celled.where("asks").groupBy("id", "v").agg(F.first("cell").alias("cell"), F.first("parts").alias("parts"))
        cuts = max(1, -(-asking // QUERY_BLOCK))
        asked = staged(asked.select("id", "v", F.xxhash64("v").alias("tag"), place("id", "v").alias("home"), F.pmod(F.xxhash64(F.lit(1), "id", "v"), F.lit(cuts)).cast("int").alias("qb")), "topk-queries")

        def search(queries: DataFrame) -> DataFrame:
            """Queries (block, qb, id, tag, least, v) against the candidates of their blocks, a task for each pair of blocks."""
            pairs = queries.select(F.col("block").alias("to"), F.col("qb").alias("of")).dropDuplicates()
            sent = blocked.join(pairs, F.col("block") == F.col("to")).select(F.col("to").alias("block"), F.col("of").alias("qb"), "id", "v")
            return queries.groupBy("block", "qb").cogroup(sent.groupBy("block", "qb")).applyInArrow(lambda q, c: _answers(q, c, k), ANSWER)

        order = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
        best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        near = staged(search(asked.select(F.col("home").alias("block"), "qb", "id", "tag", F.lit(None).cast("double").alias("least"), "v")), "topk-near", kept=True)
        reached = near.groupBy(F.col("query_id").alias("id"), "tag").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least")).where(F.col("n") >= k).drop("n")
        bounded = staged(asked.join(reached, ["id", "tag"], "left"), "topk-bounded")
        ends = staged(block_ends(blocked), "topk-ends")
        groups = max(1, -(-ends.count() // SUMMARY_BLOCK))
        left = bounded.withColumn("sb", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        right = ends.withColumn("sb", F.pmod("block", F.lit(groups)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))
        farther = left.groupBy("qb", "sb").cogroup(right.groupBy("qb", "sb")).applyInArrow(_within_reach, "block long, qb int, id long, tag long, least double, v array<double>")
        far = staged(search(staged(farther, "topk-farther")), "topk-far", kept=True)
        return best(near.unionByName(far)).select("query_id", "rank", "vec_id", "score")


def _floor(x: Column) -> Column:
    """Floor that stays a double; from 2**52 on every double is whole."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)
