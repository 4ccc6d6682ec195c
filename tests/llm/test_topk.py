import math
import random

from pyspark.sql import functions as F

from quernel.llm import topk

SCHEMA = "vec_id long, embedding array<float>, rank string, score string"


def brute(rows, k=5):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in whole:
        if q % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def run(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    return {tuple(r) for r in topk.top_k(docs, F.col("vec_id") % 50 == 0).collect()}


def vectors(n, seed, d=8):
    r = random.Random(seed)
    f = lambda x: float(__import__("numpy").float32(x))
    return [(i, [f(r.gauss(0, 0.3)) for _ in range(d)], "r", None) for i in range(n)]


def test_equal_to_brute_force_over_blocks(spark, monkeypatch):
    rows = vectors(900, 1)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 150)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "SUMMARY_BLOCK", 3)
    assert run(spark, rows) == brute(rows)


def test_blocks_out_of_reach_are_left_out(spark, monkeypatch):
    """Clusters far apart: a query is not sent to the blocks of other clusters."""
    import numpy as np

    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 100)
    rows = [(i, [float(np.float32(x + (1 if (i >> b) % 2 else -1))) for b, x in enumerate(v)], r, s) for i, v, r, s in vectors(800, 5, 3)]
    within = topk._within_reach
    assert run(spark, rows) == brute(rows)
    import pyarrow as pa

    q = pa.table({"qb": [0], "id": [0], "tag": [0], "least": [100.0], "v": [[10.0, 10.0]], "home": [9]})
    ends = pa.table({"block": [1, 2, 9], "high": [[9.0, 9.0], [-1.0, 1.0], [9.0, 9.0]], "low": [[1.0, 1.0], [-9.0, -9.0], [1.0, 1.0]]})
    assert within(q, ends).column("block").to_pylist() == [1]


def test_tiny_negative_components(spark):
    rows = [(0, [1 / 256, 1 / 256], None, None), (1, [-1e-22 / 256, 0.5], None, None), (2, [-1e-30, 0.5], None, None), (3, [0.0, 0.4], None, None)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, score string")
    assert {tuple(r) for r in topk.top_k(docs, F.col("vec_id") == 0).collect()} == {(0, 1, 1, 127), (0, 2, 2, 127), (0, 3, 3, 102)}


def test_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 64)
    rows = vectors(50, 6) + [(7, [0.5] * 8, None, None)] * 900
    assert run(spark, rows) == brute(rows)


def test_ties_and_copies(spark):
    rows = vectors(120, 2)
    rows += [(1000 + i, rows[50][1], None, None) for i in range(200)]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = vectors(60, 3) + [(100, None, None, None), (150, [1.0, None, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0], None, None), (200, [math.nan] * 8, None, None), (250, [math.inf] * 8, None, None), (None, [1.0] * 8, None, None)]
    assert run(spark, rows) == brute(rows)
    few = vectors(3, 4)
    assert run(spark, few) == brute(few)
    assert run(spark, []) == set()
    huge = [(0, [1e30, 1.0], None, None), (1, [1e30, 2.0], None, None), (2, [-1e30, 2.0], None, None)]
    assert {(r[1], r[2]) for r in run(spark, huge)} == {(1, 1), (2, 2)}
    short = [(0, [1.0, 2.0], None, None), (1, [1.0], None, None), (2, [], None, None)]
    assert {r[1:] for r in run(spark, short)} == {(1, 1, 65536), (2, 2, 0)}


def test_reading_stops_early(monkeypatch):
    import numpy as np

    r = np.random.default_rng(0)
    lists = np.floor(256 * r.normal(0, 0.02, (2000, 16)))
    lists[:5] += 200
    monkeypatch.setattr(topk, "DEPTHS", (0.25,))
    found = topk.search_block(lists[:1] * 0 + 100, np.array([-1]), lists, np.arange(2000), 5)
    assert set(found[0][0]) == set(range(5)) and found[0][2] == 0.25
    bound = topk.search_block(lists[:1] * 0 + 100, np.array([-1]), lists[5:], np.arange(1995), 5, np.array([300_000.0]))
    assert not len(bound[0][0]) and bound[0][2] < 0.26  # nothing reaches the bound that the query brings along


def test_queries_of_the_tables_stop_by_their_bounds(monkeypatch):
    """Without the last round, which reads everything, no query is left waiting."""
    import numpy as np
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pydict()
    ids, whole = np.array(rows["vec_id"]), np.floor(256 * np.array(rows["embedding"], float))
    asks = ids % 50 == 0
    full = topk.search_block(whole[asks], ids[asks], whole, ids, 5)
    monkeypatch.setattr(topk, "DEPTHS", topk.DEPTHS[:-1])
    early = topk.search_block(whole[asks], ids[asks], whole, ids, 5)
    assert all(e is not None and (e[0] == f[0]).all() and (e[1] == f[1]).all() for e, f in zip(early, full, strict=True))
    print("read of the lists on average:", sum(f[2] for f in full) / len(full))
    assert max(f[2] for f in full) < 1
