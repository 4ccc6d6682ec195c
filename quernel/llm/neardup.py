"""Near-duplicate classes by DartMinHash and banded joining (operator 2).

A text is the weighted set of its shingles of five words; words are split at ASCII white
space.  A shingle weighs the number of binary digits of its count (1 for one, 2 for two or
three, 9 for 300), or, by choice, always 1: repetition counts, but one phrase repeated
hundreds of times doesn't outweigh the rest of two different texts.  DartMinHash throws hashed darts at the plane of
weight and rank above every shingle; those under the shingle's weight count, the
earliest one for each coordinate is the signature, and two texts agree in a
coordinate with the probability of their (weighted) Jaccard similarity.  Bands of
coordinates are the join keys.

Equal texts are one node, named by 128 bits, from the start.  Within a band's bucket
nodes aren't paired with each other but with the bucket's hub, its most central node,
and each pair is verified on the whole texts.  Around a hub that leaves nodes in other
classes a second hub is chosen among these.  What both don't settle is settled exactly:
the nodes outside the hub's largest class are compared in blocks of bounded size with
each other and with that class, and a block hands on a spanning forest only.  So every
pair that shares a bucket is either in one class or was compared, and no step makes all
pairs of a group.  Classes are the connected components of the verified links.

Null texts count as empty.  Texts without words are only copies of equal texts;
texts under five words are one shingle.  Very long texts are cut into words piece by
piece and signed whole.  The class id is the least id in the class
(null if all are null).  Repeated rows share a class, ties between hubs go to the
greater hash; extra columns are ignored, whatever their names.  An empty table gives an
empty result.
With 20 bands of 5 coordinates a pair of similarity 0.8 shares a bucket with
probability 0.9996.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import free_name, hash128, scratch, scratched, staged

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
BLOCK = 128
PIECE = 1 << 22
COLUMNS = 4096

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x5851F42D4C957F2D)
_BASE = np.uint64(0xD6E8FEB86659FD93)
#: Distribution function of the Poisson law of mean 1.
_POISSON = np.cumsum([np.exp(-1) / f for f in np.cumprod([1.0, *range(1, 16)])])


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order.  Long texts go in pieces cut at white space."""
    out, at = [], 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            while end < len(text) and not _SPACE[text[end]]:
                end += 1
        b = np.frombuffer(text, np.uint8, min(end, len(text)) - at, at)
        inside = ~_SPACE[b]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts = np.flatnonzero(first)
        if len(starts):
            letters = np.flatnonzero(inside)
            which = np.cumsum(first)[letters] - 1
            place = letters - starts[which]
            powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(place.max()), _BASE)]))
            out.append(_mix(np.add.reduceat(_BYTE[b[letters]] * powers[place], np.flatnonzero(place == 0))))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: bytes, weighted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text and their weights (1, or the binary digits of how often each occurs)."""
    w = word_hashes(text)
    if not len(w):
        return w, np.zeros(0)
    size = min(SHINGLE, len(w))
    h = np.zeros(len(w) - size + 1, np.uint64)
    for j in range(size):
        h = h * np.uint64(0xA24BAED4963EE407) + w[j : j + len(h)]
    found, n = np.unique(_mix(h), return_counts=True)
    return found, np.frexp(n)[1].astype(float) if weighted else np.ones(len(found))


def _darts(h: np.ndarray, weight: np.ndarray, reach: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank, coordinate and id of all darts under the weights and before ``reach``.

    Weight is cut into bands that double in height; a band's cells have area 1, so
    each holds a Poisson number of darts of mean 1, drawn by hash of element and cell.
    """
    ranks, coordinates, ids = [], [], []
    for level in range(int(np.log2(weight.max() + 1)) + 1):
        height, floor = 2.0**level, 2.0**level - 1
        some = np.flatnonzero(weight > floor)
        if not len(some):
            break
        cells = int(np.ceil(reach * height))
        cell = np.tile(np.arange(cells, dtype=np.uint64), len(some))
        owner = np.repeat(some, cells)
        x = _mix(h[owner] ^ _mix(cell * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level << 48 | 1)))
        n = np.searchsorted(_POISSON, _unit(x))
        place = np.repeat(np.arange(len(x)), n)
        number = (np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
        dart = _mix(x[place] + (number + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        rank = (cell[place].astype(float) + _unit(_mix(dart ^ np.uint64(0x2545F4914F6CDD1D)))) / height
        hit = (floor + height * _unit(dart) < weight[owner[place]]) & (rank < reach)
        dart = dart[hit]
        ranks.append(rank[hit])
        coordinates.append((_mix(dart + np.uint64(0x632BE59BD9B4E019)) % np.uint64(k)).astype(np.int64))
        ids.append(dart)
    return np.concatenate(ranks), np.concatenate(coordinates), np.concatenate(ids)


def dart_minhash(h: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """The signature: the earliest dart of each of ``k`` coordinates.

    Enough ranks are searched for k ln k + 2k darts; if a coordinate got none, the
    reach is doubled, which doesn't change those that did.
    """
    reach = (k * np.log(k) + 2 * k) / weight.sum()
    while True:
        rank, coordinate, dart = _darts(h, weight, reach, k)
        order = np.argsort(-rank, kind="stable")
        out, filled = np.zeros(k, np.uint64), np.zeros(k, bool)
        out[coordinate[order]] = dart[order]
        filled[coordinate] = True
        if filled.all():
            return out
        reach *= 2


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = signature.reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, j])
    return key.view(np.int64)


def text_hash(text: Column) -> Column:
    """128 bits that name a text."""
    return F.unhex(F.md5(text.cast("binary")))


def signatures(docs: DataFrame, id_column: str, text: str, weighted: bool, bands: int, rows: int) -> DataFrame:
    """(id, node, n, bands) of every row: text hash, weight of all shingles, band keys (empty without words)."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    source = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), text_hash(body).alias("node"), body.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, keys = [], []
                for cell in part.column(2):
                    h, weight = shingles(cell.as_py(), weighted)
                    sizes.append(int(weight.sum()))
                    keys.append(band_keys(dart_minhash(h, weight, bands * rows), bands, rows) if len(h) else np.zeros(0, np.int64))
                lengths = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(keys), pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(sizes, pa.int64()), lists], names=["id", "node", "n", "bands"])

    return source.mapInArrow(run, "id long, node binary, n long, bands array<long>")


def _similar(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], least: float) -> bool:
    (h, w), (g, v) = x, y
    total = w.sum() + v.sum()
    if not total or min(w.sum(), v.sum()) < least * max(w.sum(), v.sum()):
        return False
    _, i, j = np.intersect1d(h, g, assume_unique=True, return_indices=True)
    shared = np.minimum(w[i], v[j]).sum()
    return bool(shared >= least * (total - shared) - 1e-9)


def verified(pairs: DataFrame, texts: DataFrame, weighted: bool, least: float) -> DataFrame:
    """The pairs (node, hub) whose whole texts have a similarity of at least ``least``."""
    left = pairs.select("node", "hub").join(texts.select("node", "text").hint("merge"), "node")
    both = left.join(texts.select(F.col("node").alias("hub"), F.col("text").alias("hub_text")).hint("merge"), "hub").select("node", "text", "hub", "hub_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            nodes, hubs = [], []
            for i in range(batch.num_rows):
                node, text, hub, hub_text = (batch.column(c)[i].as_py() for c in range(4))
                if hub != last:
                    last, known = hub, shingles(hub_text, weighted)
                if _similar(shingles(text, weighted), known, least):
                    nodes.append(node)
                    hubs.append(hub)
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.binary()), "hub": pa.array(hubs, pa.binary())})

    return both.mapInArrow(run, "node binary, hub binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of ``edges`` (node, hub): the least node it is connected to.

    Labels go along edges and are then followed once (pointer jumping); each round
    is written to the shared folder.
    """
    ways = staged(edges.select("node", "hub").unionByName(edges.select(F.col("hub").alias("node"), F.col("node").alias("hub"))).dropDuplicates(), "neardup-ways")
    label = staged(ways.groupBy("node").agg(F.least(F.min("hub"), F.first("node")).alias("comp")), "neardup-label")
    while True:
        seen = ways.join(label.withColumnRenamed("node", "hub"), "hub").groupBy("node").agg(F.min("comp").alias("near"))
        near = label.join(seen, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("near"))
        jump = label.select(F.col("node").alias("near"), F.col("comp").alias("far"))
        after = staged(near.join(jump, "near").select("node", F.least("near", "far").alias("comp"), "was"), "neardup-label")
        label = after.select("node", "comp")
        if after.where("comp <> was").isEmpty():
            return label


def _forest(texts: list[bytes], nodes: list[bytes], comps: list[bytes], side: np.ndarray, weighted: bool, least: float) -> list[tuple[bytes, bytes]]:
    """Links between classes among the texts of a pair of blocks, as a forest.

    ``side`` is 0 and 1 for the two blocks, whose pairs across count, or 0 throughout
    for a block with itself.
    """
    own = [shingles(t, weighted) for t in texts]
    size = np.array([w.sum() for _, w in own])
    count = len(own)
    flat = np.concatenate([h for h, _ in own])
    weight = np.concatenate([w for _, w in own])
    row = np.repeat(np.arange(count), [len(h) for h, _ in own])
    _, column, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared_by = n[column] > 1
    row, column, weight = row[shared_by], column[shared_by], weight[shared_by]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column, weight = row[order], column[order], weight[order]
    shared = np.zeros((count, count))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        at = slice(*np.searchsorted(column, [low, low + COLUMNS]))
        _add_shared(shared, row[at], column[at] - low, weight[at])
    total = size[:, None] + size[None, :] - shared
    _, kind = np.unique(np.array(comps, object), return_inverse=True)
    linked = (shared >= least * total - 1e-9) & (total > 0) & (kind[:, None] != kind[None, :])
    if side.any():
        linked &= side[:, None] != side[None, :]
    root = {c: c for c in comps}

    def find(c: bytes) -> bytes:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        a, b = find(comps[i]), find(comps[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((nodes[i], nodes[j]))
    return out


def _add_shared(shared: np.ndarray, row: np.ndarray, column: np.ndarray, weight: np.ndarray) -> None:
    """Add the common part, the sum of the lesser weights, of every pair of rows over up to ``COLUMNS`` shingles.

    min(v, w) is summed in steps between the distinct weights that occur, of which texts have few.
    """
    before = 0.0
    for step in np.unique(weight):
        m = np.zeros((len(shared), COLUMNS), np.float32)
        m[row[weight >= step], column[weight >= step]] = 1
        shared += (step - before) * (m @ m.T)
        before = step


def _around(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """(hub, node, comp, open) of every node around a hub, the hub included, where these are in different classes;
    ``open`` are the nodes outside the hub's largest class."""
    label = staged(comp, "neardup-comp")
    members = pairs.select("hub", "node").unionByName(pairs.select("hub", F.col("hub").alias("node")).dropDuplicates())
    named = staged(members.join(label, "node", "left").select("hub", "node", F.coalesce("comp", "node").alias("comp")), "neardup-named")
    classes = named.groupBy("hub", "comp").agg(F.count("*").alias("size"))
    main = classes.groupBy("hub").agg(F.max(F.struct("size", "comp")).alias("main"), F.count("*").alias("classes"))
    main = staged(main.where("classes > 1").select("hub", F.col("main.comp").alias("main")), "neardup-open")
    return named.join(main, "hub").select("hub", "node", "comp", (F.col("comp") != F.col("main")).alias("open"))


def second_hubs(around: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (node, hub): around each hub the heaviest open node as another hub, and all nodes of other classes that its weight allows."""
    weighed = staged(around.join(nodes.select("node", "n"), "node"), "neardup-weighed")
    chosen = weighed.where("open").groupBy("hub").agg(F.max(F.struct("n", "node", "comp")).alias("h"))
    chosen = staged(chosen.select("hub", F.col("h.node").alias("next"), F.col("h.n").alias("next_n"), F.col("h.comp").alias("next_comp")), "neardup-next")
    fits = F.least("n", "next_n") >= F.lit(similarity) * F.greatest("n", "next_n") - 1e-9
    return weighed.join(chosen, "hub").where(fits & (F.col("comp") != F.col("next_comp"))).select("node", F.col("next").alias("hub")).dropDuplicates()


def unsettled_links(around: DataFrame, texts: DataFrame, weighted: bool, least: float) -> DataFrame:
    """Links (node, hub) between nodes around a hub that are still in different classes.

    The open nodes around a hub are cut into blocks, and so are those of its largest
    class.  Open blocks meet each other and the blocks of the largest class; within
    that class nothing is compared.  A text is copied once for each block that it meets:
    those of the largest class as often as there are open blocks, which is mostly once.
    """
    around = staged(around, "neardup-around")
    sizes = around.groupBy("hub").agg(*[F.ceil(F.count_if(c) / BLOCK).cast("int").alias(k) for k, c in (("opens", F.col("open")), ("mains", ~F.col("open")))])
    sizes = staged(sizes, "neardup-sizes")
    member = around.join(sizes, "hub")
    block = F.pmod(F.xxhash64("node"), F.when(F.col("open"), F.col("opens")).otherwise(F.col("mains"))).cast("int")
    # Blocks of open nodes are numbered from 0, those of the largest class after them.
    member = member.withColumn("block", F.when(F.col("open"), block).otherwise(block + F.col("opens")))
    others = F.sequence(F.lit(0), F.when(F.col("open"), F.col("opens") + F.col("mains")).otherwise(F.col("opens")) - 1)
    member = member.withColumn("other", F.explode(others))
    member = member.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "opens", "mains")
    full = member.join(texts.hint("merge"), "node").select("hub", "i", "j", "node", "comp", "block", "text")

    def run(t: pa.Table) -> pa.Table:
        nodes, comps = t.column("node").to_pylist(), t.column("comp").to_pylist()
        side = (t.column("block").to_numpy() != t.column("i")[0].as_py()).astype(int)
        found = _forest(t.column("text").to_pylist(), nodes, comps, side, weighted, least)
        return pa.table({"node": pa.array([a for a, _ in found], pa.binary()), "hub": pa.array([b for _, b in found], pa.binary())})

    return full.groupBy("hub", "i", "j").applyInArrow(run, "node binary, hub binary")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", *, weighted: bool = True, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, class_id, node, class_node) of every row; node names the text, class_node
    the class also where ids are null."""
    with scratch(docs.sparkSession):
        signed = staged(signatures(docs, id_column, text, weighted, bands, rows), "neardup-signed", kept=True)
        nodes = signed.groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        nodes = staged(nodes, "neardup-nodes")

        keyed = staged(nodes.select("node", "n", F.explode("bands").alias("key")), "neardup-keys")
        shared = staged(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "neardup-buckets")
        inside = staged(keyed.join(shared, "key"), "neardup-inside")
        central = inside.groupBy("node").agg(F.sum("size").alias("central"))
        hubs = inside.join(staged(central, "neardup-central"), "node").groupBy("key").agg(F.max(F.struct("central", "node", "n")).alias("h"))
        hubs = staged(hubs.select("key", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n")), "neardup-hubs")
        pairs = staged(inside.join(hubs, "key").where("node <> hub").groupBy("node", "hub").agg(F.first("n").alias("n"), F.first("hub_n").alias("hub_n")), "neardup-pairs")

        wanted = pairs.select("node").unionByName(pairs.select(F.col("hub").alias("node"))).dropDuplicates()
        # Of equal texts one row is sent on: the one with the least id, or any if that id is repeated.
        wanted = staged(nodes.select("node", "least").join(wanted, "node"), "neardup-wanted")
        body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
        source = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), text_hash(body).alias("node"), body.cast("binary").alias("text"))
        known = wanted.select(F.col("least").alias("known"), F.col("node").alias("own")).hint("merge")  # grows with the documents: never broadcast
        match = (source["node"] == known["own"]) & source["id"].eqNullSafe(known["known"])
        texts = staged(source.join(known, match, "left_semi").select("node", "text").dropDuplicates(["node"]), "neardup-texts")

        fitting = pairs.where(F.least("n", "hub_n") >= F.lit(similarity) * F.greatest("n", "hub_n") - 1e-9)
        links = staged(verified(fitting, texts, weighted, similarity), "neardup-links")
        comp = components(links)
        around = _around(pairs, comp)
        again = second_hubs(around, nodes, similarity)
        more = staged(verified(again, texts, weighted, similarity), "neardup-links")
        if not more.isEmpty():
            links = links.unionByName(more)
            comp = components(links)
            around = _around(pairs, comp)
        more = staged(unsettled_links(around, texts, weighted, similarity), "neardup-more")
        if not more.isEmpty():
            comp = components(links.unionByName(more))

        joined = nodes.select("node", "least").join(comp, "node", "left").withColumn("class_node", F.coalesce("comp", "node"))
        joined = staged(joined.select("node", "least", "class_node"), "neardup-joined")
        least = staged(joined.groupBy("class_node").agg(F.min("least").alias("class_id")), "neardup-least")
        classes = staged(joined.select("node", "class_node").join(least, "class_node"), "neardup-classes", kept=True)
        return signed.select("id", "node").join(classes, "node").select(F.col("id").alias(id_column), "class_id", "node", "class_node")


@scratched
def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class: the one with the least id (a null
    id comes last), then the least text hash; of rows that share both the one whose
    other columns hash least, so that reruns keep the same row."""
    found = near_duplicates(docs, id_column, text, **options)
    order = F.struct(F.col(id_column).isNull().alias("last"), F.col(id_column).alias("id"), F.col("node").alias("node"))
    winners = found.groupBy("class_node").agg(F.min(order).alias("w")).select("w.id", "w.node")
    winners = staged(winners.select(hash128(F.col("id")).getField("a").alias("i"), "node"), "neardup-winners", kept=True)
    keys, place, rest = [free_name(docs, "__id"), free_name(docs, "__node")], free_name(docs, "__place"), free_name(docs, "__rest")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    scalar = [F.col(f"`{c}`").cast("string") for c in docs.columns if docs.schema[c].dataType.typeName() not in ("map", "array", "struct", "variant")]
    marked = docs.withColumns({keys[0]: hash128(F.col(f"`{id_column}`").cast("long")).getField("a"), keys[1]: text_hash(body), rest: hash128(*scalar)})
    kept = marked.join(winners.toDF(*keys).hint("merge"), keys, "left_semi")
    ranked = kept.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(rest)))
    return ranked.where(F.col(place) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
