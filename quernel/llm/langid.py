"""Language identification (operator 10).

A sparse multinomial logistic regression on TF-IDF character n-grams.  N-grams of
one to three characters are hashed into a fixed number of features.  Document
frequencies come from every training row of the corpus, counted on the executors;
the classifier itself is fitted on a bounded sample of labelled rows
(``per_language`` rows a language, ``most_rows`` in all), online, with follow-the-regularised-leader and
elastic-net penalties, which leaves most weights exactly zero.  A temperature is
then fitted on rows kept out of the fit, so that scores are calibrated.

Texts that are null or have no letter get ``und`` and score 0.  Repeated rows are
predicted alike; ties between languages go to the one that sorts first.  With no
training row, as in an empty table, every text is ``und``.  Very long texts are read
whole, in pieces that carry n-grams over.  Only the text is an input of a prediction;
extra columns are kept by :func:`predict`, which replaces ``lang_pred`` and ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURE_BITS = 16
FEATURES = 1 << FEATURE_BITS
#: Fixed odd multipliers of the n-gram hashes, by length.
MULTIPLIERS = (2654435761, 2246822519, 3266489917)
CHUNK = 1 << 20
UNKNOWN = "und"


def _codes(text: str) -> Iterator[np.ndarray]:
    """The code points of a lower-cased text between two spaces, every character that isn't a letter read as a
    space, in pieces of ``CHUNK`` that each end with the start of the next one, so that no n-gram is lost between them."""
    low = text.lower()
    for at in range(0, len(low) + 2, CHUNK):
        piece = low[max(0, at - 1) : at + CHUNK + len(MULTIPLIERS) - 2]
        cleaned = piece if piece.isalpha() else "".join(c if c.isalpha() else " " for c in piece)
        padded = " " * (at == 0) + cleaned + " " * (at + CHUNK + len(MULTIPLIERS) - 2 > len(low))
        yield np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32)


def _features(code: np.ndarray) -> np.ndarray:
    out, h = [], np.zeros(len(code), np.uint32)
    for n, multiplier in enumerate(MULTIPLIERS):
        h = (h[: len(code) - n] * np.uint32(31 * 2 + 2 * n + 1) + code[n:]) * np.uint32(multiplier)
        h ^= h >> np.uint32(15)
        out.append(h[:CHUNK] >> np.uint32(32 - FEATURE_BITS))
    return np.concatenate(out)


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a whole text and how often each occurs."""
    parts = list(map(_features, _codes(text)))
    total = np.bincount(parts[0], minlength=FEATURES)
    for part in parts[1:]:
        total += np.bincount(part, minlength=FEATURES)
    found = np.flatnonzero(total)
    return found, total[found]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    rows: int = field(default=0)

    def vector(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[found]
        return x / (np.sqrt((x * x).sum()) or 1.0)

    def logits(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(found, counts) @ self.weights[found] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*counts_of(text)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, *, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01, epochs: int = 3, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by proximal follow-the-regularised-leader.

    ``rows`` are (features, values, class).  A weight stays zero while its
    accumulated gradient is within ``l1``.
    """
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def current(at: np.ndarray) -> np.ndarray:
        za = z[at]
        return np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            found, values, label = rows[i]
            at, x = np.append(found, FEATURES), np.append(values, 1.0)
            w = current(at)
            p = softmax(x @ w)
            p[label] -= 1.0
            g = x[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    w = current(np.arange(FEATURES + 1))
    return w[:FEATURES], w[FEATURES]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least mean loss, by golden-section search on its logarithm.

    The targets are smoothed by 1 / (rows + 2), so that a perfectly separated
    sample doesn't claim more certainty than its size supports.
    """
    if not len(labels) or logits.shape[1] < 2:
        return 1.0
    smoothed = np.full(logits.shape, 1 / (len(labels) + 2) / (logits.shape[1] - 1))
    smoothed[np.arange(len(labels)), labels] = 1 - 1 / (len(labels) + 2)

    def loss(u: float) -> float:
        return float(-(smoothed * np.log(np.maximum(softmax(logits / np.exp(u)), 1e-300))).sum(axis=1).mean())

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows each feature occurs, over all of ``rows`` (one text column).

    Each task sends its counts once; the sums (at most 65,537 rows) come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(FEATURES + 1, np.int64), 0
        for batch in batches:
            for cell in batch.column(0):
                total[counts_of(cell.as_py())[0]] += 1
                seen += 1
        total[FEATURES] = seen
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(found, pa.int32()), "n": pa.array(total[found], pa.int64())})

    sums = rows.mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(FEATURES + 1, np.int64)
    for feature, n in sums:
        total[feature] = n
    return total[:FEATURES], int(total[FEATURES])


def train(labelled: DataFrame, key: Column, text: str, lang: str, per_language: int = 1000, held_back: int = 5, most_rows: int = 20_000) -> LanguageModel:
    """Fit a model on ``labelled`` rows.

    ``key`` (a hash column) chooses the sample: about ``per_language`` rows of each
    language, the same ones on every run; a language with fewer gives all.  ``most_rows``
    bounds the sample of all languages together, and with it what the driver holds.  One
    row in ``held_back`` of the sample fits the temperature instead of the weights.
    """
    usable = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), key.alias("key"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    df, rows = document_frequencies(usable.select("text"))
    idf = np.log((1 + rows) / (1 + df)) + 1
    if not languages:
        return LanguageModel([], idf, np.zeros((FEATURES, 0)), np.zeros(0))
    per_language = max(1, min(per_language, most_rows // len(languages)))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    scale = 1 << 30
    chosen = usable.where(F.pmod("key", F.lit(scale)) < share[F.col("lang")] * scale)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                both = [counts_of(c.as_py()) for c in part.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array([f.astype("<i4").tobytes() for f, _ in both], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in both], pa.binary()), part.column(1), part.column(2)], names=["found", "counts", "lang", "key"])

    sample = sorted(chosen.mapInArrow(extract, "found binary, counts binary, lang string, key long").collect(), key=lambda r: (r["key"], r["found"]))
    model = LanguageModel(languages, idf, np.zeros((FEATURES, len(languages))), np.zeros(len(languages)), rows=rows)
    place = {k: i for i, k in enumerate(languages)}
    fit, held = [], []
    for i, r in enumerate(sample):
        found, counts = np.frombuffer(r["found"], "<i4"), np.frombuffer(r["counts"], "<i4")
        (held if i % held_back == 0 and len(sample) > 2 * held_back else fit).append((found, model.vector(found, counts), place[r["lang"]]))
    model.weights, model.bias = fit_ftrl(fit, len(languages))
    logits = np.array([x @ model.weights[f] + model.bias for f, x, _ in held]).reshape(len(held), len(languages))
    model.temperature = fit_temperature(logits, np.array([c for *_, c in held], int))
    return model


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` for every whole text; columns of ``docs``
    with these names are replaced.  The model's size is fixed by the number of
    features and languages, and it is sent once to each executor."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    at = kept.index(text)
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [model.predict(c.as_py()) for c in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def held_out(id_column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; never for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on_documents(docs: DataFrame, per_language: int = 1000) -> LanguageModel:
    """The model of the standard query: rows with an id that aren't held out."""
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out())
    return train(rows, F.xxhash64("doc_id"), "text", "lang", per_language)


def identify_language(docs: DataFrame, per_language: int = 1000) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every row."""
    model = train_on_documents(docs, per_language)
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
