"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

Training reads a bounded sample of labelled rows, smallest hash first: at most
``max_train`` rows, and as many of these as have ``max_features`` features
together.  The features of whole texts are made on the executors; one pass of
per-coordinate FTRL-Proximal updates per epoch runs on the driver, whose memory
is bounded by ``max_features`` and by the 2**bits weights.  Scoring is one narrow
pass over all whole texts with the weights as a broadcast of fixed size.

Defined results: null and empty texts have no features and score by the bias;
rows with a null label or id are not learnt from, nor are ids that are labelled
both ways; an id that is repeated, as label or as document, counts once, with its
smallest text; repeated rows are scored one by one; without labels of both kinds every score is one half;
other columns are not looked at.  Language, source and id are never inputs of a
score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, table
from .ngrams import features

BITS = 18
MAX_TRAIN = 6000
MAX_FEATURES = 12_000_000  # of all training rows together; twelve bytes each


class Ftrl:
    """Per-coordinate FTRL-Proximal for logistic loss; the last weight is the bias."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros(size + 1)
        self.n = np.zeros(size + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def update(self, at: np.ndarray, x: np.ndarray, label: float, importance: float = 1.0) -> None:
        w = self.weights(at)
        gradient = (1.0 / (1.0 + np.exp(-float(w @ x))) - label) * x * importance
        squared = gradient * gradient
        self.z[at] += gradient - (np.sqrt(self.n[at] + squared) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += squared


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], bits: int, epochs: int = 3, seed: int = 11) -> np.ndarray:
    """Weights and, last, the bias.  Both classes get the same total importance; every fifth row is not
    learnt from but sets the bias, so that a score of one half parts the classes with fewest errors."""
    model = Ftrl(1 << bits)
    ones = sum(y for _, _, y in rows)
    if not rows or not 0 < ones < len(rows):
        return model.weights()
    importance = {1.0: len(rows) / (2 * ones), 0.0: len(rows) / (2 * (len(rows) - ones))}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    aside, learnt = (order[::5], np.setdiff1d(order, order[::5])) if len(rows) >= 50 else (order[:0], order)
    for _ in range(epochs):
        for k in rng.permutation(learnt):
            at, x, y = rows[k]
            model.update(np.append(at, 1 << bits), np.append(x, 1.0), y, importance[y])
    weights = model.weights()
    weights[-1] -= _boundary(np.array([weights[at] @ x + weights[-1] for at, x, _ in (rows[k] for k in aside)]), np.array([rows[k][2] for k in aside]))
    return weights


def _boundary(z: np.ndarray, y: np.ndarray) -> float:
    """Where to part margins ``z`` of labels ``y`` with fewest errors per class; the middle of the widest such place."""
    if not 0 < y.sum() < len(y):
        return 0.0
    order = np.argsort(z)
    z, y = z[order], y[order]
    wrong = np.cumsum(y)[:-1] / y.sum() + (np.cumsum((1 - y)[::-1])[::-1][1:]) / (1 - y).sum()
    best = np.nonzero(wrong == wrong.min())[0]
    return float((z[best[0]] + z[best[-1] + 1]) / 2)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, bits: int, max_features: int = MAX_FEATURES) -> list[tuple[np.ndarray, np.ndarray, object]]:
    """(buckets, weights, y) of rows (h, y, t), which are bounded already, in an order of their own: those with the smallest h,
    no more than have ``max_features`` features together."""

    def run(batches):
        for b in batches:
            for h, y, t in zip(b.column(0), b.column(1), b.column(2)):
                at, x = unique_features(t.as_py() or b"", bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h.as_py()], pa.int64()), pa.array([y.as_py()], b.schema.field(1).type), pa.array([len(at)], pa.int64()),
                     pa.array([at.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())],
                    names=["h", "y", "n", "at", "x"],
                )

    made = stash(docs.mapInArrow(run, f"h long, y {docs.schema['y'].dataType.simpleString()}, n long, at binary, x binary"), "training-rows")
    sizes = sorted((r["h"], r["n"]) for r in made.select("h", "n").collect())  # max_train rows at most
    total, last = 0, None
    for h, n in sizes:
        total += n
        if total > max_features:
            break
        last = h
    if last is None:
        return []
    got = made.where(F.col("h") <= F.lit(last)).select("y", "at", "x").toArrow()
    # Views of the collected table: the features are on the driver once.
    rows = [(np.frombuffer(a.as_buffer(), np.int32), np.frombuffer(x.as_buffer(), np.float32), y.as_py()) for y, a, x in zip(*got.columns, strict=True)]
    rows.sort(key=lambda r: (r[2], len(r[0]), float(r[1].sum()), int(r[0].sum())))  # the order of tasks does not matter
    return rows


def one_text_each(rows: DataFrame) -> DataFrame:
    """Of rows (h, y, t) with one h the smallest: an id that is repeated counts once."""
    return rows.groupBy("h").agg(F.min(F.struct("y", "t")).alias("r")).select("h", "r.y", "r.t")


def unique_features(text: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    at, x = features(text, bits)
    keys, index = np.unique(at, return_inverse=True)
    return keys.astype(np.int32), np.bincount(index, weights=x, minlength=len(keys)).astype(np.float32)


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    bits: int = BITS, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES,
) -> np.ndarray:
    """Weights learnt from at most ``max_train`` labelled rows outside the held-out third."""
    picked = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).cast("double").alias("y"), F.max(label_col).cast("double").alias("other"))
        .where("y = other")
        .select(F.xxhash64("id").alias("h"), "id", "y")
        .orderBy("h", "id")
        .limit(max_train)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    sample = one_text_each(texts.join(F.broadcast(picked), "id"))  # max_train rows of three numbers
    weights = train(training_rows(sample, bits, max_features), bits)
    pa.default_memory_pool().release_unused()  # the features are not wanted any more
    return weights


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, columns ``keep`` and ``score`` per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches):
        w = shared.value
        bias = float(w[-1])
        for b in batches:
            out = np.empty(len(b))
            for k, t in enumerate(b.column(0)):
                at, x = features(t.as_py() or b"", bits)
                out[k] = 1.0 / (1.0 + np.exp(-(float(w[at] @ x) + bias)))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(out)], names=[*b.schema.names[1:], "score"])

    rows = docs.select(F.col(text_col).cast("binary").alias("_text"), id_col, *keep)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.drop("_text").dtypes) + ", score double")


def op10_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    weights = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, weights).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
