"""Mixing to target weights with soft memberships.

A softmax classifier over hashed word n-grams, trained on a labelled table,
gives every document a posterior over domains.  With p_id the posterior and t_i
the tokens of document i, rates r_i >= 0 are fitted so that the expected token
totals sum_i r_i t_i p_id meet the targets T_d:

    minimise  sum_d (sum_i r_i t_i p_id / T_d - 1)^2 / 2 + ridge / 2 * sum_i c_i (r_i - 1)^2,

where c_i = t_i / sum t keeps each rate near one unless the targets ask for more.  Projected
gradients scaled by their curvature: the optimum is r_i = max(0, 1 + p_i . x), so a round sums
the totals and the (domains x domains) curvature of the rows with a rate above zero, and takes
a damped Newton step in x.  The ridge gives way until every target is met within
``TOLERANCE``; a fit that does not get there raises.  A round reads the written table once,
keeps no lineage and moves k * k + k + 1 sums a task.

Scale: training reads a bounded sample of labelled rows; the posterior is one
narrow pass over all whole texts; each round scans the id-free numeric columns.

Defined results: null and empty texts have no tokens and keep the classifier's
prior as posterior; rows without a label are not learnt from, and an id that is
repeated counts once, with its smallest label and text; repeated rows get equal rates; with no label at all there is one domain, ``other``; an empty table
gives an empty table; target domains that are the likeliest of no document are left unmet; other columns
are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, table
from .ngrams import features, words
from .quality_classifier import one_text_each, training_rows

BITS = 16
MAX_TRAIN = 3000
MAX_DOMAINS = 256
ROUNDS = 25
RIDGE = 0.02
#: Relative distance to its target at which a domain counts as met.
TOLERANCE = 0.02
#: Shares of the registered query with explicit weights; other languages have a weight of one.
SKEWED = {"en": 12.0}
#: Targets of the registered query and of the pipeline: token totals to this power, so that small domains gain.
TEMPERATURE = 0.7


class Posterior:
    """Softmax regression; ``weights`` has a row per domain, the bias last."""

    def __init__(self, names: list[str], weights: np.ndarray):
        self.names, self.weights = names, weights

    def __call__(self, text: bytes) -> np.ndarray:
        at, x = features(text, BITS, shapes=False)
        z = self.weights[:, at] @ x + self.weights[:, -1]
        z = np.exp(z - z.max())
        return z / z.sum()


def train_posterior(labelled: DataFrame, label_col: str, id_col: str, text_col: str, max_train: int = MAX_TRAIN, epochs: int = 4) -> Posterior:
    """Fit on at most ``max_train`` labelled rows, smallest hash of the id first."""
    names = [r["y"] for r in labelled.select(F.col(label_col).alias("y")).where("y is not null").distinct().orderBy("y").limit(MAX_DOMAINS + 1).collect()]
    if len(names) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    if not names:
        return Posterior(["other"], np.zeros((1, (1 << BITS) + 1), dtype=np.float32))
    picked = labelled.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.xxhash64(F.col(id_col)).alias("h"), F.col(label_col).alias("y"), F.col(text_col).cast("binary").alias("t")
    )
    # Hashes choose; only the chosen rows' features leave the executors.
    chosen = picked.select("h").orderBy("h").limit(max_train).agg(F.max("h")).first()[0]
    if chosen is None:
        return Posterior(names, np.zeros((len(names), (1 << BITS) + 1), dtype=np.float32))
    rows = [(names.index(y), at, x) for at, x, y in training_rows(one_text_each(picked.where(F.col("h") <= F.lit(chosen))), BITS)]
    weights = np.zeros((len(names), (1 << BITS) + 1))
    squares = np.full_like(weights, 1e-2)
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, at, x = rows[k]
            at, x = np.append(at, 1 << BITS), np.append(x, np.float32(1.0))
            z = weights[:, at] @ x
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1.0
            g = p[:, None] * x[None, :]
            squares[:, at] += g * g
            weights[:, at] -= 0.5 * g / np.sqrt(squares[:, at])
    rows.clear()
    pa.default_memory_pool().release_unused()
    return Posterior(names, weights.astype(np.float32))


def memberships(docs: DataFrame, model: Posterior, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """Columns ``keep``, tokens (words of the whole text) and the posterior p per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            tokens, p = [], []
            for t in b.column(0):
                t = t.as_py() or b""
                tokens.append(len(words(np.frombuffer(t, dtype=np.uint8))[0]))
                p.append(shared.value(t).astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array(tokens, pa.int64()), pa.array(p, pa.list_(pa.float64()))], names=[*b.schema.names[1:], "tokens", "p"]
            )

    rows = docs.select(F.col(text_col).cast("binary").alias("_text"), *keep)
    return rows.mapInArrow(run, "".join(f"`{c}` {t}, " for c, t in rows.drop("_text").dtypes) + "tokens long, p array<double>")


def _rate(pull: np.ndarray) -> Column:
    """A document's rate: one, moved by its posterior's product with ``pull`` and projected to what is not negative."""
    return F.greatest(F.lit(0.0), F.lit(1.0) + sum((F.col("p")[i] * F.lit(float(x)) for i, x in enumerate(pull)), F.lit(0.0)))


def _sums(members: DataFrame, pull: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sums over all rows at the rates of ``pull``: tokens by squared rate, expected totals, and the curvature of the rows
    with a rate above zero.  A task adds up its rows; k * k + k + 1 numbers, summed by place, reach the driver."""
    k = len(pull)

    def run(batches):
        out = np.zeros(1 + k + k * k)
        for b in batches:
            if not len(b):
                continue
            t = b.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
            p = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(t), k)
            r = np.maximum(0.0, 1.0 + p @ pull)
            out[0] += (t * r * r).sum()
            out[1 : 1 + k] += (t * r) @ p
            out[1 + k :] += ((p * (t * (r > 0))[:, None]).T @ p).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], names=["place", "x"])

    got = np.zeros(1 + k + k * k)
    for r in members.select("tokens", "p").mapInArrow(run, "place long, x double").groupBy("place").agg(F.sum("x").alias("x")).collect():
        got[r["place"]] = r["x"]
    return float(got[0]), got[1 : 1 + k], got[1 + k :].reshape(k, k)


def fit_rates(members: DataFrame, targets: list[float], rounds: int = ROUNDS, ridge: float = RIDGE) -> tuple[Column, list[list[float]]]:
    """The rate column of ``members`` (tokens, p), and the expected totals of every round.

    Raises ValueError when a targeted domain is not within ``TOLERANCE`` of its target after ``rounds``.
    """
    k = len(targets)
    wanted = np.array(targets, dtype=np.float64)
    best = F.array_position("p", F.array_max("p"))
    likeliest = {r["d"]: r["n"] for r in members.groupBy(best.alias("d")).agg(F.sum("tokens").alias("n")).collect()}  # a row per domain
    total = float(sum(n or 0 for n in likeliest.values()))
    if not total:
        return F.lit(1.0), []
    aim = np.array([wanted[i] > 0 and bool(likeliest.get(i + 1)) for i in range(k)])
    if not aim.any():
        return F.lit(1.0), []
    pull, direction, step, slope, low = np.zeros(k), np.zeros(k), 1.0, 0.0, np.inf
    seen: list[list[float]] = []
    for _ in range(rounds):
        there = pull + step * direction
        square, got, curvature = _sums(members, there)
        seen.append(got.tolist())
        off = np.where(aim, got / np.where(aim, wanted, 1.0) - 1.0, 0.0)
        if np.abs(off).max() <= TOLERANCE / 20:
            return _rate(there), seen
        spring = np.where(aim, ridge * wanted**2 / total, 0.0)
        value = square / 2 - wanted[aim] @ there[aim] + spring @ there**2 / 2
        if value > low + 1e-4 * step * slope + 1e-9 * total:
            step /= 2
            continue
        gradient = np.where(aim, got - wanted + spring * there, 0.0)
        if np.abs(gradient[aim] / wanted[aim]).max() <= TOLERANCE / 20:
            if np.abs(off).max() <= TOLERANCE:
                return _rate(there), seen
            ridge /= 10  # what holds the rates near one gives way to the targets
            spring = spring / 10
            gradient = np.where(aim, got - wanted + spring * there, 0.0)
            value = square / 2 - wanted[aim] @ there[aim] + spring @ there**2 / 2
        m = (curvature + np.diag(spring + 1e-9 * total))[np.ix_(aim, aim)]
        pull, low, step, direction = there, value, 1.0, np.zeros(k)
        direction[aim] = -np.linalg.solve(m, gradient[aim])
        slope = float(gradient @ direction)
    if np.abs(off).max() <= TOLERANCE:
        return _rate(there), seen
    raise ValueError(f"targets {wanted.tolist()} not met within {TOLERANCE} after {rounds} rounds: {seen[-1:]}")


def tempered_targets(members: DataFrame, k: int, temperature: float = TEMPERATURE) -> list[float]:
    """Token totals to the power ``temperature``, scaled so that the largest domain stays as it is: nobody is thinned out."""
    _, totals, _ = _sums(members, np.zeros(k))
    top = totals.max()
    return (top * (totals / top) ** temperature).tolist() if top > 0 else [0.0] * k


def mix(
    docs: DataFrame, labelled: DataFrame | None = None, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
    keep: tuple[str, ...] = (), weights: dict[str, float] | None = None, rounds: int = ROUNDS,
) -> tuple[DataFrame, list[str]]:
    """(id, keep, tokens, p, rate) per row of ``docs`` and the names of the domains.

    ``weights`` gives each domain's share of the mix; without it the tempered totals are the targets.
    """
    model = train_posterior(docs if labelled is None else labelled, label_col, id_col, text_col)
    members = stash(memberships(docs, model, text_col, (id_col, *keep)), "memberships")
    k = len(model.names)
    targets = tempered_targets(members, k)
    if weights is not None:
        share = np.array([weights.get(n, 0.0) for n in model.names])
        targets = (share / max(share.sum(), 1e-12) * sum(targets)).tolist()
    rate, _ = fit_rates(members, targets, rounds)
    return members.withColumn("rate", rate), model.names


def copies(rate: Column, *key: Column | str, least: int = 0) -> Column:
    """Whole number of copies, ``least`` at least, whose mean is ``rate``: a hash of ``key`` settles the fraction."""
    draw = F.pmod(F.xxhash64(F.lit("copies"), *key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.greatest(F.floor(rate + draw).cast("int"), F.lit(least))


def _report(mixed: DataFrame, names: list[str]) -> DataFrame:
    best = F.array_position(F.col("p"), F.array_max("p")).cast("int")
    return mixed.select(
        "doc_id", "tokens", "rate", copies(F.col("rate"), "doc_id").alias("copies"),
        F.element_at(F.array(*[F.lit(n) for n in names]), best).alias("domain"), F.array_max("p").alias("confidence"),
    )


def op7_mixing(spark, sf_dir):
    return _report(*mix(table(spark, sf_dir, "documents"), label_col="lang"))


def op7_mixing_to_weights(spark, sf_dir):
    """The mix with explicit, skewed weights."""
    docs = table(spark, sf_dir, "documents")
    names = [r["lang"] for r in docs.select("lang").where("lang is not null").distinct().collect()]
    return _report(*mix(docs, label_col="lang", weights={n: SKEWED.get(n, 1.0) for n in names}))
