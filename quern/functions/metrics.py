"""Numeric functions: moments, norms, losses, schedules, logits and small reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moments(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Population moments, skewness and excess kurtosis."""
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.var_pop(value).alias("var"), F.stddev_pop(value).alias("std"),
        F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"), F.count(value).alias("n"),
    )


def frobenius(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def spectral(df: DataFrame, vector: str, width: int) -> DataFrame:
    """Frobenius and spectral norm, stable and effective rank of a matrix whose rows are vectors.

    The width x width matrix of products is one distributed sum; only that leaves the executors.
    """
    import numpy as np
    import pyarrow as pa

    def products(batches):
        g = np.zeros((width, width))
        for b in batches:
            x = b.column(0).flatten().fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
            g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(g.size)), pa.array(g.ravel())], names=["place", "x"])

    rows = df.select(F.col(vector).alias("v")).where(F.size("v") == width)
    got = rows.mapInArrow(products, "place long, x double").groupBy("place").agg(F.sum("x").alias("x")).collect()
    g = np.zeros(width * width)
    for r in got:
        g[r["place"]] = r["x"]
    g = g.reshape(width, width)
    s = np.sqrt(np.maximum(np.linalg.eigvalsh(g), 0))
    total = float((s**2).sum())
    p = s[s > 0] / s.sum() if s.sum() else np.ones(1)
    row = (math.sqrt(total), float(s[-1]), total / max(float(s[-1]) ** 2, 1e-30), float(np.exp(-(p * np.log(p)).sum())))
    return df.sparkSession.createDataFrame([row], "frobenius double, spectral double, stable_rank double, effective_rank double")


def layer_of(name: Column) -> Column:
    found = F.regexp_extract(name, r"\.layers\.(\d+)", 1)
    return F.when(found == "", F.lit(-1)).otherwise(found.cast("int"))


def family_of(name: Column) -> Column:
    # Parts of parameter names and what they belong to.
    return F.when(name.contains("attn"), "attention").when(name.contains("mlp"), "mlp").when(name.contains("lm_head"), "lm_head").when(name.contains("embed"), "embedding").otherwise("other")


def bits_per_byte(loss: Column, batch: Column, n_bytes: Column) -> Column:
    """Summed loss per byte in bits; infinite without bytes."""
    total = F.sum(n_bytes)
    return F.when(total == 0, F.lit(float("inf"))).otherwise(F.sum(loss * batch) / (F.lit(math.log(2)) * F.when(total != 0, total)))


def accuracy(guess: Column, truth: Column) -> Column:
    return F.avg((guess == truth).cast("double"))


def perplexity(nll: Column) -> Column:
    return F.exp(F.avg(nll))


def f1_scores(df: DataFrame, guess: str, truth: str) -> DataFrame:
    """(class, f1) from one pass of confusion counts; a class that never occurs has f1 zero."""
    cells = df.groupBy(guess, truth).agg(F.count("*").alias("n"))
    side = lambda c, name: cells.groupBy(F.col(c).alias("class")).agg(F.sum("n").alias(name))
    hit = cells.where(F.col(guess) == F.col(truth)).select(F.col(truth).alias("class"), F.col("n").alias("hit"))
    both = side(guess, "guessed").join(side(truth, "there"), "class", "full").join(hit, "class", "left").na.fill(0)
    return both.select("class", (2 * F.col("hit") / F.greatest(F.col("guessed") + F.col("there"), F.lit(1))).alias("f1"))


def macro_f1(df: DataFrame, guess: str, truth: str) -> DataFrame:
    """Mean of the classes' scores."""
    return f1_scores(df, guess, truth).agg(F.avg("f1").alias("macro_f1"))


def cross_entropy(p_true: Column, valid: Column) -> Column:
    return F.avg(F.when(valid, -F.ln(p_true)))


def focal(p_true: Column, valid: Column, gamma: float = 2.0, alpha: float = 1.0) -> Column:
    return F.avg(F.when(valid, -alpha * F.pow(1 - p_true, F.lit(gamma)) * F.ln(p_true)))


def binary_cross_entropy(logit: Column, label: Column, valid: Column, positive: float = 1.0) -> Column:
    """Mean over valid rows, from logits: ``positive`` weighs the rows of label 1.  Large logits of either sign are safe."""
    softplus = lambda z: F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    y = label.cast("double")
    return F.avg(F.when(valid, positive * y * softplus(-logit) + (1 - y) * softplus(logit)))


def _known(label: Column) -> Column:
    return label.isNotNull() & ~F.isnan(label.cast("double"))


def squared_error(guess: Column, label: Column) -> Column:
    """Mean over the rows that have a label; zero if none has."""
    return F.coalesce(F.avg(F.when(_known(label), (guess - label) * (guess - label))), F.lit(0.0))


def absolute_error(guess: Column, label: Column) -> Column:
    return F.coalesce(F.avg(F.when(_known(label), F.abs(guess - label))), F.lit(0.0))


def entropy(probabilities: Column) -> Column:
    return F.aggregate(probabilities, F.lit(0.0), lambda a, p: a - p * F.ln(p + F.lit(1e-10)))


def learning_rate(step: Column, total: int, warmup: float, hold: float, end: float, kind: str = "cosine", power: float = 2.0, anneal_at: int | None = None, anneal: float = 1.0) -> Column:
    """Factor of the learning rate: warm-up, hold, decay and, from ``anneal_at`` on, a second decay from ``anneal``."""
    up, flat = int(warmup * total), int(hold * total)

    def decay(p: Column, s: float) -> Column:
        if kind == "linear":
            return F.lit(s) + (end - s) * p
        if kind == "polynomial":
            return F.lit(end) + (s - end) * F.pow(1 - p, F.lit(power))
        if kind == "constant":
            return F.lit(s)
        return F.lit(end) + (s - end) * 0.5 * (1 + F.cos(math.pi * p))

    p = F.least((step - up - flat) / float(max(1, total - up - flat)), F.lit(1.0))
    main = F.when(step < up, step / float(max(1, up))).when(step < up + flat, F.lit(1.0)).otherwise(decay(p, 1.0))
    if anneal_at:
        late = F.least((step - anneal_at) / float(max(1, total - anneal_at)), F.lit(1.0))
        main = F.when(step >= anneal_at, decay(late, anneal)).otherwise(main)
    return main


def filtered_logits(logits: DataFrame, by: list[str], token: str, logit: str, temperature: float = 1.0, top_k: int = 0, top_p: float = 1.0) -> DataFrame:
    """Tokens left per row group by temperature, the k largest and the smallest set that holds ``top_p``.

    The first token that goes beyond ``top_p`` stays.
    """
    order = Window.partitionBy(*by).orderBy(F.desc(logit), token)
    rows = logits.withColumn(logit, F.col(logit) / temperature).withColumn("_rank", F.row_number().over(order))
    if top_k > 0:
        rows = rows.where(F.col("_rank") <= top_k)
    if top_p < 1.0:
        high = F.max(logit).over(Window.partitionBy(*by))
        rows = rows.withColumn("_e", F.exp(F.col(logit) - high))
        before = F.coalesce(F.sum("_e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rows = rows.withColumn("_p", before / F.sum("_e").over(Window.partitionBy(*by))).where(F.col("_p") <= top_p).drop("_e", "_p")
    return rows.drop("_rank")


def penalised(logit: Column, seen: Column, penalty: float) -> Column:
    return F.when(~seen, logit).when(logit < 0, logit * penalty).otherwise(logit / penalty)


def banned_next(ids: Column, n: int) -> Column:
    """Tokens that would end an n-gram which the sequence has already: those that followed its last n - 1 ids before."""
    if n < 1:
        raise ValueError("an n-gram has at least one token")
    last = F.slice(ids, F.greatest(F.size(ids) - n + 2, F.lit(1)), F.lit(n - 1))
    starts = F.sequence(F.lit(1), F.size(ids) - n + 1)
    same = F.filter(starts, lambda k: F.slice(ids, k, F.lit(n - 1)) == last)
    found = F.array_sort(F.array_distinct(F.transform(same, lambda k: F.element_at(ids, k + n - 1))))
    return F.when(F.size(ids) >= n, found).otherwise(F.slice(ids, 1, 0))


def chunk_report(tokens: DataFrame, by: str, index: str, hit: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Accuracy of each chunk of ``size`` tokens, and per ``by`` the mean, best and worst chunk (the first of equals)."""
    chunks = tokens.groupBy(by, F.floor(F.col(index) / size).cast("long").alias("chunk")).agg(F.avg(F.col(hit).cast("double")).alias("accuracy"), F.count("*").alias("n"))
    report = chunks.groupBy(by).agg(
        F.count("*").alias("chunks"), F.sum("n").alias("tokens"), F.avg("accuracy").alias("mean_accuracy"),
        F.max_by("chunk", F.struct("accuracy", -F.col("chunk"))).alias("best"), F.min_by("chunk", F.struct("accuracy", "chunk")).alias("worst"),
    )
    return chunks, report


def resumed_checkpoint(found: DataFrame, version: int | None = None, at_least: int | None = None) -> DataFrame:
    """One row or none of (version, step, name): the last step of the version (the latest without one), or the closest step
    from ``at_least`` on; where no step is that large, the smallest there is."""
    rows = found.where("version is not null and step is not null")
    own = rows.where(F.col("version") == version) if version is not None else rows.join(rows.agg(F.max("version").alias("version")), "version")
    if at_least is None:
        return own.orderBy(F.desc("step"), "name").limit(1).select("version", "step", "name")
    return own.orderBy(F.col("step") < at_least, "step", "name").limit(1).select("version", "step", "name")


def size_text(n: Column) -> Column:
    """A number of bytes in words, by 1024."""
    # Units in rising order.
    out = F.format_string("%.2f PB", n / F.lit(1024.0**5))
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        out = F.when(n < 1024.0 ** (k + 1), F.format_string(f"%.2f {unit}", n / F.lit(1024.0**k))).otherwise(out)
    return out


def parsed_size(text: Column) -> Column:
    """Bytes from a number with an optional unit of K, M, G, T or P; what is no number is zero."""
    t = F.upper(F.trim(text))
    unit = F.instr(F.lit("KMGTP"), F.right(t, F.lit(1)))
    has = (F.length(t) > 0) & (unit > 0)
    number = F.regexp_replace(t, "[KMGTP]$", "")
    return F.coalesce((number.try_cast("double") * F.pow(F.lit(1024.0), F.when(has, unit).otherwise(0))).cast("long"), F.lit(0).cast("long"))


def checkpoint_of(name: Column, model: str, extension: str = ".ckpt") -> tuple[Column, Column]:
    """Version and step from ``<model>_v<version>_s<step>``; null where the name does not fit."""
    pattern = rf"^{model}_v(\d+)_s(\d+)\{extension}$"
    return F.regexp_extract(name, pattern, 1).try_cast("int"), F.regexp_extract(name, pattern, 2).try_cast("int")


def grid(spark, options: dict[str, list]) -> DataFrame:
    """One row per combination of the options' values; the lists are the caller's configuration."""
    df = spark.range(1).select()
    for name, values in options.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df
