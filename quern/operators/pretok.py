"""Stored tokenisations: sizes, spans, chunk composition, statistics and length tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunking import spans

MULTIPLIERS = 100


def checked_sizes(sizes: Column, tokens: Column, limit: int) -> Column:
    """``sizes``, or an error where they do not add up to the tokens or exceed the limit."""
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    wrong = (total != F.size(tokens)) | (F.coalesce(F.array_max(sizes), F.lit(0)) > limit)
    return F.when(wrong, F.raise_error(F.lit("chunk sizes do not fit the tokens")).cast("array<int>")).otherwise(sizes)


def chunked(tokens: Column, sizes: Column, bos: int | None, eos: int | None) -> Column:
    """Chunks of token ids, each within its own begin and end ids."""
    head = [F.array(F.lit(bos))] if bos is not None else []
    tail = [F.array(F.lit(eos))] if eos is not None else []
    return F.transform(spans(sizes), lambda s: F.concat(*head, F.slice(tokens, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), *tail))


def judged(docs: DataFrame, strategy: dict, tokens: Column, sizes: Column, source: str = "source", by: str = "doc_id") -> DataFrame:
    """Documents of many sources tokenised in one job: (by, source, tokens, sizes, failure), the last null where they fit the strategy."""
    from .catalog import MissingDataKey, MissingSplitterOutput

    wanted = strategy.get("required_databases", [])
    missing = [c for c in wanted if c not in docs.columns]
    if missing:
        raise MissingDataKey(", ".join(missing))
    returned = {"tokens": tokens, "chunks": sizes}
    lacking = [k for k in strategy.get("returns", ["tokens", "chunks"]) if returned.get(k) is None]
    if lacking:
        raise MissingSplitterOutput(", ".join(lacking))
    rows = docs.select(by, source, tokens.alias("tokens"), sizes.alias("sizes"))
    total = lambda r: F.aggregate(r["sizes"], F.lit(0).cast("long"), lambda a, x: a + x)
    failure = lambda r: (
        F.when(r["tokens"].isNull() | r["sizes"].isNull(), "no output")
        .when(F.size(r["tokens"]) == 0, "no tokens")
        .when(total(r) != F.size(r["tokens"]), "chunks do not cover the tokens")
        .when(F.array_max(r["sizes"]) > strategy["chunk_size"], "a chunk is too large")
    )
    # Bound to a name, so that a filter moved below makes tokens and sizes once and not at each mention.
    return rows.withColumn("failure", F.transform(F.array(F.struct("tokens", "sizes")), failure)[0])


def pretokenised(docs: DataFrame, strategy: dict, tokens: Column, sizes: Column, source: str = "source", by: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``judged`` parted: (by, source, tokens, sizes) of those that fit the strategy, and (by, source, failure) of the others."""
    rows = judged(docs, strategy, tokens, sizes, source, by)
    return rows.where("failure is null").drop("failure"), rows.where("failure is not null").select(by, source, "failure")


def merged_corpora(parts: list[DataFrame], segment: int, seed: int = 27, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Tokenised corpora as one in permuted order: per document its place, chunks and tokens modulo the segment; and totals,
    mean chunks (rounded down) and sequences for multipliers 1 to 8."""
    from functools import reduce

    from .permute import Permutation
    from .ranks import numbered

    rows = [p.select(F.lit(k).alias("part"), "doc_id", F.size("sizes").alias("chunks"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens")) for k, p in enumerate(parts)]
    every = reduce(DataFrame.unionByName, rows)
    n = every.count() if n is None else n
    order = every.withColumn("_k", F.col("part").cast("long") * (1 << 40) + F.col("doc_id"))
    placed = numbered(order, "_k", [], "g", n).withColumn("pos", Permutation.draw(n).position(F.col("g")) if n else F.col("g")).withColumn("tail", F.pmod("tokens", F.lit(segment)))
    sums = [F.coalesce(F.sum(F.ceil(F.col("chunks") / j)), F.lit(0)).cast("long").alias(f"length_{j}") for j in range(1, 9)]
    totals = every.agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"), F.sum("tokens").alias("tokens"), F.expr("sum(chunks) div greatest(count(*), 1)").alias("mean_chunks"), *sums)
    return placed.drop("_k", "tokens"), totals


def strategy_stats(pretok: DataFrame, source: str = "source") -> DataFrame:
    n_tokens = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    return pretok.select(source, n_tokens.alias("t"), F.size("sizes").alias("c")).groupBy(source).agg(
        F.sum("t").alias("total_tokens"), F.max("t").alias("max_tokens"), F.sum("c").alias("total_chunks"),
        F.max("c").cast("long").alias("max_chunks"), F.count("*").alias("processed_docs"),
    )


def length_table(pretok: DataFrame, source: str = "source", top: int = MULTIPLIERS) -> DataFrame:
    """Sequences per source for every multiplier: a histogram of chunk counts first, the multipliers after."""
    counts = pretok.groupBy(source, F.size("sizes").alias("k")).agg(F.count("*").alias("n")).where("k > 0")
    return (
        counts.withColumn("multiplier", F.explode(F.sequence(F.lit(1), F.lit(top))))
        .groupBy(source, "multiplier")
        .agg(F.sum(F.ceil(F.col("k") / F.col("multiplier")) * F.col("n")).cast("long").alias("precomputed_length"))
    )
