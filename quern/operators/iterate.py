"""Iteration as relations: sequences of chunks, ranks, lengths, resumption and the recurrence schedule."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = 840


def multiplier(max_seq_len: int, chunk_size: int) -> int:
    if max_seq_len % chunk_size:
        raise ValueError(f"{max_seq_len} is no multiple of {chunk_size}")
    return max_seq_len // chunk_size


def sequences(view: DataFrame, chunks: str, m: int, limit: int | None = None) -> DataFrame:
    """One row per sequence: m chunks in a row joined (never across documents), cut to ``limit``.  Keyed by (pos, step)."""
    steps = F.sequence(F.lit(0), F.ceil(F.size(chunks) / m).cast("int") - 1)
    rows = view.where(F.size(chunks) > 0).withColumn("step", F.explode(steps))
    ids = F.flatten(F.slice(F.col(chunks), F.col("step") * m + 1, F.lit(m)))
    return rows.withColumn("ids", ids if limit is None else F.slice(ids, 1, limit)).drop(chunks)


def unit_groups(rows: DataFrame, units: str, size: int, name: str = "group") -> DataFrame:
    """One row per ``size`` units in a row (bytes, tokens or patches, whatever the array or binary holds); the last group may be shorter."""
    whole = F.col(units)
    if rows.schema[units].dataType.typeName() == "binary":
        n, part = F.octet_length(whole), lambda k: F.substring(whole, k * size + 1, F.lit(size))
    else:
        n, part = F.size(whole), lambda k: F.slice(whole, k * size + 1, F.lit(size))
    steps = F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1)
    # The groups are cut before they become rows: no row carries the whole array.
    parts = F.transform(steps, lambda k: F.struct(k.alias("k"), part(k).alias("part")))
    every = rows.where(n > 0).select("*", F.explode(parts).alias("_g"))
    return every.select(*[F.col("_g.part").alias(c) if c == units else c for c in rows.columns], F.col("_g.k").alias(name))


def sample_numbers(rows: DataFrame, by: str = "pos", then: str = "step", name: str = "i") -> DataFrame:
    """Samples numbered in reading order, so that ranks can share them one by one instead of document by document."""
    from .ranks import numbered

    return numbered(rows, by, [], name, ties=[then])


def with_metadata(rows: DataFrame, docs: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """Rows with columns of their documents; a name that the rows have already stays theirs."""
    return rows.join(docs.select(key, *[c for c in columns if c not in rows.columns]), key, "left")


def lengths(view: DataFrame, n_chunks: Column, m: int, world: int) -> DataFrame:
    """One row: documents, sequences of m chunks, the most that one rank has, and what all ranks give out with their fillers."""
    steps = F.ceil(n_chunks / m).cast("long")
    ranks = view.groupBy(rank_of(F.col("pos"), world).alias("rank")).agg(F.count("*").alias("d"), F.sum(steps).alias("s"))
    longest_ = F.coalesce(F.max("s"), F.lit(0))
    return ranks.agg(
        F.coalesce(F.sum("d"), F.lit(0)).alias("documents"), F.coalesce(F.sum("s"), F.lit(0)).alias("sequences"),
        longest_.alias("per_rank"), (longest_ * world).alias("given_out"),
    )


def strategy_totals(tokenised: DataFrame, sequences_: DataFrame, view_sources: DataFrame, strategy: str, view: str, max_seq_len: int, chunk_size: int) -> dict:
    """What a view holds under a strategy, from the registry's tables: tokens, chunks and sequences of ``max_seq_len``."""
    m = multiplier(max_seq_len, chunk_size)
    own = view_sources.where((F.col("view") == view) & (F.col("flag") != "skipped")).select("source_no")
    total = tokenised.where(F.col("strategy") == strategy).join(own, "source_no").agg(F.sum("tokens").alias("t"), F.sum("chunks").alias("c")).first()
    n = sequences_.where((F.col("strategy") == strategy) & (F.col("multiplier") == m)).join(own, "source_no").agg(F.sum("n")).first()[0]
    return {"multiplier": m, "tokens": total["t"] or 0, "chunks": total["c"] or 0, "sequences": n or 0}


def rank_of(pos: Column, world: int) -> Column:
    return F.pmod(pos, F.lit(world))


def shard_counts(view: DataFrame, n_chunks: Column, m: int, shards: int = SHARDS) -> DataFrame:
    """Sequences per shard, where entry i of the view belongs to shard i mod ``shards``."""
    return view.groupBy(rank_of(F.col("pos"), shards).alias("worker_id")).agg(F.sum(F.ceil(n_chunks / m)).cast("long").alias("chunk_count"))


def rebucketed(counts: DataFrame, world: int, shards: int = SHARDS) -> DataFrame:
    """Lengths for fewer workers from those of ``shards``: their number must divide it."""
    if shards % world:
        raise ValueError(f"{world} does not divide {shards}")
    return counts.groupBy(rank_of(F.col("worker_id"), world).alias("rank")).agg(F.sum("chunk_count").alias("chunk_count"))


def longest(counts: DataFrame) -> DataFrame:
    return counts.agg(F.max("chunk_count").alias("steps"))


def fillers(counts: DataFrame) -> DataFrame:
    """(rank, at): the entries that shorter ranks give out after their end, marked as finished."""
    # At most a row per rank: all of them in one array beside their largest.
    rows = counts.agg(F.max("chunk_count").alias("top"), F.collect_list(F.struct("rank", "chunk_count")).alias("r"))
    short = rows.select("top", F.explode("r").alias("r")).select("top", "r.*").where("chunk_count < top")
    return short.select("rank", F.explode(F.expr("sequence(chunk_count, top - 1)")).alias("at"), F.array(F.lit(0)).alias("ids"), F.lit(True).alias("worker_has_finished"))


def resumed(rows: DataFrame, pos: int, step: int = 0) -> DataFrame:
    """What is left after (pos, step): the rest of the document that was being read is kept."""
    return rows.where((F.col("pos") > pos) | ((F.col("pos") == pos) & (F.col("step") >= step)))


def cells(steps: list[int], width: int, drain: bool = False) -> list[tuple[int, int, int]]:
    """(time, document, step) of ``width`` cells taking turns; each walks one document and then takes the next.

    Without ``drain`` all stop when a cell needs a document and none is left.
    """
    queue = [k for k, n in enumerate(steps) if n > 0]
    ready = [(c, c) for c in range(min(width, max(width, 1)))]
    heapq.heapify(ready)
    current: dict[int, tuple[int, int]] = {}
    out, at = [], 0
    while ready:
        t, cell = heapq.heappop(ready)
        doc, step = current.get(cell, (-1, 0))
        if doc < 0 or step >= steps[doc]:
            if at >= len(queue):
                if not drain:
                    break
                continue
            doc, step = queue[at], 0
            at += 1
        out.append((t, doc, step))
        current[cell] = (doc, step + 1)
        heapq.heappush(ready, (t + width, cell))
    return out


def recurrence_schedule(view: DataFrame, n_steps: Column, width: int, world: int = 1, drain: bool = False) -> DataFrame:
    """(rank, t, pos, step, is_same_document): the order in which each rank's cells read its documents.

    Only positions and step counts are scheduled, one rank a task; tokens are joined afterwards.
    """

    def plan(pdf):
        import pandas as pd

        pdf = pdf.sort_values("pos")
        rows = cells(pdf["n"].tolist(), width, drain)
        pos = pdf["pos"].to_numpy()
        rank = int(pdf["rank"].iloc[0])
        return pd.DataFrame(
            [(rank, t, int(pos[d]), s, s > 0) for t, d, s in rows], columns=["rank", "t", "pos", "step", "is_same_document"]
        )

    slim = view.select("pos", n_steps.cast("int").alias("n"), rank_of(F.col("pos"), world).alias("rank"))
    return slim.groupBy("rank").applyInPandas(plan, "rank long, t long, pos long, step int, is_same_document boolean")
