"""Batch assembly: padding, packed layouts, shifts and masks as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def batch_of(index: Column, size: int) -> Column:
    return F.floor(index / size).cast("long")


def padded(ids: Column, length: int, pad: int) -> Column:
    cut = F.slice(F.coalesce(ids, F.array().cast("array<int>")), 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.lit(length) - F.size(cut)))


def pad_mask(ids: Column, pad: int) -> Column:
    """True where padded; ids that equal the pad id count as padding."""
    return F.transform(ids, lambda x: x == pad)


def unpadded(rows: DataFrame, index: str, ids: str, size: int, length: int, by: list[str] | None = None) -> DataFrame:
    """Per batch of ``size`` rows: flat ids, cumulative lengths, flat places (row * length + column) and the longest row."""
    cut = F.slice(F.coalesce(F.col(ids), F.array().cast("array<int>")), 1, length)
    key = by or []
    grouped = (
        rows.select(*key, batch_of(F.col(index), size).alias("batch"), F.col(index).alias("i"), cut.alias("ids"))
        .groupBy(*key, "batch")
        .agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("rows"))
    )  # a batch holds ``size`` rows of at most ``length`` ids
    lens = F.transform("rows", lambda r: F.size(r["ids"]))
    return grouped.select(
        *key,
        "batch",
        F.flatten(F.transform("rows", lambda r: r["ids"])).alias("flat"),
        F.aggregate(lens, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n)).alias("cu_seqlens"),
        F.flatten(
            F.transform("rows", lambda r, k: F.transform(r["ids"], lambda _, j: (k * length + j).cast("int")))
        ).alias("indices"),
        F.array_max(lens).alias("max_seq_len"),
    )


def repadded(flat: Column, indices: Column, n_rows: Column, length: int, pad: int) -> Column:
    """Rows of ``length`` ids with the flat ones at their places."""
    at = F.map_from_arrays(indices, flat)
    cell = lambda k: F.coalesce(F.try_element_at(at, k), F.lit(pad))
    return F.transform(F.sequence(F.lit(0), n_rows - 1), lambda r: F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda j: cell((r * length + j).cast("int"))))


def valid(ids: Column, mask: Column) -> Column:
    """Ids outside the mask (true where padded)."""
    return F.transform(F.filter(F.arrays_zip(ids.alias("v"), mask.alias("m")), lambda z: ~z["m"]), lambda z: z["v"])


def inputs_targets(ids: Column) -> tuple[Column, Column]:
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.slice(ids, F.lit(1), n), F.slice(ids, F.lit(2), n)


def prediction_places(ids: Column, pad: int, cloze: Column | None = None) -> Column:
    """Where a loss is taken: masked tokens that are not padding, or, without ``cloze``, every token whose next is none."""
    if cloze is not None:
        return F.zip_with(ids, cloze, lambda x, c: c & (x != pad))
    return F.transform(F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0))), lambda x: x != pad)


def recurrence_mask(rows: DataFrame, index: str, flag: str, size: int) -> DataFrame:
    """Per batch the flags, missing ones false; null where all are missing."""
    g = rows.groupBy(batch_of(F.col(index), size).alias("batch")).agg(
        F.array_sort(F.collect_list(F.struct(index, F.coalesce(flag, F.lit(False)).alias("f")))).alias("r"), F.bool_or(F.col(flag).isNotNull()).alias("some")
    )
    return g.select("batch", F.when(F.col("some"), F.transform("r", lambda x: x["f"])).alias("recurrence_mask"))


def unpadded_with(ids: Column, mask: Column, **more: Column) -> Column:
    """struct of the ids outside the mask and of every array in ``more`` at the same places."""
    places = F.filter(F.transform(mask, lambda m, i: F.when(~m, i)), lambda i: i.isNotNull())
    at = lambda c: F.transform(places, lambda i: F.get(c, i))
    return F.struct(at(ids).alias("ids"), *[at(c).alias(name) for name, c in more.items()])


def any_finished(rows: DataFrame, index: str, flag: str, size: int) -> DataFrame:
    """Per batch whether any of its workers has finished."""
    return rows.groupBy(batch_of(F.col(index), size).alias("batch")).agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias("worker_has_finished"))


def rank_states(states: DataFrame, world: int) -> tuple[DataFrame, int]:
    """The last state of every rank below ``world``, and the number of ranks that were saved (it may differ)."""
    last = states.groupBy("rank").agg(F.max_by(F.struct(*[c for c in states.columns if c != "rank"]), "saved_at").alias("s")).select("rank", "s.*")
    return last.where(F.col("rank") < world), last.count()


def steps_per_epoch(n: Column, size: int, accumulate: int = 1, nodes: int = 1) -> Column:
    return F.floor(F.floor(F.ceil(n / size) / accumulate) / nodes).cast("long")
