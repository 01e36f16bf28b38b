"""Ingestion: JSON lines to accepted documents, reject counters and source statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .ranks import numbered

#: Documents of at most this many bytes are rejected.
MIN_BYTES = 10
#: Documents of fewer tokens are dropped by the token filter.
MIN_TOKENS = 20
#: Why a line gives no document, in the order in which it is asked; the writer's own errors come last.
REASONS = ("generatorReturnedNone", "missingDataKey", "data<=10", "hasDataError")


def parsed(
    lines: DataFrame, line: str = "value", data_key: str = "text", fallback: str = "raw_content",
    transform: Callable[[Column], Column] | None = None, accept: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """``lines`` with ``data``, ``meta`` (the other keys as JSON, their values as they are) and ``reason`` (null when accepted).

    The value of ``data_key`` is the document; ``fallback`` stands in when that key is missing, and the key that was
    used leaves the metadata.  ``transform`` changes the document; ``accept`` (data, meta) keeps those it is true for,
    the others have the reason ``filtered``.
    """
    whole = F.try_parse_json(F.col(line))
    fields = F.when(F.is_variant_null(whole), None).otherwise(F.try_variant_get(whole, "$", "map<string,variant>"))
    row = lines.withColumn("_fields", fields)
    named = F.map_contains_key("_fields", data_key)
    used = F.when(named, F.lit(data_key)).otherwise(F.lit(fallback))
    value = F.try_variant_get(F.when(named, F.try_element_at("_fields", F.lit(data_key))).otherwise(F.try_element_at("_fields", F.lit(fallback))), "$", "string")
    rest = F.when(F.col("_fields").isNotNull(), F.to_json(F.map_filter("_fields", lambda k, _: k != used)))
    row = row.select(*lines.columns, "_fields", (transform(value) if transform else value).alias("data"), rest.alias("meta"))
    reason = (
        F.when(F.col("_fields").isNull(), REASONS[0])
        .when(F.col("data").isNull(), REASONS[1])
        .when(F.octet_length("data") <= MIN_BYTES, REASONS[2])
    )
    if accept is not None:
        reason = reason.when(~F.coalesce(accept(F.col("data"), F.col("meta")), F.lit(False)), "filtered")
    return row.withColumn("reason", reason).drop("_fields")


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("reason is null").drop("reason")


def reject_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.where("reason is not null").groupBy(*by, "reason").agg(F.count("*").alias("n"))


def reject_report(rows: DataFrame, by: list[str]) -> DataFrame:
    """One JSON object of all counters per source, zeros included."""
    counters = F.struct(*[F.count_if(F.col("reason") == r).alias(r) for r in sorted(REASONS)])
    return rows.groupBy(*by).agg(F.to_json(counters).alias("counters"))


def with_dense_ids(rows: DataFrame, order: str, source: str = "source", name: str = "doc_key", n: int | None = None) -> DataFrame:
    """Dense ids from 0 over the accepted rows of each source, in input order."""
    return numbered(rows, order, [source], name, n)


def source_stats(rows: DataFrame, source: str = "source", data: str = "data", meta: str = "meta") -> DataFrame:
    return rows.groupBy(source).agg(
        F.count("*").alias("document_number"),
        F.sum(F.octet_length(data)).alias("data_bytes"),
        F.sum(F.octet_length(meta)).alias("meta_bytes"),
    )


def disk_bytes(spark, path: str) -> int:
    """Size of a written source, compressed as it lies."""
    return store.bytes_under(spark, path)


def default_view(stats: DataFrame, source: str = "source") -> DataFrame:
    """What the view of all sources takes of each: everything."""
    return stats.select(source, F.lit("preserved").alias("flag"), "document_number", F.col("data_bytes").alias("bytes"))


def long_enough(pretok: DataFrame, sizes: str = "sizes", least: int = MIN_TOKENS) -> DataFrame:
    """Rows whose chunk sizes add up to ``least`` tokens; rows without a chunk go too."""
    return pretok.where(F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x) >= least)


def filtered_clone(pretok: DataFrame, least: int = MIN_TOKENS, order: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A copy of a tokenised corpus without short documents: its rows under new dense keys, its statistics and its lengths."""
    from .pretok import length_table, strategy_stats

    kept = long_enough(pretok, least=least)
    return with_dense_ids(kept, order), strategy_stats(kept), length_table(kept)


def size_bytes(text: Column, unit: str = "bytes") -> Column:
    return (F.octet_length(text) if unit == "bytes" else F.length(text)).cast("long")
