"""Views: named selections of a corpus in a reproducible shuffled order.

A view is made of narrow rows (source, numbers, sizes); texts are joined to what
it has selected, by those who read it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .permute import Permutation
from .ranks import numbered, with_prefixes


class NameAlreadyUsed(ValueError):
    pass


_UNITS = {"K": 1024, "M": 1024**2, "G": 1024**3, "T": 1024**4}


@dataclass(frozen=True)
class Take:
    """How much of a source a view takes: kind is preserved, skipped, count, fraction or bytes."""

    kind: str
    amount: float = 0

    @classmethod
    def parse(cls, value: str | int | float) -> Take:
        if isinstance(value, str):
            text = value.strip()
            if text in ("preserved", "skipped"):
                return cls(text)
            if text and text[-1].upper() in _UNITS:
                amount = int(float(text[:-1]) * _UNITS[text[-1].upper()])
                if amount < 0:
                    raise ValueError(f"negative size: {value}")
                return cls("bytes", amount)
            raise ValueError(f"invalid selection: {value!r}")
        if isinstance(value, bool) or value < 0:
            raise ValueError(f"invalid selection: {value!r}")
        if isinstance(value, int):
            return cls("count", value)
        if value > 1:
            raise ValueError(f"a fraction above one: {value}")
        return cls("fraction", value)


MAX_SOURCES = 65_535


def sources_of(docs: DataFrame, source: str = "source") -> DataFrame:
    """One row per source: source_id from 1 by name, its rows and the rows of all sources before it."""
    rows = source_rows(docs, source)
    return docs.sparkSession.createDataFrame(rows, f"{source} string, source_id int, n long, offset long")


def source_rows(docs: DataFrame, source: str = "source") -> list[tuple[str, int, int, int]]:
    """The same as a list; there are at most ``MAX_SOURCES``."""
    counts = docs.groupBy(source).agg(F.count("*").alias("n"))
    rows = sorted((r[0], r[1]) for r in counts.limit(MAX_SOURCES + 1).collect())
    if len(rows) > MAX_SOURCES:
        raise ValueError("more than 65,535 sources")
    out, offset = [], 0
    for k, (name, n) in enumerate(rows, 1):
        out.append((name, k, n, offset))
        offset += n
    return out


def indexed(docs: DataFrame, sources: DataFrame, key: str = "doc_id", source: str = "source", n: int | None = None) -> DataFrame:
    """``docs`` with source_id, doc_key (dense within the source) and the global index g."""
    keyed = numbered(docs, key, [source], "doc_key", n)
    return keyed.join(F.broadcast(sources.select(source, "source_id", "offset")), source).withColumn("g", F.col("offset") + F.col("doc_key")).drop("offset")


def located(index: DataFrame, sources: list[tuple[str, int, int, int]], g: str = "g") -> DataFrame:
    """The reverse: source and doc_key of global indexes, by a search in the sorted offsets of ``source_rows``."""
    offsets = np.array([r[3] for r in sources if r[2]], dtype=np.int64)
    ids = np.array([r[1] for r in sources if r[2]], dtype=np.int32)

    @F.arrow_udf("int")
    def source_of(places: pa.Array) -> pa.Array:
        at = np.searchsorted(offsets, places.to_numpy(zero_copy_only=False), side="right") - 1
        return pa.array(ids[at])

    total = sum(r[2] for r in sources)
    small = index.sparkSession.createDataFrame([(r[0], r[1], r[3]) for r in sources], "source string, source_id int, offset long")
    within = index.where((F.col(g) >= 0) & (F.col(g) < total)).withColumn("source_id", source_of(F.col(g)))
    return within.join(F.broadcast(small), "source_id").withColumn("doc_key", F.col(g) - F.col("offset")).drop("offset")


def shuffled(index: DataFrame, n: int, seed: int = 27) -> DataFrame:
    return index.withColumn("pos", Permutation.draw(n, seed).position(F.col("g")))


def materialised(view: DataFrame, partitions: int) -> DataFrame:
    """Laid out by position, so that reading in order is reading sequentially."""
    return view.repartitionByRange(partitions, "pos").sortWithinPartitions("pos")


def source_scan(index: DataFrame, source: str, n: int | None = None, seed: int | None = None) -> DataFrame:
    """The rows of one source with ``at``, their place: by doc_key, or permuted over the ``n`` rows of the source."""
    own = index.where(F.col("source") == source)
    if seed is None:
        return own.withColumn("at", F.col("doc_key"))
    n = own.count() if n is None else n
    return own.withColumn("at", Permutation.draw(n, seed).position(F.col("doc_key"))) if n else own.withColumn("at", F.col("doc_key"))


def sequential(index: DataFrame) -> DataFrame:
    """The unshuffled order: source by source, each by doc_key; that is the global index."""
    return index.withColumn("pos", F.col("g"))


def document(index: DataFrame, source: str, key: int) -> DataFrame:
    """Random access to one document: a filter that reaches the scan of a corpus laid out by source and key."""
    return index.where((F.col("source") == source) & (F.col("doc_key") == key))


def first_of_each(view: DataFrame, limit: Column, size: Column | None = None, n: int | None = None) -> DataFrame:
    """Rows whose number within the source (or whose size of all before it) is below ``limit``, in shuffled order."""
    value = F.lit(1) if size is None else size
    return with_prefixes(view, "pos", ["source"], {"_taken": value}, n).where(F.col("_taken") < limit).drop("_taken")


def select(view: DataFrame, selection: dict[str, str | int | float], sources: list[str], unit: Column | None = None, n: int | None = None) -> DataFrame:
    """The rows a selection takes.  It must name all sources and no other.

    ``unit`` is what a size counts; without it the column ``n_bytes`` or the bytes of ``text``.
    """
    if set(selection) != set(sources):
        raise ValueError(f"the selection must name exactly the sources; it differs in {sorted(set(selection) ^ set(sources))}")
    takes = {k: Take.parse(v) for k, v in selection.items()}
    wanted = [(k, t.kind, float(t.amount)) for k, t in takes.items() if t.kind != "skipped"]
    spark = view.sparkSession
    if not wanted:
        return view.limit(0)
    table = spark.createDataFrame(wanted, "source string, _kind string, _amount double")
    size = unit if unit is not None else F.col("n_bytes") if "n_bytes" in view.columns else F.octet_length("text")
    rows = view.join(F.broadcast(table), "source")
    rows = with_prefixes(rows, "pos", ["source"], {"_rank": F.lit(1), "_before": F.coalesce(size, F.lit(0))}, n)
    counted = rows.withColumn("_n", F.count("*").over(Window.partitionBy("source"))) if _one_bucket(n) else rows.join(
        F.broadcast(rows.groupBy("source").agg(F.count("*").alias("_n"))), "source"
    )  # at most a row per source
    keep = (
        F.when(F.col("_kind") == "preserved", True)
        .when(F.col("_kind") == "count", F.col("_rank") < F.col("_amount"))
        .when(F.col("_kind") == "fraction", F.col("_rank") < F.floor(F.col("_n") * F.col("_amount")))
        .when(F.col("_kind") == "bytes", F.col("_before") < F.col("_amount"))
    )
    return counted.where(keep).select(*view.columns)


def _one_bucket(n: int | None) -> bool:
    from .ranks import IN_BUCKET

    return n is not None and n <= IN_BUCKET


def compacted(view: DataFrame, n: int | None = None) -> DataFrame:
    """Dense positions: rejected rows take no slot."""
    return numbered(view.withColumnRenamed("pos", "_pos"), "_pos", [], "pos", n).drop("_pos")


def view_stats(view: DataFrame, size: Column) -> DataFrame:
    return view.groupBy("source").agg(F.count("*").alias("document_number"), F.sum(size).alias("bytes"))


def head(view: DataFrame, n: int, total: int, name: str | None = None, taken: set[str] = frozenset()) -> DataFrame:
    """The first n entries of a view."""
    if n > total:
        raise ValueError(f"the view has {total} entries, not {n}")
    if name in taken:
        raise NameAlreadyUsed(name)
    return view.where(F.col("pos") < n)


def head_sources(view: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """Per source what a head view takes: partial with its count, or skipped."""
    counts = view.where(F.col("pos") < n).groupBy("source").agg(F.count("*").alias("document_number"))
    return sources.select("source").join(counts, "source", "left").select(
        "source", F.coalesce("document_number", F.lit(0)).alias("document_number"), F.col("document_number").isNull().alias("is_skipped")
    )
