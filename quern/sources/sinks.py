"""Sinks: JSON lines, partitioned corpora and templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object per row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    json_lines(rows).write.text(path)


def write_corpus(docs: DataFrame, path: str, codec: str = "zstd") -> None:
    """Documents as one partition per source; readers skip the sources they do not name."""
    docs.write.option("compression", codec).partitionBy("source").parquet(path)


def write_ranked(rows: DataFrame, path: str, rank: str = "rank") -> None:
    """What each rank was given, as JSON lines in a folder per rank."""
    rows.write.mode("append").partitionBy(rank).json(path)


def view_template(name: str, sources: list[str]) -> dict:
    return {"view_name": name, "selection": {s: "preserved" for s in sources}, "shuffle": True}
