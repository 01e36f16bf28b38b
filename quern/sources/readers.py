"""Sources: files to rows.  Each reader is lazy and splits its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file): raw lines, so that bad ones can be counted."""
    return spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))


def folder(spark: SparkSession, path: str, pattern: str = "*.jsonl", recursive: bool = False) -> DataFrame:
    """One source per file, named by its stem."""
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.text(path).select("value", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("source"))


def labelled(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Labelled rows by suffix: csv, tsv, json (one document), jsonl or parquet."""
    kind = path.rpartition(".")[2].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("csv", "tsv"):
        return reader.option("header", True).option("multiLine", True).option("escape", '"').option("sep", "\t" if kind == "tsv" else ",").csv(path)
    if kind == "json":
        return reader.option("multiLine", True).json(path)
    if kind == "jsonl":
        return reader.json(path)
    if kind == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unsupported type: {kind}")


def conll(spark: SparkSession, path: str, universal: bool = True) -> DataFrame:
    """(file, sentence, tokens, tags): blank and # lines end a sentence, ids with a dash are skipped.

    Tags are column 4 of CoNLL-U and column 5 of older files.  A file is one task's work.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    ends = F.col("line").rlike(r"^\s*$|^#")
    own = Window.partitionBy("file").orderBy("n")
    marked = lines.withColumn("sentence", F.sum(ends.cast("int")).over(own)).where(~ends)
    cells = F.split("line", "\t")
    rows = marked.select("file", "sentence", "n", F.get(cells, 0).alias("id"), F.get(cells, 1).alias("token"), F.get(cells, 3 if universal else 4).alias("tag"))
    kept = rows.where(~F.contains("id", F.lit("-")) & F.col("tag").isNotNull())
    grouped = kept.groupBy("file", "sentence").agg(F.array_sort(F.collect_list(F.struct("n", "token", "tag"))).alias("r"))
    return grouped.select("file", "sentence", F.transform("r", lambda x: x["token"]).alias("tokens"), F.transform("r", lambda x: x["tag"]).alias("tags"))


def discovered(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders under ``path``, each a corpus of its own."""
    from ..operators import store

    return [n for n in store.children(spark, path) if store.children(spark, f"{path}/{n}") and not n.startswith((".", "_"))]


def united(parts: list[DataFrame]) -> DataFrame:
    """Sources of several formats as one; columns that a part lacks are null."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


FORMATS = {"jsonl": json_lines, "parquet": lambda s, p: s.read.parquet(p), "csv": labelled, "tsv": labelled, "labelled": labelled, "text": lambda s, p: s.read.text(p, wholetext=True)}


def open_source(spark: SparkSession, kind: str, path: str) -> DataFrame:
    if kind not in FORMATS:
        raise ValueError(f"unsupported source type: {kind}")
    return FORMATS[kind](spark, path)
