"""What the operators share: word rule, written intermediate tables, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than these; the same set bytes.split() uses.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it; a temporary one only where driver and executors are one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quern-"))
    return sc.getCheckpointDir()


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here,
    and a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._stashed_at = path
    _WRITTEN.add(path)
    return written


#: What ``stash`` has written and nobody has discarded; paths only, so that no plan is kept alive.
_WRITTEN: set[str] = set()


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, {getattr(df, "_stashed_at", None)} & _WRITTEN)


def discard_all_but(kept: DataFrame) -> None:
    """Delete every stashed table but ``kept``: for a caller that has written the result it wanted."""
    _delete(kept.sparkSession, _WRITTEN - {getattr(kept, "_stashed_at", None)})


def _delete(spark: SparkSession, paths: set[str]) -> None:
    for path in paths:
        _WRITTEN.discard(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


FEW = 20_000


def join_frequent(rows: DataFrame, one_each: DataFrame, key: str, n: int, share: int = 1000) -> DataFrame:
    """The inner join of ``rows``, at most ``n`` of them or little more, with a table of one row per ``key``.

    Keys of more than one in ``share`` of all rows, at most ``share`` keys, are joined by broadcast, so that none of them fills a task.
    Up to ``FEW`` rows are joined as they are: all of them in one task would be no load.
    """
    if n <= FEW:
        return rows.join(one_each, key)
    counts = rows.groupBy(key).agg(F.count("*").alias("_rows"))
    frequent = counts.where(F.col("_rows") > max(1000, n // share)).select(key)
    by_broadcast = one_each.join(F.broadcast(frequent), key, "left_semi")
    others = rows.join(F.broadcast(frequent), key, "left_anti").join(one_each, key)
    return others.unionByName(rows.join(F.broadcast(by_broadcast), key))


def words_of(text: Column) -> Column:
    """Array of the words of ``text``; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, BLANK_RUN)
    )
