"""Incremental ingestion: new JSON files become accepted rows and running statistics, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest


def start(spark: SparkSession, source: str, target: str, checkpoint: str, name: str = "source") -> StreamingQuery:
    """Append accepted documents under ``target/docs`` and counters under ``target/stats``, a folder per batch.

    A batch that is tried again overwrites its own folder.
    """
    lines = spark.readStream.format("text").schema("value string").load(source)

    def write(batch: DataFrame, number: int) -> None:
        rows = ingest.parsed(batch)
        rows.where("reason is null").select("data", "meta").write.mode("overwrite").parquet(f"{target}/docs/batch={number}")
        rows.selectExpr("coalesce(reason, 'accepted') as reason").groupBy("reason").count().write.mode("overwrite").parquet(f"{target}/stats/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).queryName(name).start()


def totals(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/stats").groupBy("reason").sum("count").withColumnRenamed("sum(count)", "n")
