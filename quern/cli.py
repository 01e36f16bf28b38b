"""Command line over the registry: python -m quern.cli COMMAND --path FOLDER ...

A corpus is a folder of documents (one partition per source) beside its registry.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import catalog, chunking, ingest, pretok, store, tokenise, views
from .sources import readers, sinks


class Corpus:
    """Documents (source, doc_key, data, meta) under ``path`` and their registry."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.registry = catalog.Registry(spark, f"{self.path}/registry")

    def documents(self) -> DataFrame:
        """Every source's folder; a source that is being written has no place in the registry yet."""
        from functools import reduce

        parts = [
            self.spark.read.parquet(f"{self.path}/documents/{number}").withColumn("source", F.lit(name))
            for name, number in sorted(self.registry.numbers().items())
        ]
        if not parts:
            return self.spark.createDataFrame([], "doc_key long, data string, meta string, source string")
        return reduce(DataFrame.unionByName, parts)

    def add_source(self, name: str, lines: DataFrame, data_key: str = "text") -> dict:
        """Ingest JSON lines as a new source; its row in the registry."""
        if self.registry.number_of(name) is not None:
            raise catalog.AlreadyThere(name)
        number = self.registry.largest_number() + 1
        rows = store.written(ingest.parsed(lines.withColumn("_order", F.monotonically_increasing_id()), data_key=data_key), "parsed")
        slim = ingest.accepted(rows).withColumn("source", F.lit(name))
        keyed = ingest.with_dense_ids(slim, "_order").select("doc_key", "data", "meta")
        keyed.repartitionByRange("doc_key").sortWithinPartitions("doc_key").write.option("compression", "zstd").parquet(f"{self.path}/documents/{number}")
        written = self.spark.read.parquet(f"{self.path}/documents/{number}").withColumn("source", F.lit(name))
        stats = ingest.source_stats(written).first()
        counts = ingest.reject_report(rows, []).first()
        values = (number, name, "document", data_key, stats["document_number"] if stats else 0, stats["data_bytes"] if stats else 0,
                  stats["meta_bytes"] if stats else 0, counts["counters"] if counts else "{}")
        self.registry.add("source", self.spark.createDataFrame([values], catalog.KINDS["source"].columns))
        if not self.registry.one("view", view="default"):
            self.registry.put("view", self.spark.createDataFrame([("default", 27, False)], catalog.KINDS["view"].columns))
        self.registry.link("default", number, "preserved", values[4], values[5])
        return self.registry.one("source", name=name)

    def tokenise(self, strategy: str, source: str) -> dict:
        """Tokenise a source by a registered strategy; its statistics."""
        settings = self.registry.strategy(strategy)
        number = self.registry.number_of(source)
        if not settings or number is None:
            raise KeyError(strategy if not settings else source)
        docs = self.documents().where(F.col("source") == source).select("source", F.col("doc_key").alias("doc_id"), F.col("data").alias("text"))
        limit = int(settings["chunk_size"]) - 2
        if settings["tokenizer_type"] == "file":
            rows = chunking.tokenised_chunks(docs, settings["tokenizer_name"], limit, settings["splitter_class"])
        else:
            ids = tokenise.byte_ids(F.col("text"), None, None)
            n = F.transform(chunking.sentences(F.col("text")), lambda s: F.octet_length(s))
            rows = docs.withColumn("tokens", ids).withColumn("sizes", chunking.aligned(n, limit))
        done, failed = pretok.pretokenised(rows, settings | {"chunk_size": limit}, F.col("tokens"), F.col("sizes"))
        done = store.written(done, "tokenised")
        target = f"{self.path}/tokens/{strategy}/{number}"
        done.write.mode("overwrite").option("compression", "zstd").parquet(target)
        s = pretok.strategy_stats(done).first()
        row = (strategy, number, *(s[c] if s else 0 for c in ("total_tokens", "max_tokens", "total_chunks", "max_chunks", "processed_docs")))
        self.registry.put("tokenised", self.spark.createDataFrame([row], catalog.KINDS["tokenised"].columns))
        lengths = pretok.length_table(done).select(F.lit(strategy).alias("strategy"), F.lit(number).alias("source_no"), "multiplier", F.col("precomputed_length").alias("n"))
        self.registry.replace_all("sequences", lengths, strategy=strategy, source_no=number)
        return self.registry.one("tokenised", strategy=strategy, source_no=number) | {"failed": failed.count()}

    def view(self, name: str) -> DataFrame:
        """(source, doc_key, pos, n_bytes) of a registered view."""
        found = self.registry.one("view", view=name)
        if not found:
            raise KeyError(name)
        if found["shuffled"] and store.children(self.spark, f"{self.path}/views/{name}"):
            return self.spark.read.parquet(f"{self.path}/views/{name}")
        skipped = [r["source_no"] for r in self.registry.rows("view_source", view=name, flag="skipped")]
        names = {k for k, v in self.registry.numbers().items() if v not in skipped}
        return views.sequential(self._index(names)).select("source", "doc_key", "pos", "n_bytes")

    def _index(self, names: set[str]) -> DataFrame:
        docs = self.documents().where(F.col("source").isin(sorted(names))).select("source", "doc_key", F.octet_length("data").cast("long").alias("n_bytes"))
        rows = views.source_rows(docs)
        offsets = self.spark.createDataFrame([(r[0], r[3]) for r in rows], "source string, offset long")
        return docs.join(F.broadcast(offsets), "source").withColumn("g", F.col("offset") + F.col("doc_key")).drop("offset")

    def create_view(self, name: str, selection: dict, seed: int = 27) -> dict:
        taken = {k for k in self.registry.numbers()}
        index = store.written(self._index(taken), "index")
        n = index.count()
        chosen = views.compacted(views.select(views.shuffled(index, n, seed), selection, sorted(taken), n=n), n) if n else index.withColumn("pos", F.col("g"))
        chosen = store.written(chosen.select("source", "doc_key", "pos", "n_bytes"), "view")
        self.registry.register_view(name, chosen, selection, seed)
        views.materialised(chosen, max(1, -(-n // 1_000_000))).write.parquet(f"{self.path}/views/{name}")
        return self.registry.one("view", view=name)

    def export(self, name: str, target: str, field: str = "text", meta: bool = True, limit: int | None = None) -> None:
        v = self.view(name)
        if limit is not None:
            v = v.where(F.col("pos") < limit)
        rows = v.join(self.documents(), ["source", "doc_key"]).repartitionByRange("pos").sortWithinPartitions("pos")
        columns = [F.col("source").alias("group"), F.col("data").alias(field)] + [F.try_parse_json("meta").alias("meta")] * meta
        sinks.write_json_lines(rows.select(*columns), target)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return readers.json_lines(spark, path).select("value")


def run(spark: SparkSession, args: argparse.Namespace) -> object:
    c = Corpus(spark, args.path)
    r = c.registry
    match args.command:
        case "create":
            r.put("view", spark.createDataFrame([("default", 27, False)], catalog.KINDS["view"].columns))
            return {"created": args.path}
        case "load" | "info":
            return {"sources": r.rows("source"), "strategies": r.names("strategy"), "views": r.names("view"), "bytes": store.bytes_under(spark, args.path)}
        case "add-source":
            return c.add_source(args.name, _lines(spark, args.input), args.data_key)
        case "batch-import":
            listed = spark.read.option("header", True).csv(args.input).collect()
            out = []
            for row in listed:  # one job per source
                try:
                    out.append(c.add_source(row["name"], _lines(spark, row["input"])))
                except Exception as problem:
                    out.append({"name": row["name"], "failure": f"{type(problem).__name__}: {problem}"[:300]})
            return out
        case "convert":
            readers.open_source(spark, args.kind, args.input).write.parquet(args.output)
            return {"converted": args.output}
        case "list-sources":
            return r.rows("source")
        case "list-strategies":
            return [r.strategy(n) for n in r.names("strategy")]
        case "register-strategy":
            return r.register_strategy(json.loads(args.strategy))
        case "pretokenise":
            return c.tokenise(args.strategy, args.source)
        case "pretokenise-batch":
            out = []
            for name in args.sources or sorted(r.numbers()):
                try:
                    out.append(c.tokenise(args.strategy, name))
                except Exception as problem:
                    out.append({"source": name, "failure": f"{type(problem).__name__}: {problem}"[:300]})
            return out
        case "create-view":
            return c.create_view(args.name, json.loads(args.selection), args.seed)
        case "list-views":
            return r.rows("view")
        case "set-view":
            return {"view": args.name, "documents": r.set_view(args.name)}
        case "shuffle-view":
            every = {name: "preserved" for name in r.numbers()}
            return c.create_view(args.name, every, args.seed)
        case "export-view":
            return sinks.view_template(args.name, sorted(r.numbers())) | {"links": r.rows("view_source", view=args.name)}
        case "export-view-data":
            c.export(args.name, args.output, args.field, not args.without_meta, args.limit)
            return {"exported": args.output}
        case "delete-source":
            return {"deleted": r.remove("source", name=args.name)}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quern", description="Sources, tokenisations and views of a text corpus.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple[str, dict]) -> None:
        sub = commands.add_parser(name)
        sub.add_argument("--path", required=True)
        for flag, how in options:
            sub.add_argument(flag, **how)

    needed = {"required": True}
    named, given = ("--name", needed), ("--input", needed)
    seed = ("--seed", {"type": int, "default": 27})
    for name in ("create", "load", "info", "list-sources", "list-strategies", "list-views"):
        command(name)
    command("add-source", named, given, ("--data-key", {"default": "text"}))
    command("batch-import", given)
    command("convert", given, ("--output", needed), ("--kind", {"default": "jsonl"}))
    command("register-strategy", ("--strategy", needed))
    command("pretokenise", ("--strategy", needed), ("--source", needed))
    command("pretokenise-batch", ("--strategy", needed), ("--sources", {"nargs": "*"}))
    command("create-view", named, ("--selection", needed), seed)
    for name in ("set-view", "export-view", "delete-source"):
        command(name, named)
    command("shuffle-view", named, seed)
    command("export-view-data", named, ("--output", needed), ("--field", {"default": "text"}), ("--without-meta", {"action": "store_true"}), ("--limit", {"type": int}))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quern").getOrCreate()
    print(json.dumps(run(spark, args), default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
