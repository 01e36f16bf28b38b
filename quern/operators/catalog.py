"""The registry of a corpus: what sources, tokenisations and views there are, and how large.

Each table is small (a few rows per source) and lies in a folder of its own.  A
change writes the whole table again under the next number and then drops the
version before the last, so a reader holds a complete table whatever happens to
the writer.  The joins over these tables are plain DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from .views import sources_of


class MissingDataKey(KeyError):
    """A strategy's splitter wants a field that the documents do not have."""


class MissingSplitterOutput(KeyError):
    """A splitter did not return what its strategy says it returns."""


class ReadOnly(PermissionError):
    pass


class AlreadyThere(ValueError):
    pass


@dataclass(frozen=True)
class Kind:
    """A table: its columns, which of them name a row, and which names of other tables its rows refer to."""

    columns: str
    key: tuple[str, ...]
    of: dict[str, str]


KINDS = {
    "source": Kind("source_no int, name string, modality string, data_key string, documents long, data_bytes long, meta_bytes long, rejects string", ("source_no",), {}),
    "strategy": Kind("strategy string, settings string", ("strategy",), {}),
    "tokenised": Kind(
        "strategy string, source_no int, tokens long, longest_tokens long, chunks long, longest_chunks long, documents long",
        ("strategy", "source_no"), {"strategy": "strategy", "source_no": "source"},
    ),
    "sequences": Kind("strategy string, source_no int, multiplier int, n long", ("strategy", "source_no", "multiplier"), {"strategy": "strategy", "source_no": "source"}),
    "view": Kind("view string, seed long, shuffled boolean", ("view",), {}),
    "view_source": Kind("view string, source_no int, flag string, documents long, bytes long", ("view", "source_no"), {"view": "view", "source_no": "source"}),
    "shard": Kind(
        "strategy string, view string, workers int, worker int, multiplier int, n long",
        ("strategy", "view", "workers", "worker", "multiplier"), {"strategy": "strategy", "view": "view"},
    ),
}
FLAGS = ("preserved", "skipped", "partial")
STRATEGY_KEYS = ("strategy_name", "tokenizer_type", "splitter_class", "chunk_size", "modality")


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key; of new rows with one key that with the largest
    ``order`` (any one of them without it) stays."""
    last = Window.partitionBy(*key).orderBy(F.desc(order) if order else F.lit(0))
    once = new.withColumn("_n", F.row_number().over(last)).where("_n = 1").select(*old.columns)
    return old.join(once.select(*key), key, "left_anti").unionByName(once)


def deleted(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(gone, key, "left_anti")


def orphans(child: DataFrame, foreign: str, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(F.col(key).alias(foreign)), foreign, "left_anti").select(*child.columns)


class Registry:
    """Tables of a corpus under ``root``; see ``KINDS``."""

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only
        self.view: str | None = None
        self.view_documents = 0

    # --- tables as a whole

    def table(self, kind: str) -> DataFrame:
        versions = self._versions(kind)
        if not versions:
            return self.spark.createDataFrame([], KINDS[kind].columns)
        return self.spark.read.schema(KINDS[kind].columns).parquet(f"{self.root}/{kind}/v={versions[-1]}")

    def _versions(self, kind: str) -> list[int]:
        names = store.children(self.spark, f"{self.root}/{kind}")
        found = sorted(int(n[2:]) for n in names if n.startswith("v="))
        return [v for v in found if "_SUCCESS" in store.children(self.spark, f"{self.root}/{kind}/v={v}")]

    def _write(self, kind: str, rows: DataFrame) -> None:
        if self.read_only:
            raise ReadOnly(self.root)
        versions = self._versions(kind)
        number = versions[-1] + 1 if versions else 0
        rows.select(*self.table(kind).columns).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{kind}/v={number}")
        for old in versions[:-1]:
            store.removed(self.spark, f"{self.root}/{kind}/v={old}")

    # --- rows

    def put(self, kind: str, rows: DataFrame, order: str | None = None) -> None:
        """Insert or replace by key."""
        key = list(KINDS[kind].key)
        self._write(kind, upserted(self.table(kind), rows, key, order))

    def add(self, kind: str, rows: DataFrame) -> None:
        """Insert; a key that is there already is an error."""
        key = list(KINDS[kind].key)
        known = self.table(kind).join(rows.select(*key), key, "left_semi").select(*key).first()
        if known is not None:
            raise AlreadyThere(f"{kind} {tuple(known)}")
        self.put(kind, rows)

    def change(self, kind: str, where: Column, values: dict[str, object]) -> int:
        """Set columns of the rows that ``where`` holds for; how many these were.  Key columns cannot be set."""
        if set(values) & set(KINDS[kind].key) or set(values) - set(self.table(kind).columns):
            raise ValueError(f"cannot set {sorted(values)} of {kind}")
        rows = self.table(kind)
        hit = F.coalesce(where, F.lit(False))
        n = rows.where(hit).count()
        self._write(kind, rows.select(*[F.when(hit, F.lit(values[c]).cast(t)).otherwise(F.col(c)).alias(c) if c in values else c for c, t in rows.dtypes]))
        return n

    def find(self, kind: str, **values: object) -> DataFrame:
        """Rows that agree with all values given; those that are None are not asked."""
        rows = self.table(kind)
        for c, v in values.items():
            if v is not None:
                rows = rows.where(F.col(c) == F.lit(v))
        return rows

    def one(self, kind: str, **values: object) -> dict:
        """A row as a dict, or an empty one."""
        row = self.find(kind, **values).limit(1).first()
        return row.asDict() if row is not None else {}

    def rows(self, kind: str, **values: object) -> list[dict]:
        return [r.asDict() for r in self.find(kind, **values).collect()]

    def names(self, kind: str) -> list:
        """All values of the first key column, in order."""
        return [r[0] for r in self.table(kind).select(KINDS[kind].key[0]).distinct().orderBy(KINDS[kind].key[0]).collect()]

    def remove(self, kind: str, **values: object) -> int:
        """Delete rows, and the rows of other tables that refer to them."""
        gone = self.find(kind, **values)
        n = gone.count()
        key = KINDS[kind].key[0]
        if len(KINDS[kind].key) == 1:
            for child, spec in KINDS.items():
                if spec.of.get(key) == kind and self._versions(child):
                    self._write(child, deleted(self.table(child), gone.select(key), [key]))
        self._write(kind, deleted(self.table(kind), gone.select(*KINDS[kind].key), list(KINDS[kind].key)))
        return n

    def replace_all(self, kind: str, rows: DataFrame, **values: object) -> None:
        """Delete what agrees with ``values``, then insert."""
        kept = deleted(self.table(kind), self.find(kind, **values).select(*KINDS[kind].key), list(KINDS[kind].key))
        self._write(kind, kept.unionByName(rows.select(*kept.columns)))

    # --- sources, strategies, views

    def number_of(self, name: str) -> int | None:
        return self.one("source", name=name).get("source_no")

    def largest_number(self) -> int:
        return self.table("source").agg(F.max("source_no")).first()[0] or 0

    def numbers(self) -> dict[str, int]:
        return {r["name"]: r["source_no"] for r in self.rows("source")}

    def link(self, view: str, source_no: int, flag: str, documents: int | None = None, n_bytes: int | None = None) -> None:
        """Set how a view takes a source: by exactly one flag."""
        if flag not in FLAGS:
            raise ValueError(f"{flag!r} is none of {', '.join(FLAGS)}")
        self.put("view_source", self.spark.createDataFrame([(view, source_no, flag, documents, n_bytes)], KINDS["view_source"].columns))

    def register_strategy(self, strategy: dict) -> dict:
        import json

        checked = validated_strategy(strategy)
        name = checked["strategy_name"]
        self.add("strategy", self.spark.createDataFrame([(name, json.dumps(checked, sort_keys=True))], KINDS["strategy"].columns))
        return checked

    def strategy(self, name: str) -> dict:
        import json

        found = self.one("strategy", strategy=name)
        return json.loads(found["settings"]) if found else {}

    def register_view(self, name: str, view: DataFrame, selection: dict[str, str | int | float], seed: int = 27) -> None:
        """Keep a view by name: its order and, per source, how it is taken and how much that is (``view``: source, n_bytes)."""
        from .views import NameAlreadyUsed, Take

        if self.one("view", view=name):
            raise NameAlreadyUsed(name)
        numbers = self.numbers()
        if set(selection) != set(numbers):
            raise ValueError(f"the selection must name exactly the sources; it differs in {sorted(set(selection) ^ set(numbers))}")
        taken = {r["source"]: (r["n"], r["b"]) for r in view.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b")).collect()}
        rows = []
        for source, value in selection.items():
            kind = Take.parse(value).kind
            rows.append((name, numbers[source], kind if kind in FLAGS else "partial", *taken.get(source, (0, 0))))
        self.put("view", self.spark.createDataFrame([(name, seed, True)], KINDS["view"].columns))
        self.put("view_source", self.spark.createDataFrame(rows, KINDS["view_source"].columns))

    def set_view(self, name: str) -> int:
        """Make a view the current one; the documents it holds."""
        if not self.one("view", view=name):
            raise KeyError(name)
        active = self.find("view_source", view=name).where("flag <> 'skipped'")
        self.view, self.view_documents = name, active.agg(F.sum("documents")).first()[0] or 0
        return self.view_documents

    def forget_shuffle(self, name: str) -> int:
        return self.change("view", F.col("view") == name, {"shuffled": False})


# --- queries over these tables


@dataclass
class Catalog:
    """The tables that the catalogue's joins read; each has at most a few rows per source."""

    sources: DataFrame
    databases: DataFrame
    links: DataFrame


def sources(docs: DataFrame) -> DataFrame:
    return sources_of(docs).select(F.col("source_id").alias("source_no"), F.col("source").alias("name"), F.col("n").alias("document_number"))


def build(docs: DataFrame) -> Catalog:
    sized = docs.groupBy(F.col("source").alias("name")).agg(
        F.sum(F.octet_length("text")).alias("data_bytes"), F.sum(F.octet_length("lang")).alias("meta_bytes")
    )
    s = sources(docs).join(sized, "name")
    kinds = F.array(
        F.struct((2 * F.col("source_no") - 1).alias("database_id"), F.lit("data").alias("type"), F.col("data_bytes").alias("raw_data_bytes")),
        F.struct((2 * F.col("source_no")).alias("database_id"), F.lit("meta").alias("type"), F.col("meta_bytes").alias("raw_data_bytes")),
    )
    d = s.select(F.col("source_no").alias("source_ref"), F.explode(kinds).alias("k")).select("source_ref", "k.*")
    links = d.select("source_ref", "database_id", "raw_data_bytes", (F.col("type") == "data").alias("is_data"), (F.col("type") == "meta").alias("is_meta"))
    return Catalog(s, d.select("database_id", "type"), links)


def source_databases(c: Catalog) -> DataFrame:
    return c.links.join(c.databases, "database_id").select("source_ref", "database_id", "type", "raw_data_bytes", "is_data", "is_meta")


def source_info(c: Catalog) -> DataFrame:
    """Sources with their data database; the filter on the right side makes the left join an inner one."""
    return (
        c.sources.join(c.links, c.sources.source_no == c.links.source_ref, "left").where("is_data")
        .select("source_no", "name", "document_number", "raw_data_bytes")
    )


def strategy_databases(c: Catalog, strategy: str = "bytes") -> DataFrame:
    kinds = F.explode(F.array(F.lit("tokens"), F.lit("chunks"))).alias("kind")
    own = c.links.where("is_data").select(F.lit(strategy).alias("strategy_name"), "source_ref", "database_id", kinds)
    return own.join(c.databases, "database_id").select("strategy_name", "source_ref", "database_id", "kind", "type")


def thirds_view(c: Catalog) -> DataFrame:
    """A view that skips, preserves and cuts sources in turn."""
    turn = F.col("source_no") % 3
    return c.sources.select(
        F.lit("thirds").alias("view"), "source_no", F.when(turn == 0, "skipped").when(turn == 1, "preserved").otherwise("partial").alias("flag"),
        F.col("document_number").alias("documents"), F.when(turn != 2, F.col("data_bytes")).alias("bytes"),
    )


def checked_links(view_sources: DataFrame) -> DataFrame:
    """Rows whose flag is missing or none of those there are."""
    return view_sources.where(~F.coalesce(F.col("flag").isin(*FLAGS), F.lit(False)))


def view_totals(view_sources: DataFrame) -> DataFrame:
    """Documents and bytes of a view by criterion, nulls as zero; one pass over the table."""
    tests = {"active": F.col("flag") != "skipped", "preserved": F.col("flag") == "preserved", "all": F.lit(True)}
    sums = view_sources.agg(
        *[
            F.coalesce(F.sum(F.when(test, F.coalesce(F.col(c), F.lit(0)))), F.lit(0)).cast("long").alias(f"{k}_{c}")
            for k, test in tests.items()
            for c in ("documents", "bytes")
        ]
    )
    rows = F.array(*[F.struct(F.lit(k).alias("criterion"), F.col(f"{k}_documents").alias("documents"), F.col(f"{k}_bytes").alias("bytes")) for k in tests])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def ask_view(view_sources: DataFrame, view: str, flag: str) -> DataFrame:
    return view_sources.where((F.col("view") == view) & (F.col("flag") == flag)).select("source_no")


def estimated_chunks(counts: DataFrame, chunks_per_doc: int, top: int = 100) -> DataFrame:
    """Estimated chunks of each source for every multiplier, from its share of all documents."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    est = F.floor(F.lit(total * chunks_per_doc) * F.col("n") / F.lit(max(total, 1))).cast("long")
    return counts.select("source", est.alias("est"), F.explode(F.sequence(F.lit(1), F.lit(top))).alias("m")).select(
        "source", F.col("m").cast("long").alias("m"), F.expr("(est + m - 1) div m").alias("chunks")
    )


def validated_strategy(strategy: dict) -> dict:
    missing = [k for k in STRATEGY_KEYS if k not in strategy]
    if missing:
        raise ValueError(f"strategy without {', '.join(missing)}")
    return strategy | {"strategy_name": safe_name(strategy["strategy_name"])}


def safe_name(name: str) -> str:
    return "".join(c if c.isalnum() or c in "_-" else "_" for c in name)


def compatible(strategy: dict, modality: str, databases: set[str]) -> bool:
    return strategy["modality"] == modality and set(strategy.get("required_databases", ())) <= databases


def shard_length(shards: DataFrame, workers: int, worker: int) -> int:
    """Sequences of one worker: as stored for ``workers``, else summed up from the largest multiple of it."""
    stored = [r[0] for r in shards.select("workers").distinct().orderBy(F.desc("workers")).collect()]
    use = workers if workers in stored else next((n for n in stored if n % workers == 0), None)
    if use is None:
        raise ValueError(f"no stored lengths for {workers} workers")
    own = shards.where((F.col("workers") == use) & (F.pmod("worker", F.lit(workers)) == worker))
    return own.agg(F.sum("n")).first()[0] or 0
