"""Labelled sets: checks, label maps, class weights and alignment to word pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORED = -100


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def complete(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without a null in ``columns``, and a one-row table of how many were dropped."""
    kept = required(df, columns).dropna(subset=columns)
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return kept, df.agg(F.count_if(~whole).alias("dropped"))


def mapped(df: DataFrame, label: str, mapping: dict[str, int], name: str = "label_id") -> DataFrame:
    """``df`` with the number of each label (element-wise for arrays); an unmapped label is an error."""
    if not mapping:
        raise ValueError("string labels need a map")
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    one = lambda v: F.when(v.isNull() | F.map_contains_key(table, v), F.try_element_at(table, v)).otherwise(
        F.raise_error(F.concat(F.lit("unmapped label: "), v)).cast("int")
    )
    value = F.transform(label, one) if dict(df.dtypes)[label].startswith("array") else one(F.col(label))
    return df.withColumn(name, value)


def unseen(df: DataFrame, label: str, known: DataFrame) -> DataFrame:
    return df.join(known, label, "left_anti").select(label).distinct()


def distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def unique(df: DataFrame, label: str) -> DataFrame:
    """All labels there are, in order; those of arrays one by one."""
    value = F.explode(label) if dict(df.dtypes)[label].startswith("array") else F.col(label)
    return df.select(value.alias("label")).where("label is not null").distinct().orderBy("label")


def projected(df: DataFrame, columns: list[str] | None = None, text: str = "text", label: str = "label", id_: str = "id") -> DataFrame:
    """The columns asked for, or text, label and id (null where there is none)."""
    if columns is not None:
        return required(df, columns).select(*columns)
    return required(df, [text, label]).select(text, label, F.col(id_) if id_ in df.columns else F.lit(None).alias(id_))


def class_weights(df: DataFrame, label: str, classes: int, kind: str = "inverse") -> DataFrame:
    """(class, weight) for classes 0..C-1; one that is missing counts once; the weights add up to C."""
    counts = df.groupBy(F.col(label).cast("int").alias("class")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("class"))
    raw = every.join(counts, "class", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    value = 1 / F.col("n") if kind == "inverse" else 1 / F.sqrt("n")
    # As many rows as there are classes, in one array: no join with a total.
    rows = raw.agg(F.collect_list(F.struct("class", value.alias("w"))).alias("r"))
    total = F.aggregate("r", F.lit(0.0), lambda a, x: a + x["w"])
    return rows.select(F.explode("r").alias("x"), total.alias("t")).select("x.class", (F.col("x.w") * classes / F.col("t")).alias("weight"))


def aligned(pieces: Column, labels: Column) -> Column:
    """A label per word piece: the first piece of a word has its label, the others are ignored."""
    each = F.zip_with(pieces, labels, lambda n, y: F.concat(F.array(y), F.array_repeat(F.lit(IGNORED), n - 1)))
    return F.flatten(F.filter(F.zip_with(each, pieces, lambda e, n: F.when(n > 0, e)), lambda e: e.isNotNull()))


def truncated(ids: Column, length: int) -> tuple[Column, Column]:
    """Ids cut to ``length``, and whether they were."""
    return F.slice(ids, 1, length), F.size(ids) > length


def truncation(df: DataFrame, ids: str, length: int, labels: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` cut to ``length`` ids (and as many labels), and a one-row table of how many rows were longer."""
    cut = df.withColumn(ids, F.slice(ids, 1, length))
    if labels is not None:
        cut = cut.withColumn(labels, F.slice(labels, 1, length))
    return cut, df.agg(F.count_if(F.size(ids) > length).alias("truncated"))


def batch_rows(df: DataFrame, ids: str, labels: str, length: int, pad: int) -> DataFrame:
    """``df`` as model input: ids padded with ``pad``, labels of tokens with the ignored one, attention where no padding is."""
    padded = lambda c, x: F.concat(F.slice(c, 1, length), F.array_repeat(F.lit(x), F.lit(length) - F.size(F.slice(c, 1, length))))
    per_token = dict(df.dtypes)[labels].startswith("array")
    rows = df.withColumn(ids, padded(ids, pad)).withColumn(labels, padded(labels, IGNORED) if per_token else F.col(labels))
    return rows.withColumn("attention", F.transform(ids, lambda x: x != pad))


def sampled(df: DataFrame, index: str, n: int, rank: int, world: int, epoch: int = 0, shuffle: bool = True, seed: int = 0) -> DataFrame:
    """The rows one rank reads in an epoch, with ``at``, their order: a permutation of all, dealt in turn; the first ones come
    again until every rank has as many."""
    from .permute import Permutation

    each = -(-n // world)
    place = Permutation.draw(n, seed + epoch).position(F.col(index)) if shuffle and n else F.col(index).cast("long")
    rows = df.withColumn("_pos", place)
    # A row at place p is also at p + n, p + 2n, ... as far as the ranks reach beyond the end.
    again = F.sequence(F.lit(0), F.lit(max((each * world - 1) // max(n, 1), 0)))
    every = rows.withColumn("_pos", F.explode(F.transform(again, lambda k: F.col("_pos") + k * n)))
    own = every.where((F.col("_pos") < each * world) & (F.pmod("_pos", F.lit(world)) == rank))
    return own.withColumn("at", F.floor(F.col("_pos") / world).cast("long")).drop("_pos")


def first_pooled(vectors: Column) -> Column:
    """The vector of the first token, as the one that stands for the sequence."""
    return F.get(vectors, F.lit(0))


def mean_pooled(vectors: Column, mask: Column, width: int) -> Column:
    """Mean of the vectors where ``mask`` is 1; never divides by less than 1e-9."""
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1e-9))
    zero = F.array(*[F.lit(0.0)] * width)
    total = F.aggregate(F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x * m)), zero, lambda a, v: F.zip_with(a, v, lambda p, q: p + q))
    return F.transform(total, lambda x: x / n)
