"""From raw documents to packed sequences in five stages, each one of the operators of ``quern.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.

Defined results, beyond those of the operators: a null or empty text is scored,
fingerprinted, mixed and packed as an empty one and stays null or becomes empty;
documents without an id are kept like others; rows that repeat an id and a text
count as copies of each other, rows that share an id only do not; null ``lang``,
``source`` and ``n_chars`` pass through; extra columns are dropped; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import mixing, packing, quality_classifier, repeats, simhash
from quern.llm.common import discard_all_but, stash, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
OTHERS = ("lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    weights = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, weights, keep=("text", *OTHERS))
    return scored.where("score >= 0.5").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id; see ``simhash.one_of_each``."""
    return simhash.one_of_each(docs).select(*COLUMNS)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that also start earlier."""
    cut = repeats.remove_repeats(docs, texts=True, keep=("lang", "source"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and again as often as its fitted rate says: small languages gain, none loses."""
    rated, _ = mixing.mix(docs, label_col="lang", keep=("text", *OTHERS))
    again = rated.withColumn("n", mixing.copies(F.col("rate"), "doc_id", least=1))
    return again.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, one row per piece."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_dedup),
    ("repeated passages", passage_dedup),
    ("mixing", mixed),
    ("packing", packed),
]

#: Trained models, fingerprints of XXH64 and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        discard_all_but(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
