"""Packing: best-fit decreasing over a histogram of piece lengths.

1. One pass tokenises every text, cuts it into full windows and a remainder and
   notes each piece's checksum; the pieces are written once, without their ids.
2. Full windows are sequences of their own.  Of the remainders only the number
   of each length matters: a histogram of at most ``window`` counts reaches the
   driver.  There, lengths are placed in falling order; a segment tree indexed
   by remaining capacity finds the tightest open window that still fits.  Equal
   windows are kept as one class with a count, so the work depends on the
   window size and not on the number of documents.
3. The plan (length, ranks from-to, sequence, offset) has a size bounded by the
   window and is joined back to the pieces by their rank within a length.
   Ranks come from counts per (length, bucket), so that no length, however
   common, has to be sorted by one task.

Defined results: null and empty texts are one token, the end-of-document id;
rows that repeat an id are packed one by one; ties in length go by a hash of
id and start, then by these; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, table

WINDOW = 2048
END_ID = 1


def _byte_of() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: printable ones are themselves,
    the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Scripts whose character classes no Unicode version has moved; other texts are left to the slower library.
_SETTLED = "\x00-\x1b\x20-\x7e\xa0-\u024f\u0370-\u03ff\u0400-\u04ff\u2010-\u2027\u2030-\u205e\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes, by the tokenizer file at ``path``.

    The file's vocabulary and merge order are handed to a faster implementation of
    the same byte-level encoding.  Texts that hold one of the file's added tokens or
    characters beyond the settled scripts go through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import json
        import re

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"] for t in spec["added_tokens"]}
        letters = _byte_of()
        ranks = {bytes(letters[c] for c in t): k for t, k in spec["model"]["vocab"].items() if t not in added}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.slow = re.compile("|".join([f"[^{_SETTLED}]", *map(re.escape, sorted(added))]))

    def __call__(self, text: str) -> bytes:
        if self.slow.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): full windows and a remainder per row."""
    tail = np.array([end_id], dtype="<u4").tobytes()
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(tokenizer_path)
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                rows, starts, lengths, sums, totals = [], [], [], [], []
                for k, text in enumerate(b.column(1)):
                    ids = encoder(text.as_py() or "") + tail
                    n = len(ids) // 4
                    for s in range(0, n, window):
                        piece = ids[4 * s : 4 * (s + window)]
                        rows.append(k)
                        starts.append(s)
                        lengths.append(len(piece) // 4)
                        sums.append(zlib.crc32(piece))
                        totals.append(n)
                longs = [pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows, pa.int64())), *longs], names=["id", "start", "length", "ids_crc32", "doc_tokens"]
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
        run, f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"
    )


class CapacityTree:
    """Segment tree over remaining capacities 0..size: how many windows are open at each."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += n
            at //= 2

    def tightest(self, need: int) -> int | None:
        """Smallest capacity >= need with an open window."""
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of ``histogram`` (length: count): rows (length, first rank, last rank + 1,
    sequence of the first, offset); the sequence goes up by one with the rank."""
    tree = CapacityTree(window)
    open_: dict[int, list[tuple[int, int]]] = {}  # capacity -> runs (first sequence, count) of equal windows
    out, used = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, n = window, used, -(-left // (window // length))
                used += n
            else:
                first, n = open_[capacity].pop()
                tree.add(capacity, -n)
            # A window that got one of this length is now the tightest: it is filled before the next.
            per = capacity // length
            full = min(n, left // per)
            rest = left - full * per if full < n else 0
            for windows, filled in ((full, per), (1 if rest else 0, rest), (n - full - (1 if rest else 0), 0)):
                if windows:
                    for k in range(filled):
                        out.append((length, rank, rank + windows, first, window - capacity + k * length))
                        rank += windows
                    left -= windows * filled
                    open_.setdefault(capacity - filled * length, []).append((first, windows))
                    tree.add(capacity - filled * length, windows)
                    first += windows
    return out


def pack(
    docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id",
    text_col: str = "text", buckets: int = 64, in_bucket_rows: int = 50_000,
) -> DataFrame:
    """One row per piece: where it comes from, its checksum, its sequence and offset there."""
    spark = docs.sparkSession
    pieces = stash(tokenised_pieces(docs, tokenizer_path, window, end_id, id_col, text_col), "pieces")
    # Full windows are as many as the text is long, all of one length: their buckets grow with them.
    full_buckets = max(buckets, -(-pieces.count() // in_bucket_rows))
    dealt = F.when(F.col("length") == window, full_buckets).otherwise(buckets)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "start"), dealt).cast("int"))
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = stash(
        counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "bucket", "n", F.coalesce("before", F.lit(0)).alias("before")),
        "length-ranks",
    )  # at most window * buckets rows, and one for every in_bucket_rows pieces
    histogram = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = histogram.pop(window, 0)
    rows = plan(histogram, window) + ([(window, 0, full, 0, 0)] if full else [])
    shift = full  # sequences of full windows come first
    rows = [(a, b, c, d + (0 if a == window else shift), e) for a, b, c, d, e in rows]
    # For each length an array of its runs, sorted by rank: the join is on the length alone.
    placed: dict[int, list] = {}
    for a, b, c, d, e in rows:
        placed.setdefault(a, []).append((b, c, d, e))
    runs = spark.createDataFrame(
        [(a, b, c, d, e) for a, v in placed.items() for b, c, d, e in v],
        "length long, first long, until long, sequence long, offset long",
    )
    in_bucket = Window.partitionBy("length", "bucket").orderBy("id", "start")
    ranked = (
        pieces.join(F.broadcast(before.select("length", "bucket", "before")), ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.row_number().over(in_bucket) - 1)
    )
    fits = (F.col("r.length") == F.col("p.length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("until"))
    return (
        ranked.alias("p")
        .join(F.broadcast(runs.alias("r")), fits)
        .select(
            F.col("p.id").alias(id_col), "start", F.col("p.length").alias("length"), "ids_crc32", "doc_tokens",
            (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset",
        )
    )


def op6_packing(spark, sf_dir, name: str = "byte_bpe_50k.json"):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(name))
