"""SimHash near-duplicates through vantage-point trees over fingerprints.

1. One pass computes a 64-bit fingerprint per text; equal fingerprints collapse
   into one row with the smallest id, so copies are never compared.
2. A vantage-point tree is grown on a bounded sample of fingerprints.  A node
   splits the rest by Hamming distance to its vantage point; a query of radius r
   goes to every branch that the triangle bounds leave open.  Each fingerprint
   is at home in one leaf and visits the later leaves its ball overlaps, so each
   pair meets in exactly one shard.
3. A shard grows its own tree over its rows and compares what remains exactly.
   It returns a star per connected group, never the pairs of a group.
4. The stars of all shards are joined into components by alternating large-star
   and small-star rounds, each written to the shared folder.

Scale: 64-bit fingerprints of unrelated texts lie about 32 bits apart, so with
radius 4 a split leaves about two thirds of the queries with both branches: the
compared pairs grow as about n^1.75 (a brute force grows as n^2).  The top tree
deepens with the number of distinct fingerprints, at 2^20 of them a sixteenth of its
leaves.  The centre of a large group is joined by broadcast, at most a thousand of them.

Defined results: null and empty texts have no words and fingerprint zero, and
link like any other; a null id counts as no id when the smallest is taken; rows
that repeat an id are each returned; an empty table gives an empty table; other
columns are not looked at.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_frequent, stash, table

SHINGLE = 4
RADIUS = 4
SEED = 42
SAMPLE_LEAF = 64  # sampled fingerprints per leaf of the top tree
MAX_SAMPLE = 1 << 21  # of all leaves together
_LANES = (np.arange(8) * 256).astype(np.int64)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text over XXH64 of its word shingles."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    at = list(accumulate(map(len, words), lambda a, n: a + n + 1, initial=0))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(at, at[shingle:])], dtype="<u8")
    octets = hashes.view(np.uint8).reshape(-1, 8) + _LANES
    seen = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256)
    ones = seen @ _BITS
    return int.from_bytes(np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, hash, fp) per row: a hash of the text, and the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["id", "hash", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("hash"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, hash long, fp long")


def text_hash(text_col: str) -> Column:
    """Tells texts of one id apart; null is none of them."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")), F.col(text_col).isNull())


def distance(a, b):
    return np.bitwise_count(np.bitwise_xor(a, b))


class Tree:
    """Top of a vantage-point tree: complete, ``depth`` splits deep, kept as flat arrays."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.points = np.zeros(2**depth - 1, dtype=np.uint64)
        self.radii = np.full(2**depth - 1, -1, dtype=np.int64)
        self._grow(0, sample)

    def _grow(self, node: int, rows: np.ndarray) -> None:
        if node >= len(self.points) or not len(rows):
            return
        # Of a few rows the one with the widest spread of distances prunes best.
        tried = rows[:: max(1, len(rows) // 8)][:8]
        spread = [np.var(distance(rows, p)) for p in tried]
        self.points[node] = p = tried[int(np.argmax(spread))]
        d = distance(rows, p)
        self.radii[node] = r = int(np.median(d))
        self._grow(2 * node + 1, rows[d <= r])
        self._grow(2 * node + 2, rows[d > r])

    def route(self, rows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home leaf of each row, and (row, leaf) of every leaf its ball may reach; only reached nodes are looked at."""
        home = np.zeros(len(rows), dtype=np.int64)
        row, node = np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64)
        for level in range(self.depth):
            at = node + 2**level - 1
            d, r = distance(rows[row], self.points[at]).astype(np.int64), self.radii[at]
            own = node == home[row]
            home[row[own]] = 2 * node[own] + (d[own] > r[own])
            left, right = d - radius <= r, d + radius > r
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        return home, row, node


def _local_links(homes: np.ndarray, queries: np.ndarray, radius: int, leaf: int = 1024):
    """Index pairs (query, home) that connect what lies within ``radius``: every query with hits is
    tied to its first hit and that hit to the others, which leaves out pairs that connect nothing new."""
    found_q, found_h = [], []

    def ties(q, h):
        block = max(1, (1 << 22) // max(1, len(h)))
        for at in range(0, len(q), block):
            part = q[at : at + block]
            i, j = np.nonzero(distance(queries[part][:, None], homes[h][None, :]) <= radius)
            if len(i):
                new = np.concatenate([[True], i[1:] != i[:-1]])
                first = h[j[new]][np.cumsum(new) - 1]
                found_q.append(part[i[new]])
                found_h.append(h[j[new]])
                pair = np.unique(first * len(homes) + h[j])
                tied_homes.append(pair[pair // len(homes) != pair % len(homes)])

    tied_homes: list[np.ndarray] = []
    todo = [(np.arange(len(queries)), np.arange(len(homes)), 0)]
    while todo:
        q, h, level = todo.pop()
        if not len(q) or not len(h):
            continue
        if len(h) <= leaf or level > 24:
            ties(q, h)
            continue
        p = homes[h[len(h) // 2]]
        dh, dq = distance(homes[h], p).astype(np.int64), distance(queries[q], p).astype(np.int64)
        r = int(np.median(dh))
        if (dh <= r).all():
            ties(q, h)
            continue
        todo.append((q[dq - radius <= r], h[dh <= r], level + 1))
        todo.append((q[dq + radius > r], h[dh > r], level + 1))
    none = np.zeros(0, dtype=np.int64)
    tied = np.unique(np.concatenate(tied_homes)) if tied_homes else none
    return (
        np.concatenate(found_q) if found_q else none,
        np.concatenate(found_h) if found_h else none,
        tied // max(1, len(homes)),
        tied % max(1, len(homes)),
    )


def _stars(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, smallest value of its group) for all values in a link (a, b given as indexes)."""
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    used = np.unique(np.concatenate([a, b]))
    return values[used], values[label[used]]


def _shard(radius: int):
    def run(batches):
        tables = list(batches)
        if not tables:
            return
        t = pa.Table.from_batches(tables)
        key = t["shard"].to_numpy()
        fp = t["fp"].to_numpy().view(np.uint64)
        at_home = t["at_home"].to_numpy(zero_copy_only=False)
        order = np.argsort(key, kind="stable")
        for rows in np.split(order, np.nonzero(np.diff(key[order]))[0] + 1):
            homes = np.unique(fp[rows][at_home[rows]])
            queries = fp[rows][~at_home[rows]]
            if not len(homes) or not len(queries):
                continue
            values, index = np.unique(np.concatenate([homes, queries]), return_inverse=True)
            h_index, q_index = index[: len(homes)], index[len(homes) :]
            q, h, h1, h2 = _local_links(homes, queries, radius)
            a = np.concatenate([q_index[q], h_index[h1]])
            b = np.concatenate([h_index[h], h_index[h2]])
            real = a != b
            if real.any():
                v, m = _stars(values, a[real], b[real])
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(m.view(np.int64))], names=["u", "v"])

    return run


def shard_links(distinct: DataFrame, radius: int = RADIUS, leaf_rows: int = 1 << 20, slices: int = 4):
    """Stars (u, v) over the distinct fingerprints ``fp`` whose closure links all within ``radius``."""
    n = distinct.count()
    depth = max(4, 4 + math.ceil(math.log2(max(n, 1) / leaf_rows)))
    sample_rows = min(MAX_SAMPLE, max(4096, SAMPLE_LEAF << depth))  # the deeper the tree, the more it is grown on
    top = distinct.select(F.xxhash64("fp").alias("h"), "fp").orderBy("h", "fp").limit(sample_rows)
    sample = top.select("fp").toPandas()["fp"].to_numpy(np.int64)
    tree = distinct.sparkSession.sparkContext.broadcast(Tree(sample.view(np.uint64), depth))

    def deal(batches):
        """A home row goes to every slice of its leaf, a visitor to one slice of each leaf it reaches."""
        for b in batches:
            signed = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(signed), 8192):
                fp = signed[at : at + 8192]
                home, row, leaf = tree.value.route(fp.view(np.uint64), radius)
                part = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % slices
                later = leaf >= home[row]
                row, leaf = row[later], leaf[later]
                homes = np.repeat(home * slices, slices) + np.tile(np.arange(slices), len(fp))
                shard = np.concatenate([homes, leaf * slices + part[row]])
                out = np.concatenate([np.repeat(fp, slices), fp[row]])
                flag = np.arange(len(out)) < len(homes)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(out), pa.array(flag)], names=["shard", "fp", "at_home"])

    shards = distinct.select("fp").mapInArrow(deal, "shard long, fp long, at_home boolean")
    return shards.repartition("shard").mapInArrow(_shard(radius), "u long, v long")


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(u, v): every node of ``links`` (u, v) but the smallest of its component, with that smallest node."""

    def rooted(edges: DataFrame, n: int, small: bool) -> DataFrame:
        if small:
            seen = edges.select(F.greatest("u", "v").alias("c"), F.least("u", "v").alias("x"))
        else:
            seen = edges.select(F.col("u").alias("c"), F.col("v").alias("x")).union(edges.select("v", "u"))
        low = seen.groupBy("c").agg(F.min("x").alias("m"))
        joined = join_frequent(seen, low, "c", n).withColumn("m", F.least("m", "c"))
        ties = joined.where(F.col("x") > F.col("c") if not small else F.col("x") != F.col("m")).select(F.col("x").alias("u"), F.col("m").alias("v"))
        if small:
            ties = ties.union(low.select(F.col("c").alias("u"), F.least("m", "c").alias("v")))
        return ties.where("u != v").distinct()

    edges = stash(links.where("u != v").distinct(), "links")
    state = None
    for _ in range(max_rounds):
        n, old = 2 * edges.count(), edges
        edges = stash(rooted(rooted(edges, n, small=False), n, small=True), "stars")
        discard(old)
        new = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == state:
            return edges
        state = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _grouped(docs: DataFrame, id_col: str, text_col: str, radius: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(id, hash, fp) per row, and (fp, low, first, root) per distinct fingerprint: the smallest id, the first row that has it and its group."""
    fps = stash(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash"))
    distinct = stash(fps.groupBy("fp").agg(F.min("id").alias("low"), first.alias("first")), "distinct-fingerprints")
    roots = components(shard_links(distinct, radius)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    return fps, distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id
    that can be reached over links of at most ``radius`` differing bits."""
    fps, member = _grouped(docs, id_col, text_col, radius, shingle)
    group = member.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stash(join_frequent(member, group, "root", fps.count()).select("fp", "component_id"), "named-fingerprints")
    return join_frequent(fps, named, "fp", fps.count()).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The first row of each near-duplicate group of ``docs``: that with the smallest id, rows without one last; of rows
    that share it, that with the smallest hash of its text; of rows that repeat both, one."""
    _, member = _grouped(docs, id_col, text_col, radius, shingle)
    first = member.groupBy("root").agg(F.min("first").alias("r")).select(F.col("r.id").alias("_id"), F.col("r.hash").alias("_hash"))
    rows = docs.withColumn("_hash", text_hash(text_col))
    chosen = rows.join(first, F.col(id_col).eqNullSafe(F.col("_id")) & (rows["_hash"] == first["_hash"]), "left_semi")
    own = Window.partitionBy(id_col, "_hash").orderBy("_hash")
    return chosen.withColumn("_n", F.row_number().over(own)).where("_n = 1").select(*docs.columns)


def op2_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
