"""Cropped or edited copies of images, through local descriptors.

1. Images with equal pixels collapse to one, so that exact copies are never compared.
2. Corners of every scale are kept where the Harris response is the largest
   within ``APART`` pixels: a rule that looks at the neighbourhood only, so that
   their number grows with the image and a crop keeps those it shows.  Each gets
   an orientation (its patch's centre of brightness) and 256 brightness
   comparisons turned by it.
3. Hamming tables: the 256 bits make two keys of 128 bits, so long that patches
   without much in them do not fill buckets; two descriptors meet if one key is
   equal (by a 64-bit hash of it).  In a bucket of up to ``reach`` + 1 rows each row meets
   those before it; a larger one is parted into blocks, and all blocks meet.
4. Geometric consensus: each match names a turn, a scale and a shift; two images
   are linked when at least ``votes`` corners agree in one cell of those.
5. Links join into components; each image is named by the smallest id.

Scale: steps 2-4 move fixed-size rows per corner; a key that many corners share
costs the square of its rows, spread over tasks of ``BLOCK`` rows by ``BLOCK``.
Pixels never leave the task that reads them.  One task holds the matches of two
images at a time.  Images are told apart by a 64-bit hash of their digest.

Defined results: a null, empty or wrongly sized image has no corners and is
linked to nothing but equal rows; images too small for a patch likewise; repeated
rows share a component; different images with one id are compared each for
itself; null ids are ignored when the smallest is taken, and images without any
id are compared like others; of corners with equal responses within ``APART`` all
are kept; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, table
from .ngrams import mix
from .simhash import components

APART = 2  # a corner is the largest response within so many pixels
PATCH = 9
TURNS = 32
BITS = 256
REACH = 8  # larger buckets than one row and those before it are parted
BLOCK = 256  # rows of a bucket that meet as one block
VOTES = 5
CELL = 16.0
TURN_CELL = 4

_rng = np.random.default_rng(256)


def _tests() -> np.ndarray:
    """(turns, bits, 4) row and column offsets of the comparisons, per turn of the patch."""
    r, a = PATCH * np.sqrt(_rng.random((BITS, 2))), 2 * math.pi * _rng.random((BITS, 2))
    out = []
    for k in range(TURNS):
        turned = a + 2 * math.pi * k / TURNS
        y, x = np.rint(r * np.sin(turned)), np.rint(r * np.cos(turned))
        out.append(np.stack([y[:, 0], x[:, 0], y[:, 1], x[:, 1]], axis=1))
    return np.array(out, dtype=np.int32)


_TESTS = _tests()
_DISC_Y, _DISC_X = (v.ravel() for v in np.mgrid[-7:8, -7:8])
_IN = _DISC_Y**2 + _DISC_X**2 <= 50
_DISC_Y, _DISC_X = _DISC_Y[_IN], _DISC_X[_IN]


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of side 2r+1, the same shape with a zero rim."""
    s = np.zeros((a.shape[0] + 1, a.shape[1] + 1), dtype=np.float64)
    np.cumsum(np.cumsum(a, axis=0), axis=1, out=s[1:, 1:])
    k = 2 * r + 1
    out = np.zeros(a.shape)
    out[r:-r, r:-r] = s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]
    return out


def _largest_near(a: np.ndarray, r: int) -> np.ndarray:
    """The largest value of each square of side 2r+1."""
    for axis in (0, 1):
        padded = np.pad(a, [(r, r) if k == axis else (0, 0) for k in (0, 1)], constant_values=-np.inf)
        a = np.lib.stride_tricks.sliding_window_view(padded, 2 * r + 1, axis=axis).max(axis=-1)
    return a


def corners(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the corners, far enough from the rim for a turned patch."""
    rim = PATCH + 3
    if min(image.shape) <= 2 * rim + 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    dy, dx = np.zeros_like(image), np.zeros_like(image)
    dy[1:-1], dx[:, 1:-1] = image[2:] - image[:-2], image[:, 2:] - image[:, :-2]
    yy, xx, xy = _box(dy * dy, 2), _box(dx * dx, 2), _box(dy * dx, 2)
    response = yy * xx - xy * xy - 0.05 * (yy + xx) ** 2
    core = response[rim:-rim, rim:-rim]
    y, x = np.nonzero((core >= _largest_near(response, APART)[rim:-rim, rim:-rim]) & (core > 1.0))
    return y + rim, x + rim


def describe(image: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Per scale: rows, columns (of the full image), turn, scale and (n, 4) unsigned words."""
    out = []
    level, scale = image.astype(np.float64), 0
    while min(level.shape) >= 2 * PATCH + 8:
        y, x = corners(level)
        if len(y):
            smooth = _box(level, 2)
            patch = level[y[:, None] + _DISC_Y, x[:, None] + _DISC_X]
            angle = np.arctan2((patch * _DISC_Y).sum(axis=1), (patch * _DISC_X).sum(axis=1))
            turn = np.rint(angle / (2 * math.pi) * TURNS).astype(np.int64) % TURNS
            t = _TESTS[turn]
            bits = smooth[y[:, None] + t[:, :, 0], x[:, None] + t[:, :, 1]] < smooth[y[:, None] + t[:, :, 2], x[:, None] + t[:, :, 3]]
            out.append((y << scale, x << scale, turn, np.full(len(y), scale), np.packbits(bits, axis=1).view(np.uint64)))
        h, w = (n // 2 * 2 for n in level.shape)
        level, scale = (level[:h:2, :w:2] + level[1:h:2, :w:2] + level[:h:2, 1:w:2] + level[1:h:2, 1:w:2]) / 4, scale + 1
    return out


def packed_place(y: np.ndarray, x: np.ndarray, turn: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """A corner's geometry in one long; it carries it through all later exchanges and tells corners of an image apart."""
    return ((y + 32768) << 48) | ((x + 32768) << 32) | (turn << 24) | (scale << 20)


def keys(words: np.ndarray) -> list[np.ndarray]:
    """One long per table: a hash of two words; tables have hashes of their own, so that all share one exchange."""
    with np.errstate(over="ignore"):
        return [mix(words[:, 2 * t] + mix(words[:, 2 * t + 1] + np.uint64(t))).view(np.int64) for t in range(2)]


def _describe_rows(batches):
    names = ("g", "k0", "k1")
    for b in batches:
        ends, columns, found = [0], [[] for _ in names], 0
        for w, h, pixels in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
            pixels = pixels.as_py()
            if pixels and w and h and len(pixels) == w * h and max(w, h) < 65536:
                image = np.frombuffer(pixels, dtype=np.uint8).reshape(h, w)
                for y, x, turn, scale, words in describe(image):
                    # Places are counted from the middle, where a wrong turn shifts least.
                    for c, v in zip(columns, (packed_place(y - h // 2, x - w // 2, turn, scale), *keys(words))):
                        c.append(v)
                    found += len(y)
            ends.append(found)
        flat = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in columns]
        points = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, names=list(names)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(4), b.column(5), points], names=["id", "digest", "image", "points"])


def meetings(points: DataFrame, reach: int = REACH) -> DataFrame:
    """(a, b, ga, gb) with a < b: every two corners (id, g, key) of different images that share a key."""
    bucket = Window.partitionBy("key")
    # The rows before it are all that a row of a small bucket can meet.
    before = [F.struct(F.lag("id", r).over(bucket.orderBy("id", "g")).alias("a"), F.lag("g", r).over(bucket.orderBy("id", "g")).alias("ga")) for r in range(1, reach + 1)]
    counted = points.select("id", "g", "key", F.array(*before).alias("before"), F.count("*").over(bucket).alias("rows"))
    small = F.col("rows") <= reach + 1
    shared = counted.where((F.col("rows") > 1) & (~small | F.col("before")[0]["a"].isNotNull()))
    slim = lambda keep, c: F.when(keep, F.col(c)).alias(c)
    known = F.filter("before", lambda o: o["a"].isNotNull())
    met = stash(shared.select("id", "g", F.when(small, known).alias("before"), *[slim(~small, c) for c in ("key", "rows")]), "shared-keys")
    near = (
        met.where("rows is null")
        .select(F.col("id").alias("b"), F.col("g").alias("gb"), F.explode("before").alias("o"))
        .where("o.a < b")
        .select(F.col("o.a").alias("a"), "b", F.col("o.ga").alias("ga"), "gb")
    )
    # A frequent key is parted into blocks of images, and every two blocks are a task's work of their own.
    parted = met.where("rows is not null").withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    parted = parted.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = parted.select("key", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), F.struct("id", "g").alias("p"))
    right = parted.select("key", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"), F.struct("id", "g").alias("q"))
    far = (
        left.join(right, ["key", "i", "j"])
        .where("p.id < q.id or (p.id > q.id and i < j)")  # in one block both orders meet
        .select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.g").alias("ga"), F.col("y.g").alias("gb"))
    )
    return near.unionByName(far)


def agreeing(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, votes: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of which at least ``votes`` different corners agree in turn, scale and shift; rows lie in the order of pairs."""
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    pair = np.cumsum(new) - 1
    place = lambda g: ((g >> 48 & 0xFFFF) - 32768.0, (g >> 32 & 0xFFFF) - 32768.0)
    (ya, xa), (yb, xb) = place(ga), place(gb)
    theta = ((gb >> 24 & 0xFF) - (ga >> 24 & 0xFF)) % TURNS
    grown = (gb >> 20 & 0xF) - (ga >> 20 & 0xF)
    angle, factor = theta * (2 * math.pi / TURNS), 2.0**grown
    dx = xb - factor * (np.cos(angle) * xa - np.sin(angle) * ya)
    dy = yb - factor * (np.sin(angle) * xa + np.cos(angle) * ya)
    linked = np.zeros(pair[-1] + 1, dtype=bool)
    # Two grids, half a cell apart, per dimension: what agrees within half a cell shares a cell of one of them.
    for grid in range(8):
        shift = [(grid >> k & 1) / 2 for k in range(3)]
        cell = [np.floor(v / CELL + s).astype(np.int64) & 0xFFFF for v, s in zip((dx, dy), shift)]
        turn = np.floor(theta / TURN_CELL + shift[2]).astype(np.int64) % (TURNS // TURN_CELL)
        code = cell[0] << 32 | cell[1] << 16 | turn << 8 | (grown + 16)
        order = np.lexsort((ga, code, pair))
        p, c, g = pair[order], code[order], ga[order]
        group = np.concatenate([[True], (p[1:] != p[:-1]) | (c[1:] != c[:-1])])
        corner = group | np.concatenate([[True], g[1:] != g[:-1]])
        head = np.nonzero(group)[0]
        linked[p[head[np.add.reduceat(corner.astype(np.int64), head) >= votes]]] = True
    first = np.nonzero(new)[0][linked]
    return a[first], b[first]


def _consensus(votes: int):
    """Rows come in the order of pairs; those of one pair are settled together."""

    def run(batches):
        held: list[list[np.ndarray]] = []
        size = 0

        def out(columns):
            a, b = agreeing(*columns, votes)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += len(batch)
            if size >= 100_000:
                columns = [np.concatenate(c) for c in zip(*held)]
                a, b = columns[:2]
                last = np.nonzero((a != a[-1]) | (b != b[-1]))[0]
                cut = last[-1] + 1 if len(last) else 0  # the last pair may go on
                if cut:
                    yield out([c[:cut] for c in columns])
                held = [[c[cut:] for c in columns]]
                size = len(held[0][0])
        if held:
            yield out([np.concatenate(c) for c in zip(*held)])

    return run


def copies(images: DataFrame, id_col: str = "image_id", reach: int = REACH, votes: int = VOTES) -> DataFrame:
    """Per row of ``images`` (id, width, height, pixels: one grey byte each): id, component_id,
    n_links (other distinct images linked to its own) and n_points."""
    size = F.concat_ws("x", F.coalesce("width", F.lit(-1)), F.coalesce("height", F.lit(-1)))
    pixels = F.coalesce("pixels", F.lit(b""))
    rows = images.select(F.col(id_col).cast("long").alias("id"), "width", "height", pixels.alias("p"), F.unhex(F.sha2(F.concat(size.cast("binary"), pixels), 256)).alias("digest"))
    rows = rows.withColumn("image", F.xxhash64("digest"))
    described = stash(rows.mapInArrow(_describe_rows, "id long, digest binary, image long, points array<struct<g:long,k0:long,k1:long>>"), "image-points")
    # Equal images are one.
    distinct = stash(described.groupBy("image").agg(F.min("id").alias("low"), F.count("*").alias("rows"), F.first(F.size("points")).alias("n_points")), "distinct-images")
    again = distinct.where("rows > 1").select("image")
    if again.limit(1).count():
        # Their points are wanted once; ``first`` combines before the exchange.
        twins = described.join(again, "image", "left_semi").groupBy("image").agg(F.first("points").alias("points"))
        kept = described.join(again, "image", "left_anti").select("image", "points").unionByName(twins)
    else:
        kept = described.select("image", "points")
    points = kept.select(F.col("image").alias("id"), F.explode("points").alias("q")).select(
        "id", F.col("q.g").alias("g"), F.explode(F.array("q.k0", "q.k1")).alias("key")
    )
    # The only exchange of pairs: all that follows is settled pair by pair.
    pairs = meetings(points, reach).select("a", "b", "ga", "gb").repartition("a", "b").sortWithinPartitions("a", "b")
    links = stash(pairs.mapInArrow(_consensus(votes), "a long, b long"), "image-links")
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    degree = links.select(F.col("a").alias("image")).unionByName(links.select(F.col("b").alias("image"))).groupBy("image").agg(F.count("*").alias("n_links"))
    member = distinct.join(roots.select(F.col("u").alias("image"), F.col("v").alias("root")), "image", "left").withColumn("root", F.coalesce("root", "image"))
    group = member.groupBy("root").agg(F.min("low").alias("component_id"))
    named = (
        member.join(group, "root").join(degree, "image", "left")
        .select("image", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_points")
    )
    return described.select("id", "image").join(named, "image").select(F.col("id").alias(id_col), "component_id", "n_links", "n_points")


SIDE = 96


def _up(n: int) -> np.ndarray:
    at = np.linspace(0, n - 1, SIDE)
    low = np.minimum(at.astype(int), n - 2)
    u = np.zeros((SIDE, n))
    u[np.arange(SIDE), low], u[np.arange(SIDE), low + 1] = 1 - (at - low), at - low
    return u


_UP8, _UP24 = _up(8), _up(24)


def render(vector: np.ndarray) -> np.ndarray:
    """A grey picture that a vector determines: its values as a coarse relief under seeded fine texture."""
    v = np.resize(np.nan_to_num(np.asarray(vector, dtype=np.float32)), 64) if len(vector) else np.zeros(64, dtype=np.float32)
    seed = np.frombuffer(v.astype("<f4").tobytes(), dtype=np.uint32)
    fine = np.random.Generator(np.random.Philox(np.random.SeedSequence(seed.tolist()))).random((24, 24))
    relief = _UP8 @ v.reshape(8, 8).astype(np.float64) @ _UP8.T
    spread = max(float(np.ptp(relief)), 1e-6)
    picture = 60 * (relief - relief.min()) / spread + 170 * (_UP24 @ fine @ _UP24.T)
    return np.clip(picture, 0, 255).astype(np.uint8)


def edited(picture: np.ndarray, number: int) -> np.ndarray:
    """An edited copy: cropped, brightened, turned by a quarter or all of them, as ``number`` says."""
    kind = number % 4
    if kind in (0, 3):
        y, x = number // 4 % 16, number // 64 % 16
        picture = picture[y : y + 78, x : x + 78]
    if kind in (1, 3):
        picture = np.clip(picture.astype(np.float64) * (0.8 + 0.02 * (number % 7)) + number % 20, 0, 255).astype(np.uint8)
    if kind in (2, 3):
        picture = np.rot90(picture)
    return np.ascontiguousarray(picture)


def pictures(embeddings: DataFrame) -> DataFrame:
    """Two images per vector: 2 * vec_id and, edited, 2 * vec_id + 1."""

    def run(batches):
        import zlib

        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.slice(at, 500)
                ids, shapes, data = [], [], []
                for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    picture = render(np.array([0.0 if x is None else x for x in v or []]))
                    for n, p in enumerate((picture, edited(picture, zlib.crc32(picture.tobytes())))):
                        ids.append(None if k is None else 2 * k + n)
                        shapes.append(p.shape)
                        data.append(p.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([s[1] for s in shapes], pa.int32()), pa.array([s[0] for s in shapes], pa.int32()), pa.array(data, pa.binary())],
                    names=["image_id", "width", "height", "pixels"],
                )

    return embeddings.select("vec_id", "embedding").mapInArrow(run, "image_id long, width int, height int, pixels binary")


def op4_image_copies(spark, sf_dir):
    """The given tables hold no images: every vector of ``embeddings`` is drawn, once plain and once edited."""
    return copies(pictures(table(spark, sf_dir, "embeddings")))
