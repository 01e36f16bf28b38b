"""Repeated passages of a corpus, found exactly through suffix arrays.

A byte is removed if it lies in a string of ``length`` bytes that also starts
earlier: in a document before, or further left in the same one.  Documents are
ordered by id, then by a hash of their text.

1. Every window of ``length`` bytes picks an anchor: the byte run in it with the
   smallest hash.  Equal windows pick equal anchors, so only windows that share
   an anchor need to meet.  Neighbouring windows with one anchor form a stretch.
2. Within a batch of documents, the stretches of anchors that occur more than
   once are laid end to end; a two-stage suffix array orders their suffixes,
   adjacent common prefixes of at least ``length`` tell equal windows, and in
   each class the earliest start stays.  The others are settled as repeats.
3. What stays meets by anchor, without bytes: anchors that several batches have
   are wanted.  Anchors that a sample finds in a large share of the documents
   meet window by window instead (by a hash of the window), so that a phrase
   which is common in different contexts fills no bucket.
4. Bytes of wanted stretches are cut out of their texts and meet by anchor; the
   same suffix array settles them.
5. The repeated windows go back to their documents as intervals.

Hashes and the sample decide which stretches meet, never which are equal: that
is read off the suffix array, byte by byte.  Texts longer than ``CHUNK`` are read
in pieces that overlap by a window, and more bytes than ``LIMIT`` under one
anchor are sorted in turns, so that memory does not grow with either.

Defined results: null and empty texts have no bytes; documents without an id
come before all others; rows with one id and different texts are documents of
their own, in the order of a 64-bit hash of the text; rows that repeat both an
id and a text are one document, whose rows all get its result; an empty table
gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, table
from .ngrams import _BYTE, _power, mix
from .suffix_array import common_prefixes, suffix_array, words8

LENGTH = 100
ANCHOR = 37  # leaves 64 places for it in a window
CHUNK = 1 << 18
FLUSH = 8 << 20
SORTED = 1 << 20  # bytes that are sorted at once, as far as anchors stay whole
LIMIT = 2 << 20  # more bytes under one anchor are sorted in turns
HOT_SAMPLE = 4096  # documents that are looked at to find frequent anchors
HOT_DOCS = 8  # of them, as many as make an anchor a frequent one
MAX_HOT = 1 << 16
NO_ID = -(2**63)

#: A stretch: n windows from ``start`` on that share an anchor.  ``key`` is what it meets others by.
STRETCH = np.dtype([("key", "<u8"), ("anchor", "<u8"), ("doc", "<i8"), ("hash", "<i8"), ("start", "<u4"), ("n", "<u4")])
#: The same as it travels where key and anchor are one.
PLAIN = np.dtype([("key", "<u8"), ("doc", "<i8"), ("hash", "<i8"), ("start", "<u4"), ("n", "<u4")])
WINDOWS = np.dtype([("doc", "<i8"), ("hash", "<i8"), ("start", "<u4"), ("n", "<u4")])
_PLAIN, _HOT, _DONE = 0, 1, 2


class Batch:
    """Pieces of texts laid end to end: their bytes and stretches."""

    def __init__(self, length: int):
        self.length = length
        self.keys: list[tuple[int, int, int]] = []
        self.parts: list[bytes] = []
        self.size = 0

    def add(self, doc: int, hash_: int, text: bytes) -> None:
        for at in range(0, max(1, len(text) - self.length + 1), CHUNK):
            piece = text[at : at + CHUNK + self.length - 1]
            self.keys.append((doc, hash_, at))
            self.parts.append(piece)
            self.size += len(piece)

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stretches, where their bytes begin, all bytes)."""
        found, places, held, size, base = [], [], [], 0, 0
        for k, part in enumerate(self.parts):
            held.append(k)
            size += len(part)
            if size >= CHUNK or k == len(self.parts) - 1:
                rows, at = self._group(held)
                found.append(rows)
                places.append(at + base)
                base += size
                held, size = [], 0
        none = np.zeros(0, dtype=STRETCH)
        return np.concatenate([none, *found]), np.concatenate([np.zeros(0, dtype=np.int64), *places]), np.frombuffer(b"".join(self.parts), dtype=np.uint8)

    def _group(self, held: list[int]) -> tuple[np.ndarray, np.ndarray]:
        length = self.length
        sizes = np.array([len(self.parts[k]) for k in held], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        whole = sizes >= length
        if not whole.any():
            return np.zeros(0, dtype=STRETCH), np.zeros(0, dtype=np.int64)
        data = np.frombuffer(b"".join([self.parts[k] for k in held]), dtype=np.uint8)
        with np.errstate(over="ignore"):
            up, down = _power(len(data) + 1)
            total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[data] * up[:-1], dtype=np.uint64)])
            gram = mix((total[ANCHOR:] - total[:-ANCHOR]) * down[: len(data) - ANCHOR + 1])
        # The high bits order the anchors, the low bits are the place: ties go to the left.
        low = (gram & ~np.uint64(0xFFFFFF)) | np.arange(len(gram), dtype=np.uint64)
        places, span = length - ANCHOR + 1, 1
        while span < places:
            step = min(span, places - span)
            low = np.minimum(low[:-step], low[step:])
            span += step
        pick = (low & np.uint64(0xFFFFFF)).astype(np.int32)
        change = np.zeros(len(pick), dtype=bool)
        change[1:] = pick[1:] != pick[:-1]
        valid = np.ones(len(pick), dtype=bool)
        change[begin[:-1][whole]] = True
        for at, end in zip(begin[:-1], begin[1:]):  # windows that would leave their piece
            valid[max(at, end - length + 1) : min(end, len(valid))] = False
        start = np.nonzero(change & valid)[0]
        part = np.searchsorted(begin, start, side="right") - 1
        stop = np.minimum(np.append(start[1:], len(pick)), begin[part + 1] - length + 1)
        keys = np.array([self.keys[k] for k in held], dtype=np.int64)[part]
        out = np.empty(len(start), dtype=STRETCH)
        out["key"] = out["anchor"] = gram[pick[start]]
        out["doc"], out["hash"] = keys[:, 0], keys[:, 1]
        out["start"] = start - begin[part] + keys[:, 2]
        out["n"] = stop - start
        return out, start


def _same_as(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each piece of ``text`` the first one with the same bytes: a hash proposes it, the bytes decide."""
    with np.errstate(over="ignore"):
        up, down = _power(len(text) + 1)
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[text] * up[:-1], dtype=np.uint64)])
        code = mix((total[start + size] - total[start]) * down[start] + mix(size.astype(np.uint64)))
    _, first, index = np.unique(code, return_index=True, return_inverse=True)
    out = first[index]
    other = np.nonzero(out != np.arange(len(out)))[0]
    if len(other):
        other = other[size[other] == size[out[other]]]
        n = size[other]
        head = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(head, n)
        equal = text[inside + np.repeat(start[other], n)] == text[inside + np.repeat(start[out[other]], n)]
        alike = np.zeros(len(out), dtype=bool)
        alike[other] = np.logical_and.reduceat(equal, head) if len(other) else False
        out = np.where(alike, out, np.arange(len(out)))
    return out


def repeated(rows: np.ndarray, at: np.ndarray, data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each window of the stretches ``rows``, one after another, whether an equal one of them starts earlier.

    The stretches are in the order of their places.  Those with the same bytes are laid down once."""
    n = rows["n"].astype(np.int64)
    base = np.cumsum(n) - n
    laid = np.arange(len(rows))
    text, start = _laid_out(at, n + length - 1, data)
    first = _same_as(text, start, n + length - 1)
    gone = np.repeat(first != laid, n)
    if gone.any():
        laid = np.nonzero(first == laid)[0]
        n = n[laid]
        text, start = _laid_out(at[laid], n + length - 1, data)
    if len(laid) == 1 and n[0] <= length - ANCHOR + 1:
        return gone  # windows around one place of an anchor differ; a stretch with more of them holds several places
    size = n + length
    inside = np.arange(len(text)) - np.repeat(start, size)
    owner = np.repeat(np.arange(len(laid)), size)
    order = suffix_array(text, length)
    order = order[inside[order] < n[owner[order]]]
    same = common_prefixes(order, words8(text), length) >= length
    shared = same.copy()
    shared[:-1] |= same[1:]
    group = np.cumsum(~same)[shared]
    order = order[shared]
    if not len(order):
        return gone
    row = laid[owner[order]]
    window = base[row] + inside[order]
    place = rows["start"][row].astype(np.int64) + inside[order]
    by = np.lexsort((place, rows["hash"][row], rows["doc"][row], group))
    group, window, place, row = group[by], window[by], place[by], row[by]
    new = np.concatenate([[True], group[1:] != group[:-1]])
    low = np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
    own = lambda c: rows[c][row] != rows[c][row[low]]
    gone[window[own("doc") | own("hash") | (place != place[low])]] = True
    return gone


def _laid_out(at: np.ndarray, size: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces (at, size) of ``data`` one after another, each ended by a zero, and where they start; no byte of UTF-8 overflows by one."""
    start = np.cumsum(size + 1) - size - 1
    index = np.arange(int(size.sum() + len(size))) + np.repeat(at - start, size + 1)
    index[start + size] = 0
    text = data[index] + np.uint8(1)
    text[start + size] = 0
    return text, start


def _parted(rows: np.ndarray, at: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretches of windows that are gone, stretches of the others, where the bytes of these begin)."""
    n = rows["n"].astype(np.int64)
    base = np.cumsum(n) - n
    new = np.ones(len(gone), dtype=bool)
    new[1:] = gone[1:] != gone[:-1]
    new[base[n > 0]] = True
    head = np.nonzero(new)[0]
    own = np.searchsorted(base, head, side="right") - 1
    out = rows[own]
    out["start"] += (head - base[own]).astype(np.uint32)
    out["n"] = np.diff(np.append(head, len(gone)))
    off = gone[head]
    return out[off], out[~off], (at[own] + head - base[own])[~off]


def _pieces(key: np.ndarray, size: np.ndarray, limit: int):
    """Runs of ordered ``key`` of about ``limit`` bytes in which no key is parted."""
    if not len(key):
        return
    total = np.cumsum(size)
    begin, held = 0, 0
    for edge in (np.nonzero(key[1:] != key[:-1])[0] + 1).tolist():
        if total[edge - 1] - held >= limit:
            yield begin, edge
            begin, held = edge, total[edge - 1]
    yield begin, len(key)


def _window_keys(rows: np.ndarray, at: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of ``rows`` as stretches of their own, with a hash of their bytes as key."""
    n = rows["n"].astype(np.int64)
    own = np.repeat(np.arange(len(rows)), n)
    inside = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    out, place = rows[own], at[own] + inside
    out["start"] += inside.astype(np.uint32)
    out["n"] = 1
    up, _ = _power(length + 1)
    step = max(1, (1 << 21) // length)
    with np.errstate(over="ignore"):
        for low in range(0, len(out), step):
            bytes_ = data[place[low : low + step, None] + np.arange(length)]
            out["key"][low : low + step] = mix((_BYTE[bytes_] * up[:length]).sum(axis=1, dtype=np.uint64))
    return out, place


def settle(rows: np.ndarray, at: np.ndarray, data: np.ndarray, length: int = LENGTH, by_window: bool = False) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Parts of (repeats, what stays, where its bytes begin) among stretches; only those with equal keys can agree."""
    done, rest, places = [], [], []
    order = np.lexsort((rows["start"], rows["hash"], rows["doc"], rows["key"]))
    rows, at = rows[order], at[order]
    place = rows[["key", "doc", "hash", "start", "n"]]
    once = np.ones(len(rows), dtype=bool)  # rows that repeat an id and a text bring their stretches twice
    once[1:] = place[1:] != place[:-1]
    rows, at = rows[once], at[once]

    def sort(r: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _parted(r, a, repeated(r, a, data, length)) if len(r) else (r, r, a)

    for low, high in _pieces(rows["key"], rows["n"].astype(np.int64) + length - 1, SORTED):
        r, a = rows[low:high], at[low:high]
        size = np.cumsum(r["n"].astype(np.int64) + length - 1)
        # The stretches of a frequent key: in turns first, so that equal ones are few before all of them meet.
        while size[-1] > LIMIT:
            left, kept = [], []
            turns = np.append(0, np.searchsorted(size, np.arange(LIMIT, size[-1] + LIMIT, LIMIT)))
            turns[-1] = len(r)
            for i, j in zip(turns[:-1], turns[1:]):
                d, s, p = sort(r[i:j], a[i:j])
                done.append(d)
                left.append(s)
                kept.append(p)
            was = size[-1]
            r, a = np.concatenate(left), np.concatenate(kept)
            size = np.cumsum(r["n"].astype(np.int64) + length - 1)
            if size[-1] > was * 0.7 and not by_window:
                parts = settle(*_window_keys(r, a, data, length), data, length, True)
                for own, more in zip((done, rest, places), parts):
                    own += more
                r, a, size = r[:0], a[:0], np.zeros(1)
            elif size[-1] > was * 0.7:
                break  # different windows with one hash: there are not many
        d, s, p = sort(r, a)
        done.append(d)
        rest.append(s)
        places.append(p)
    return done, rest, places


def merged(rows: np.ndarray) -> np.ndarray:
    """Stretches as few intervals of windows."""
    rows = rows[np.lexsort((rows["start"], rows["hash"], rows["doc"]))]
    end = rows["start"].astype(np.int64) + rows["n"]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows["doc"][1:] != rows["doc"][:-1]) | (rows["hash"][1:] != rows["hash"][:-1]) | (rows["start"][1:] > end[:-1])
    head = np.nonzero(new)[0]
    out = np.empty(len(head), dtype=WINDOWS)
    for c in ("doc", "hash", "start"):
        out[c] = rows[c][head]
    # Rows that repeat a document may nest.
    out["n"] = (np.maximum.reduceat(end, head) if len(head) else end[:0]) - out["start"]
    return out


def _packed(rows: np.ndarray) -> bytes:
    """Rows as compressed planes of bytes, which are mostly zeros or alike."""
    planes = np.frombuffer(rows.tobytes(), dtype=np.uint8).reshape(-1, rows.dtype.itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def _unpacked(blob: bytes, dtype: np.dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8).reshape(dtype.itemsize, -1)
    return np.frombuffer(planes.T.tobytes(), dtype=dtype)


def _blobs(rows: np.ndarray, key: np.ndarray, buckets: int, kind: int) -> pa.RecordBatch:
    bucket = ((key >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cut = np.nonzero(np.diff(bucket))[0] + 1
    head = np.concatenate([[0], cut]) if len(rows) else cut
    blobs = [_packed(x) for x in np.split(rows, cut)] if len(rows) else []
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[head], pa.int64()), pa.array(np.full(len(head), kind), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "kind", "rows"]
    )


def _find(length: int, buckets: int, hot):
    def flush(batch: Batch):
        rows, at, data = batch.stretches()
        order = np.argsort(rows["key"], kind="stable")
        rows, at = rows[order], at[order]
        twin = rows["key"][1:] == rows["key"][:-1]
        multiple = np.zeros(len(rows), dtype=bool)
        multiple[1:] |= twin
        multiple[:-1] |= twin
        done, rest, places = settle(rows[multiple], at[multiple], data, length)
        rest, places = np.concatenate([rows[~multiple], *rest]), np.concatenate([at[~multiple], *places])
        frequent = np.isin(rest["anchor"], hot.value)
        slim = np.empty(int((~frequent).sum()), dtype=PLAIN)
        for c in PLAIN.names:
            slim[c] = rest[c][~frequent]
        yield _blobs(slim, slim["key"], buckets, _PLAIN)
        if frequent.any():
            windows, _ = _window_keys(rest[frequent], places[frequent], data, length)
            yield _blobs(windows, windows["key"], buckets, _HOT)
        gone = merged(np.concatenate([rows[:0], *done]))
        if len(gone):
            yield _blobs(gone, mix(gone["hash"].view(np.uint64)), buckets, _DONE)

    def run(batches):
        batch = Batch(length)
        for b in batches:
            for doc, hash_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                batch.add(doc, hash_, text.as_py())
                if batch.size >= FLUSH:
                    yield from flush(batch)
                    batch = Batch(length)
        if batch.parts:
            yield from flush(batch)

    return run


_ROW = "doc long, hash long, start long, n long, anchor long"


def _rows_out(rows: np.ndarray, wanted: bool):
    for low in range(0, len(rows), 100_000):
        p = rows[low : low + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(p["doc"]), pa.array(p["hash"]), pa.array(p["start"].astype(np.int64)), pa.array(p["n"].astype(np.int64)),
             pa.array(p["anchor"].view(np.int64)) if wanted else pa.nulls(len(p), pa.int64())],
            names=["doc", "hash", "start", "n", "anchor"],
        )


def _meet(batches):
    """Per bucket: repeats (anchor null) and the stretches whose key several batches have."""
    plain, hot = [], []
    for b in batches:
        for kind, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            if kind == _DONE:
                yield from _rows_out(_unpacked(blob, WINDOWS), False)
            else:
                (plain if kind == _PLAIN else hot).append(_unpacked(blob, PLAIN if kind == _PLAIN else STRETCH))
    for blobs in (plain, hot):
        if not blobs:
            continue
        rows = np.concatenate(blobs)
        origin = np.repeat(np.arange(len(blobs)), [len(x) for x in blobs])
        order = np.argsort(rows["key"], kind="stable")  # blobs stay in order within a key
        key, origin = rows["key"][order], origin[order]
        head = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
        if not len(head):
            continue
        last = np.append(head[1:], len(key)) - 1
        several = np.repeat(origin[head] != origin[last], last - head + 1)
        chosen = rows[order[several]]
        out = np.zeros(len(chosen), dtype=STRETCH)
        for c in chosen.dtype.names:
            out[c] = chosen[c]
        if "anchor" not in chosen.dtype.names:
            out["anchor"] = out["key"]
        yield from _rows_out(out, True)


def _cut_out(length: int, buckets: int):
    """The bytes of wanted stretches, by anchor."""

    def run(batches):
        for b in batches:
            heads, texts = [], []
            for doc, hash_, text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                w = wanted.values
                start, n, anchor = (w.field(k).to_numpy() for k in range(3))
                order = np.lexsort((start, anchor))
                start, n, anchor = start[order], n[order], anchor[order]
                new = np.ones(len(start), dtype=bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] > start[:-1] + n[:-1])
                first = np.nonzero(new)[0]  # windows that met one by one are a stretch again
                end = np.maximum.reduceat(start + n, first)
                start, anchor = start[first], anchor[first]
                head = np.empty(len(start), dtype=STRETCH)
                head["key"] = head["anchor"] = anchor.view(np.uint64)
                head["doc"], head["hash"], head["start"], head["n"] = doc, hash_, start, end - start
                heads.append(head)
                text = text.as_py()
                texts += [text[i : j + length - 1] for i, j in zip(start.tolist(), end.tolist())]
            if not heads:
                continue
            rows = np.concatenate(heads)
            bucket = ((rows["key"] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.split(order, np.nonzero(np.diff(bucket[order]))[0] + 1)
            slim = np.empty(len(rows), dtype=PLAIN)
            for c in PLAIN.names:
                slim[c] = rows[c]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([bucket[c[0]] for c in cut], pa.int64()),
                    pa.array([_packed(slim[c]) for c in cut], pa.binary()),
                    pa.array([zstandard.compress(b"".join([texts[k] for k in c]), 1) for c in cut], pa.binary()),
                ],
                names=["bucket", "rows", "bytes"],
            )

    return run


def _compare(length: int):
    def run(batches):
        heads, data = [], []
        for b in batches:
            heads += [_unpacked(r, PLAIN) for r in b.column(1).to_pylist()]
            data += [zstandard.decompress(x) for x in b.column(2).to_pylist()]
        if not heads:
            return
        slim, bytes_ = np.concatenate(heads), np.frombuffer(b"".join(data), dtype=np.uint8)
        del heads, data
        rows = np.zeros(len(slim), dtype=STRETCH)
        for c in PLAIN.names:
            rows[c] = slim[c]
        size = rows["n"].astype(np.int64) + length - 1
        at = np.cumsum(size) - size
        done, _, _ = settle(rows, at, bytes_, length)
        for d in done:
            yield from _rows_out(merged(d), False)

    return run


def frequent_anchors(rows: DataFrame, length: int = LENGTH) -> np.ndarray:
    """Anchors that at least ``HOT_DOCS`` of about ``HOT_SAMPLE`` sampled documents have, the most frequent first.

    They decide how stretches meet, not what is found."""
    count = rows.count()
    part = rows if count <= HOT_SAMPLE else rows.sample(HOT_SAMPLE / count, 5)

    def run(batches):
        for b in batches:
            for text in b.column(0):
                batch = Batch(length)
                batch.add(0, 0, text.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(batch.stretches()[0]["anchor"]).view(np.int64))], names=["anchor"])

    counts = part.select("t").mapInArrow(run, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_DOCS)
    got = counts.orderBy(F.desc("n"), "anchor").limit(MAX_HOT).select("anchor").toPandas()["anchor"]
    return np.sort(got.to_numpy(np.int64).view(np.uint64))


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """(doc, hash, t): what tells documents apart, and the bytes."""
    t = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(t).alias("hash"), t.alias("t"), *more)


def repeated_intervals(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, hash, start, n): n windows from ``start`` on that also start earlier."""
    if not ANCHOR < length < ANCHOR + 255:
        raise ValueError(f"the length must be between {ANCHOR + 1} and {ANCHOR + 254}")
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _keyed(docs, id_col, text_col)
    hot = spark.sparkContext.broadcast(frequent_anchors(rows, length))  # at most MAX_HOT numbers
    found = rows.mapInArrow(_find(length, buckets, hot), "bucket long, kind int, rows binary")
    met = stash(found.repartition("bucket").mapInArrow(_meet, _ROW), "stretches")
    wanted = (
        met.where("anchor is not null").groupBy("doc", "hash").agg(F.collect_list(F.struct("start", "n", "anchor")).alias("wanted"))
    )  # as many as the document is long
    cut = rows.join(wanted, ["doc", "hash"]).select("doc", "hash", "t", "wanted").mapInArrow(_cut_out(length, buckets), "bucket long, rows binary, bytes binary")
    compared = cut.repartition("bucket").mapInArrow(_compare(length), _ROW)
    return met.where("anchor is null").union(compared).select("doc", "hash", "start", "n")


def _spans(start: np.ndarray, n: np.ndarray, length: int, size: int) -> np.ndarray:
    """Maximal removed runs (from, to) of a text of ``size`` bytes."""
    order = np.argsort(start, kind="stable")
    low = start[order]
    high = np.maximum.accumulate(np.minimum(low + n[order] - 1 + length, size))
    new = np.concatenate([[True], low[1:] > high[:-1]])
    at = np.nonzero(new)[0]
    return np.stack([low[at], high[np.append(at[1:], len(low)) - 1]], axis=1)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, and with ``texts`` the remaining ``kept_text``
    (characters cut in two are dropped from it) and the columns ``keep``."""
    at = stash(
        repeated_intervals(docs, length, id_col, text_col)
        .groupBy("doc", "hash").agg(F.collect_list(F.struct("start", "n")).alias("windows")), "intervals"
    )
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            sizes, removed, spans, sums, kept_texts = [], [], [], [], []
            for text, windows in zip(b.column(1), b.column(2)):
                text = text.as_py()
                kept, k = text, 0
                if windows.is_valid:
                    w = windows.values
                    cuts = _spans(w.field(0).to_numpy(), w.field(1).to_numpy(), length, len(text))
                    k = len(cuts)
                    edges = [0, *cuts.ravel().tolist(), len(text)]
                    kept = b"".join([text[i:j] for i, j in zip(edges[::2], edges[1::2])])
                sizes.append(len(text))
                removed.append(len(text) - len(kept))
                spans.append(k)
                sums.append(hashlib.sha256(kept).hexdigest())
                if texts:
                    kept_texts.append(kept.decode("utf-8", "ignore"))
            out = [b.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(sums, pa.string())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                out, names = [*out, pa.array(kept_texts, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays([*out, *b.columns[3:]], names=[*names, *b.schema.names[3:]])

    rows = _keyed(docs, id_col, text_col, F.col(id_col).alias("id"), *[F.col(c).alias(f"_{c}") for c in keep])
    joined = rows.join(at, ["doc", "hash"], "left").select("id", "t", "windows", *[f"_{c}" for c in keep])
    schema = f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * texts
    schema += "".join(f", `{c}` {t}" for c, t in joined.drop("id", "t", "windows").dtypes)
    return joined.mapInArrow(run, schema).withColumnsRenamed({"id": id_col} | {f"_{c}": c for c in keep})


def op5_suffix_array_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
