"""Sentences and chunks: spans, sizes and greedy packing of sentences into chunks.

A chunk of ``chunk_size`` leaves two places for its begin and end ids, so
packing works with ``chunk_size - 2``.  Ends are exclusive everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType


def sentences(text: Column) -> Column:
    """Sentences with the blanks that follow them: end to end they are the text.

    A sentence ends with marks of .!? before a blank or line end (no model, one rule for all languages).
    """
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?]+[ \n]+)", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: s != "")


@F.arrow_udf(ArrayType(LongType()))
def _sums_before(rows: pa.Array) -> pa.Array:
    n = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    flat = rows.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(flat)])
    out = total[:-1] - np.repeat(total[ends[:-1]], n)
    mask = pa.array(~np.array(rows.is_valid())) if rows.null_count else None
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out), mask=mask)


def prefix_sums(sizes: Column) -> Column:
    """Sums before each element, an Arrow batch at a time: a fold would copy its array at each step."""
    return _sums_before(sizes)


# So that no filter over what is made of the sums is moved below them, where it could not be evaluated.
_sums_before = _sums_before.asNondeterministic()


def spans(sizes: Column) -> Column:
    """Contiguous (start, end) spans of the sizes."""
    return F.zip_with(prefix_sums(sizes), sizes, lambda s, n: F.struct(s.alias("start"), (s + n).alias("end")))


def sizes_of(spans_: Column) -> Column:
    return F.transform(spans_, lambda s: (s["end"] - s["start"]).cast("int"))


def contiguous(starts: Column, length: Column) -> Column:
    """Spans whose ends are the next starts, the last one ``length``."""
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(length))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def trimmed(sizes: Column, limit: int) -> Column:
    """Sizes cut into pieces of at most ``limit``."""
    pieces = lambda n: F.transform(F.sequence(F.lit(0), F.ceil(n / limit).cast("int") - 1), lambda k: F.least(F.lit(limit), n - k * limit).cast("int"))
    return F.flatten(F.transform(F.filter(sizes, lambda n: n > 0), pieces))


def greedy(pieces: Column, limit: int) -> Column:
    """Chunk sizes: neighbours are joined while they fit into ``limit``."""
    start = F.struct(F.lit(0).alias("open"), F.array().cast("array<int>").alias("done"))
    step = lambda a, n: F.when(a["open"] + n <= limit, F.struct((a["open"] + n).alias("open"), a["done"].alias("done"))).otherwise(
        F.struct(n.alias("open"), F.array_append(a["done"], a["open"]).alias("done"))
    )
    return F.aggregate(pieces, start, step, lambda a: F.when(a["open"] > 0, F.array_append(a["done"], a["open"])).otherwise(a["done"]))


def aligned(sizes: Column, limit: int) -> Column:
    """Strategy ``aligned``: long sentences are cut, then neighbours joined."""
    return greedy(trimmed(sizes, limit), limit)


def fold_sentences(sizes: list[int], limit: int) -> list[int]:
    """Strategy ``sentences``: a sentence over the limit closes the open chunk, its full pieces stand alone and its tail stays open."""
    done, held = [], 0
    for n in sizes:
        if held + n <= limit:
            held += n
            continue
        if held:
            done.append(held)
        full, held = divmod(n, limit)
        if n <= limit:
            full, held = 0, n
        done += [limit] * full
    return [*done, held] if held else done


def fold_equal_parts(sizes: list[int], limit: int) -> list[int]:
    """Legacy rule: a sentence over the limit is cut into near-equal parts; the chunk before it is closed even if empty."""
    done, held = [], 0
    for n in sizes:
        if n > limit:
            done.append(held)
            parts = -(-n // limit)
            cut = [n // parts + (k < n % parts) for k in range(parts)]
            done += cut[:-1]
            held = cut[-1]
        elif held + n > limit:
            done.append(held)
            held = n
        else:
            held += n
    return [*done, held] if held else done


FOLDS: dict[str, Callable[[list[int], int], list[int]]] = {"sentences": fold_sentences, "equal_parts": fold_equal_parts}


def folded(docs: DataFrame, sizes: str, limit: int, strategy: str, name: str = "chunks") -> DataFrame:
    """Chunk sizes by one of the folds that carry state over sentences: linear, an Arrow batch at a time."""
    fold = FOLDS[strategy]

    @F.arrow_udf("array<int>")
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([fold(r or [], limit) for r in rows.to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn(name, run(F.col(sizes)))


def sentence_ends(text: Column) -> Column:
    """Places (exclusive, in characters) where sentences end; the last one is the length of the text."""
    lens = F.transform(sentences(text), lambda s: F.length(s))
    return F.zip_with(prefix_sums(lens), lens, lambda a, n: a + n)


def token_sentences(starts: np.ndarray, ends: np.ndarray, sentence_ends: np.ndarray) -> np.ndarray:
    """Where the tokens of each sentence begin: with the last token that starts at or before it; from there to the next."""
    if not len(starts) or not len(sentence_ends):
        return np.zeros(0, dtype=np.int64)
    begins = np.concatenate([[0], sentence_ends[:-1]])
    return np.maximum(np.searchsorted(starts, begins, side="right") - 1, 0)


def aligned_chunks(starts: np.ndarray, ends: np.ndarray, sentence_ends: np.ndarray, limit: int) -> list[int]:
    """Chunk sizes in tokens: sentences by offsets, cut to ``limit``, neighbours joined while they fit."""
    first = token_sentences(starts, ends, sentence_ends)
    sizes = np.diff(np.append(first, len(starts))).tolist()
    out, held = [], 0
    for n in sizes:
        full, rest = divmod(n, limit)
        for piece in [limit] * full + ([rest] if rest else []):
            if held and held + piece > limit:
                out.append(held)
                held = 0
            held += piece
    return [*out, held] if held else out


def small_chunks(starts: np.ndarray, ends: np.ndarray, sentence_ends: np.ndarray, limit: int) -> list[int]:
    """Chunk sizes by the carried-tail rule: a token belongs to the first sentence that ends after its start; what starts
    after the last sentence is dropped."""
    edges = np.searchsorted(starts, sentence_ends, side="left")
    out, held = [], 0
    for n in np.diff(np.concatenate([[0], np.maximum.accumulate(edges)])).tolist():
        if n > limit:
            if held:
                out.append(held)
            full, held = divmod(n, limit)
            out += [limit] * full
        elif held + n > limit:
            out.append(held)
            held = n
        else:
            held += n
    return [*out, held] if held else out


OFFSET_SPLITTERS = {"aligned": aligned_chunks, "small": small_chunks}


def chunk_arrays(batches: Iterator[tuple[pa.Array, pa.Array]], path: str, limit: int, rule: Callable) -> Iterator[pa.Array]:
    """Of texts and the lengths of their sentences, in Arrow batches, the ids and the sizes of their chunks, a piece at a time.

    Offsets are used up here: only ids and sizes leave the worker, each piece before the next is made.
    """
    from .tokenise import with_offsets

    kind = pa.list_(pa.int32())
    for texts, lens in batches:
        left = iter(lens)
        for rows in with_offsets(texts, path):
            ids, sizes = [], []
            for own, starts, ends in rows:
                stops = np.cumsum(next(left).values.to_numpy(zero_copy_only=False).astype(np.int64))
                found = rule(starts.astype(np.int64), ends.astype(np.int64), stops, limit)
                ids.append(own[: sum(found)])  # what the rule dropped goes
                sizes.append(np.array(found, dtype=np.int32))
            yield pa.StructArray.from_arrays([pa.array(ids, kind), pa.array(sizes, kind)], names=["tokens", "sizes"])


def tokenised_chunks(docs: DataFrame, path: str, limit: int, splitter: str = "aligned", text: str = "text") -> DataFrame:
    """``docs`` with ``tokens`` (ids of a tokenizer file) and ``sizes``, their chunks at sentence bounds.

    A text is tokenised once, as a whole; sentences are found in its tokens by their offsets.  Other splitters than those
    here are looked up among the registered ones: functions of starts, ends, sentence ends and limit that return sizes.
    """
    from .tokenise import resolve

    rule = OFFSET_SPLITTERS.get(splitter) or resolve(splitter)

    @F.arrow_udf("struct<tokens:array<int>,sizes:array<int>>")
    def both(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return chunk_arrays(batches, path, limit, rule)

    lens = F.transform(sentences(F.col(text)), lambda s: F.length(s))
    return docs.withColumn("_c", both(F.col(text), lens)).select(*docs.columns, "_c.tokens", "_c.sizes")


def entropy_cuts(h: Column, smoothing: float = 0.0) -> Column:
    """Whether a new patch begins at each place: where the value rises by more than ``smoothing``."""
    return F.transform(h, lambda x, i: (i > 0) & (x > F.get(h, i - 1) + F.lit(smoothing)))


def entropy_groups(h: Column, smoothing: float = 0.0) -> Column:
    """Number of the patch each place belongs to."""
    cuts = F.transform(entropy_cuts(h, smoothing), lambda c: c.cast("int"))
    return F.zip_with(prefix_sums(cuts), cuts, lambda a, c: (a + c).cast("int"))


def entropy_spans(h: Column, smoothing: float = 0.0) -> Column:
    """Spans of the patches."""
    cut = entropy_cuts(h, smoothing)
    starts = F.concat(F.array(F.lit(0)), F.filter(F.transform(cut, lambda c, i: F.when(c, i)), lambda i: i.isNotNull()))
    return F.when(F.size(h) > 0, contiguous(starts, F.size(h)))


def entropy_spans_closed(h: Column, smoothing: float = 0.0) -> Column:
    """An older rule: a patch ends with the place of the rise, and what follows the last rise is in none."""
    rises = F.filter(F.transform(entropy_cuts(h, smoothing), lambda c, i: F.when(c, i + 1)), lambda i: i.isNotNull())
    begins = F.concat(F.array(F.lit(0)), F.slice(rises, F.lit(1), F.greatest(F.size(rises) - 1, F.lit(0))))
    return F.zip_with(F.slice(begins, F.lit(1), F.size(rises)), rises, lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def word_cuts(text: Column, doc: Column, seed: int = 0, longest: int = 27, share: float = 0.3) -> Column:
    """A stand-in for cuts by entropy: words, with the blanks before them, cut before any that would make a patch longer
    than ``longest`` characters, else with probability ``share``; by a hash, so that the same text is cut alike."""
    words = F.regexp_extract_all(text, F.lit(r"\s*\S+"), F.lit(0))
    draw = lambda i: F.pmod(F.xxhash64(F.lit(seed), doc, i), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    rows = F.transform(words, lambda w, i: F.struct(w.alias("w"), draw(i).alias("c")))
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))
    step = lambda a, r: F.when(
        (a["open"] != "") & ((F.length(a["open"]) + F.length(r["w"]) > longest) | r["c"]),
        F.struct(r["w"].alias("open"), F.array_append(a["done"], a["open"]).alias("done")),
    ).otherwise(F.struct(F.concat(a["open"], r["w"]).alias("open"), a["done"].alias("done")))
    return F.aggregate(rows, start, step, lambda a: F.when(a["open"] != "", F.array_append(a["done"], a["open"])).otherwise(a["done"]))


def _cut(texts: pa.Array, starts: pa.Array, ends: pa.Array, limit: int) -> pa.Array:
    """Pieces of the texts of one slice of a batch: places in characters become places in bytes by one look at the bytes."""
    from .tokenise import _flat

    where, data = _flat(texts)
    chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.searchsorted(chars, where)  # the first character of each text, and an end
    n_spans = starts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(texts)), n_spans)
    s, e = (x.flatten().to_numpy(zero_copy_only=False) for x in (starts, ends))
    kept = e > s
    row, s, e = row[kept], s[kept], e[kept]
    n = -(-(e - s) // limit)
    of = np.repeat(np.arange(len(n)), n)
    begin = s[of] + limit * (np.arange(len(of)) - (np.cumsum(n) - n)[of])
    size = np.diff(first)[row[of]]
    at = lambda place: chars[first[row[of]] + np.minimum(place, size)]
    lo, hi = at(begin), at(np.minimum(begin + limit, e[of]))
    into = np.concatenate([[0], np.cumsum(hi - lo)])
    if len(lo) and not (lo[1:] == hi[:-1]).all():
        data = data[np.repeat(lo - into[:-1], hi - lo) + np.arange(into[-1])]
    elif len(lo):
        data = data[lo[0] : hi[-1]]
    pieces_ = pa.StringArray.from_buffers(len(lo), pa.py_buffer(into.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    if texts.null_count:
        pieces_ = pc.if_else(pa.array(np.array(texts.is_valid())[row[of]]), pieces_, pa.scalar(None, pa.string()))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row[of], minlength=len(texts)))]).astype(np.int32)
    mask = pa.array(~np.array(starts.is_valid())) if starts.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets), pieces_, mask=mask)


def cut_text(text: Column, spans_: Column, hard_limit: int) -> Column:
    """Pieces of ``text`` by spans, none longer than ``hard_limit``: a walk from the text's start for each would be quadratic."""
    from .tokenise import _flat, pieces

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        slices = pieces(np.diff(_flat(texts)[0])) if len(texts) else []
        parts = [_cut(texts.slice(i, j - i), starts.slice(i, j - i), ends.slice(i, j - i), hard_limit) for i, j in slices]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return cut(text, *[F.transform(spans_, lambda s: s[end].cast("long")) for end in ("start", "end")])


@F.arrow_udf(ArrayType(IntegerType()))
def _windows(texts: pa.Array, size: pa.Array) -> pa.Array:
    return pa.array([byte_windows(t or "", n) for t, n in zip(texts.to_pylist(), size.to_pylist())], pa.list_(pa.int32()))


def window_ends(text: Column, size: int) -> Column:
    """Ends of the legacy windows of each text; their number is the legacy count of byte chunks."""
    return _windows(text, F.lit(size))


def byte_windows(text: str, size: int, look_back: int | None = None) -> list[int]:
    """Legacy windows of ``size`` characters that end after their last blank, unless the text ends there.

    With ``look_back`` the blank is searched for in that many last characters only.
    """
    ends, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            blank = text.rfind(" ", at if look_back is None else max(at, end - look_back), end)
            if blank >= 0 and (look_back is not None or " " in text[at:end]):
                end = blank + 1
        ends.append(max(end, at + 1))
        at = ends[-1]
    return ends
