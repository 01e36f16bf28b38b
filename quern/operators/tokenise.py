"""Tokenisation: byte-level ids as expressions, other tokenizers as Arrow functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

BOS, EOS, PAD = 257, 258, 259


def _lists(offsets: np.ndarray, values: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A list array from its offsets and flat values; nulls where ``valid`` is false."""
    mask = None if valid is None or valid.all() else pa.array(~valid)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values), mask=mask)


def _flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, from zero, and bytes of an array of strings or binaries."""
    if pa.types.is_large_binary(strings.type) or pa.types.is_large_string(strings.type):
        strings = strings.cast(pa.binary())
    where = np.frombuffer(strings.buffers()[1], dtype=np.int32)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    return where - where[0], np.frombuffer(data, dtype=np.uint8)[where[0] : where[-1]] if data is not None else np.zeros(0, dtype=np.uint8)


@F.arrow_udf(ArrayType(IntegerType()))
def _octets(texts: pa.Array) -> pa.Array:
    # The bytes lie in the column already: only their width changes.
    if not len(texts):
        return pa.array([], pa.list_(pa.int32()))
    offsets, data = _flat(texts)
    return _lists(offsets, data.astype(np.int32), np.array(texts.is_valid()))


def utf8_bytes(text: Column) -> Column:
    """The UTF-8 bytes of ``text`` as an array of ints."""
    return _octets(text.cast("binary"))


@F.arrow_udf(StringType())
def _decoded(ids: pa.Array) -> pa.Array:
    flat, ends = ids.flatten().to_numpy(zero_copy_only=False), [0, *np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()]
    known = (flat >= 0) & (flat < 256)
    data = flat[known].astype(np.uint8).tobytes()
    at = np.concatenate([[0], np.cumsum(known)])[ends]
    ok = ids.is_valid().to_pylist()
    return pa.array([data[i:j].decode("utf-8", "ignore") if v else None for i, j, v in zip(at[:-1].tolist(), at[1:].tolist(), ok)], pa.string())


def byte_ids(text: Column, bos: int | None = BOS, eos: int | None = EOS) -> Column:
    """[bos] + bytes + [eos]; null texts are empty."""
    parts = [utf8_bytes(F.coalesce(text, F.lit("")))]
    if bos is not None:
        parts.insert(0, F.array(F.lit(bos)))
    if eos is not None:
        parts.append(F.array(F.lit(eos)))
    return F.concat(*parts)


def byte_text(ids: Column) -> Column:
    """The text of byte ids: specials are dropped, and so are bytes that are no UTF-8."""
    return _decoded(ids)


def fitted(ids: Column, length: int, pad: int = PAD) -> Column:
    """Cut to ``length`` and padded on the right."""
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.lit(length) - F.size(cut)))


def is_pad(ids: Column, pad: int = PAD) -> Column:
    return F.transform(ids, lambda x: x == pad)


def word_ids(text: Column, modulus: int = 50_000, first: int = 3) -> Column:
    """Ids of blank-separated words by hash: a vocabulary that needs no file."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \n\r\t]+"), lambda w: w != "")
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % modulus + first).cast("int"))


_OPEN: dict[str, object] = {}


def _tokenizer(path: str):
    """A tokenizer file, opened once per Python worker."""
    if path not in _OPEN:
        from tokenizers import Tokenizer

        _OPEN[path] = Tokenizer.from_file(path)
    return _OPEN[path]


#: Bytes of text, or half as many ids, that a worker holds as objects at a time; an Arrow batch may be much larger.
PIECE = 1 << 18


def pieces(sizes: np.ndarray, at_most: int = PIECE) -> list[tuple[int, int]]:
    """Rows first to last (exclusive) in turn, each piece of about ``at_most`` by ``sizes``; a row is never parted."""
    before = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])[:-1]
    cuts = np.flatnonzero(np.diff(before // at_most)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)])) if len(sizes) else []


def _text_pieces(texts: pa.Array):
    """The texts of a batch as lists, a piece at a time; null ones are empty."""
    for i, j in pieces(np.diff(_flat(texts)[0])) if len(texts) else []:
        yield [t or "" for t in texts.slice(i, j - i).to_pylist()]


_IDS = pa.list_(pa.int32())


def id_arrays(batches: Iterator[pa.Array], path: str, bos: int | None = None, eos: int | None = None, limit: int | None = None) -> Iterator[pa.Array]:
    """Token ids of the texts of Arrow batches, a piece at a time: each leaves the worker before the next is made."""
    head, tail = [bos] if bos is not None else [], [eos] if eos is not None else []
    for texts in batches:
        for rows in _text_pieces(texts):
            got = _tokenizer(path).encode_batch_fast(rows, add_special_tokens=False)
            yield pa.array([np.array((head + e.ids + tail)[:limit], dtype=np.int32) for e in got], _IDS)


def encoded(docs: DataFrame, path: str, text: str = "text", name: str = "tokens", bos: int | None = None, eos: int | None = None, limit: int | None = None) -> DataFrame:
    """``docs`` with token ids of a tokenizer file; truncation comes after the special ids."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return id_arrays(batches, path, bos, eos, limit)

    return docs.withColumn(name, ids(F.col(text)))


def with_offsets(texts: pa.Array, path: str):
    """For each piece of the batch a list: of each text its ids and the first and last place (exclusive) of each token, in characters."""
    for rows in _text_pieces(texts):
        got = []
        for e in _tokenizer(path).encode_batch(rows, add_special_tokens=False):
            places = np.array(e.offsets, dtype=np.int32).reshape(-1, 2)
            got.append((np.array(e.ids, dtype=np.int32), places[:, 0], places[:, 1]))
        yield got


def encoded_with_offsets(docs: DataFrame, path: str, text: str = "text", name: str = "encoding") -> DataFrame:
    """``docs`` with a struct of ids and of the first and last place (exclusive) of each token, in characters of the text."""

    @F.arrow_udf("struct<ids:array<int>,starts:array<int>,ends:array<int>>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for rows in with_offsets(texts, path):
                yield pa.StructArray.from_arrays([pa.array(list(c), _IDS) for c in zip(*rows)], names=["ids", "starts", "ends"])

    return docs.withColumn(name, both(F.col(text)))


def text_arrays(batches: Iterator[pa.Array], path: str) -> Iterator[pa.Array]:
    """The texts of the token ids of Arrow batches, a piece at a time like ``id_arrays``."""
    for rows in batches:
        sizes = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        for i, j in pieces(sizes, PIECE // 2):
            got = _tokenizer(path).decode_batch([r or [] for r in rows.slice(i, j - i).to_pylist()], skip_special_tokens=True)
            yield pa.array(got, pa.string())


def decoded(ids: Column, path: str) -> Column:
    """The texts of token ids, specials left out."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return text_arrays(batches, path)

    return text(ids)


def batch_encoded(docs: DataFrame, path: str, length: int, pad: int, text: str = "text", bos: int | None = None, eos: int | None = None) -> DataFrame:
    """``docs`` with ``ids`` cut and padded to ``length``, ``padding`` (true where padded) and ``n_ids``."""
    rows = encoded(docs, path, text, "ids", bos, eos, length).withColumn("n_ids", F.size("ids"))
    return rows.withColumn("ids", fitted(F.col("ids"), length, pad)).withColumn("padding", is_pad(F.col("ids"), pad))


def batch_encoded_patches(patches: Column, width: int, rows: int, pad: int = PAD) -> Column:
    """Texts cut into patches as a table of byte ids: struct(ids, outer, inner).

    ``rows`` patches of ``width`` ids, missing ones all padding; ``outer`` is true for places of patches that are
    missing, ``inner`` wherever an id is padding.
    """
    own = F.transform(F.slice(patches, 1, rows), lambda p: fitted(p, width, pad))
    blank = F.array_repeat(F.array_repeat(F.lit(pad), width), F.lit(rows) - F.size(own))
    ids = F.concat(own, blank)
    return F.struct(
        ids.alias("ids"), F.transform(ids, lambda p, k: F.transform(p, lambda _: k >= F.size(own))).alias("outer"),
        F.transform(ids, lambda p: F.transform(p, lambda x: x == pad)).alias("inner"),
    )


#: Blocks of Unicode by name, first and last code point of each part.
UNICODE_RANGES = {
    "basic_latin": ((0x0000, 0x007F),),
    "latin": ((0x0000, 0x024F),),
    "ipa_extensions": ((0x0250, 0x02AF),),
    "spacing_modifiers": ((0x02B0, 0x02FF),),
    "combining_diacriticals": ((0x0300, 0x036F),),
    "greek": ((0x0370, 0x03FF),),
    "greek_extended": ((0x1F00, 0x1FFF),),
    "cyrillic": ((0x0400, 0x04FF),),
    "cyrillic_supplement": ((0x0500, 0x052F),),
    "cyrillic_extended": ((0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x0530, 0x058F),),
    "hebrew": ((0x0590, 0x05FF),),
    "arabic": ((0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF)),
    "general_punctuation": ((0x2000, 0x206F),),
    "currency_symbols": ((0x20A0, 0x20CF),),
    "letterlike_symbols": ((0x2100, 0x214F),),
    "number_forms": ((0x2150, 0x218F),),
    "arrows": ((0x2190, 0x21FF),),
    "math_operators": ((0x2200, 0x22FF),),
    "misc_technical": ((0x2300, 0x23FF),),
    "box_drawing": ((0x2500, 0x257F),),
    "block_elements": ((0x2580, 0x259F),),
    "geometric_shapes": ((0x25A0, 0x25FF),),
    "misc_symbols": ((0x2600, 0x26FF),),
    "dingbats": ((0x2700, 0x27BF),),
    "braille": ((0x2800, 0x28FF),),
    "cjk_symbols": ((0x3000, 0x303F),),
    "hiragana": ((0x3040, 0x309F),),
    "katakana": ((0x30A0, 0x30FF),),
    "cjk_unified": ((0x4E00, 0x9FFF),),
    "private_use": ((0xE000, 0xF8FF),),
    "emoticons": (
        (0x1F300, 0x1F5FF), (0x1F600, 0x1F64F), (0x1F680, 0x1F6FF), (0x1F700, 0x1F77F), (0x1F780, 0x1F7FF), (0x1F800, 0x1F8FF),
        (0x1F900, 0x1F9FF), (0x1FA00, 0x1FA6F), (0x1FA70, 0x1FAFF), (0x2600, 0x26FF), (0x2700, 0x27BF),
    ),
}


def _parts(names: list[str | tuple[int, int]]) -> list[tuple[int, int]]:
    unknown = [n for n in names if isinstance(n, str) and n not in UNICODE_RANGES]
    if unknown:
        raise ValueError(f"no such range: {', '.join(unknown)}")
    return [part for n in names for part in (UNICODE_RANGES[n] if isinstance(n, str) else [n])]


def only_ranges(text: Column, names: list[str | tuple[int, int]], blanks: bool = True, digits: bool = True, marks: bool = True) -> Column:
    """``text`` without characters outside the ranges (named, or first and last); blanks, numbers and punctuation stay."""
    allowed = "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in _parts(names))
    more = r"\s" * blanks + r"\p{N}" * digits + r"\p{P}" * marks
    return F.regexp_replace(text, f"[^{allowed}{more}]", "")


def alphabet(spark, names: list[str]) -> DataFrame:
    """Code points of the named ranges."""
    rows = [(n, lo, hi) for n in names for lo, hi in _parts([n])]
    return spark.createDataFrame(rows, "name string, lo int, hi int").select("name", F.explode(F.sequence("lo", "hi")).alias("code"))


def nfc(docs: DataFrame, text: str = "text", name: str = "nfc") -> DataFrame:
    import unicodedata

    @F.arrow_udf("string")
    def normal(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())

    return docs.withColumn(name, normal(F.col(text)))


def dtype_of(size: Column) -> Column:
    """The narrowest unsigned width that holds ``size`` different values."""
    return F.when(size <= 255, "uint8").when(size <= 65_535, "uint16").otherwise("uint32")


#: Splitters and tokenizers by name, with a priority; the highest that can be loaded is used.
REGISTRY: dict[str, list[tuple[int, Callable]]] = {}


def register(name: str, make: Callable, priority: int = 0) -> None:
    REGISTRY.setdefault(name, []).append((priority, make))


def resolve(name: str) -> Callable:
    """The registered callable of the highest priority that does not fail on being made."""
    if name not in REGISTRY:
        raise KeyError(f"nothing is registered as {name!r}")
    for _, make in sorted(REGISTRY[name], key=lambda x: -x[0]):
        try:
            return make()
        except ImportError:
            continue
    raise ImportError(f"nothing registered as {name!r} can be loaded")
