"""What a worker holds at a time, and what is not done twice."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import chunking, iterate, ranks, tokenise
from quern.plans import catalogue


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pieces_of_a_batch():
    sizes = np.array([5, 0, 9, 30, 1, 1, 1, 0])
    got = tokenise.pieces(sizes, 10)
    assert [k for i, j in got for k in range(i, j)] == list(range(8))
    assert all(sizes[i : j - 1].sum() <= 10 for i, j in got) and len(got) > 2
    assert tokenise.pieces(sizes[:0]) == []
    texts = pa.array(["skipped", "a" * 200_000, None, "b" * 200_000, "c"]).slice(1)
    assert [t for rows in tokenise._text_pieces(texts) for t in rows] == ["a" * 200_000, "", "b" * 200_000, "c"]
    assert len(list(tokenise._text_pieces(texts))) == 2


@pytest.mark.parametrize("name", ["chunk_aligned_tokens", "chunk_small_tokens"])
def test_offsets_stay_in_the_worker(spark, sf_dir, name):
    text = plan(catalogue.QUERIES[name](spark, sf_dir))
    assert text.count("ArrowEvalPython") == 1 and "starts" not in text


def by_pieces(make, batch, n=3):
    """What ``make`` gives for ``n`` times the batch; it has to yield within a batch, before it asks for the next."""
    asked, got, after = [], [], []
    for part in make(asked.append(k) or batch for k in range(n)):
        got.append(part)
        after.append(len(asked))
    assert {after.count(k + 1) for k in range(n)} == {len(got) // n} and len(got) > n
    return pa.concat_arrays(got).to_pylist()


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return (path := public_tokenizers.path("byte_bpe_50k.json")), Tokenizer.from_file(path)


LONG = pa.array(["skipped", "One. Two " * 25_000, None, "été, три! " * 15_000, "four", ""]).slice(1)


def test_chunks_leave_the_worker_by_pieces():
    path, plain = tokenizer()
    texts = [t or "" for t in LONG.to_pylist()]
    lens = [[5, 4] * 25_000, [], [5, 5] * 15_000, [4], []]
    got = by_pieces(lambda b: chunking.chunk_arrays(b, path, 62, chunking.small_chunks), (LONG, pa.array(lens, pa.list_(pa.int32()))))
    want = []
    for t, n in zip(texts, lens):
        e = plain.encode(t, add_special_tokens=False)
        starts, ends = (np.array([o[k] for o in e.offsets], dtype=np.int64) for k in (0, 1))
        sizes = chunking.small_chunks(starts, ends, np.cumsum(n).astype(np.int64), 62)
        want.append({"tokens": e.ids[: sum(sizes)], "sizes": sizes})
    assert got == want * 3


def test_decoded_texts_leave_the_worker_by_pieces():
    path, plain = tokenizer()
    ids = [None if t is None else plain.encode(t, add_special_tokens=False).ids for t in LONG.to_pylist()]
    ids[0] += plain.encode(" more" * 140_000, add_special_tokens=False).ids
    got = by_pieces(lambda b: tokenise.text_arrays(b, path), pa.array([[1], *ids], pa.list_(pa.int32())).slice(1))
    assert got == [LONG[0].as_py() + " more" * 140_000, "", *LONG.to_pylist()[2:]] * 3


def test_ids_become_texts_in_one_call(spark, sf_dir):
    assert plan(catalogue.QUERIES["hf_decode_roundtrip"](spark, sf_dir)).count("ArrowEvalPython") == 1


def test_ids_leave_the_worker_by_pieces():
    path, plain = tokenizer()
    want = [[7, *plain.encode(t or "", add_special_tokens=False).ids, 8][:30_000] for t in LONG.to_pylist()]
    assert by_pieces(lambda b: tokenise.id_arrays(b, path, 7, 8, 30_000), LONG) == want * 3


@pytest.mark.parametrize("name", ["hf_bpe_encode", "hf_decode_roundtrip", "hf_batch_encode", "chunk_aligned_tokens", "chunk_small_tokens"])
def test_tokenised_by_iterators(spark, sf_dir, name):
    from pyspark.util import PythonEvalType

    assert f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}\n" in plan(catalogue.QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("kind", ["array<int>", "binary"])
def test_groups_of_units(spark, kind):
    values = [b"", None, b"abc", b"abcd", b"abcdefghi"]
    df = spark.createDataFrame([(k, None if v is None else bytearray(v) if kind == "binary" else list(v), "x") for k, v in enumerate(values)], f"k int, u {kind}, more string")
    rows = iterate.unit_groups(df, "u", 4)
    assert rows.columns == ["k", "u", "more", "group"]
    want = [(k, g, v[4 * g : 4 * g + 4]) for k, v in enumerate(values) for g in range(-(-len(v or b"") // 4))]
    assert sorted((r["k"], r["group"], bytes(r["u"])) for r in rows.collect()) == want


def test_bytes_become_numbers_in_groups(spark, sf_dir):
    text = plan(catalogue.QUERIES["byte_groups"](spark, sf_dir))
    assert text.index("ArrowEvalPython") < text.index("Generate")  # the plan's top comes first


def test_cuts_by_brute_force():
    dice = random.Random(1)
    for _ in range(100):
        limit, rows = dice.randint(1, 5), []
        for _ in range(dice.randint(0, 6)):
            text = None if dice.random() < 0.1 else "".join(dice.choice("aé€😀 b") for _ in range(dice.randint(0, 12)))
            begins = [dice.randint(0, len(text or "") + 3) for _ in range(dice.randint(0, 4))]
            rows.append((text, None if dice.random() < 0.1 else [(a, a + dice.randint(0, 6)) for a in begins]))
        longs = lambda k: pa.array([[9], *[None if s is None else [x[k] for x in s] for _, s in rows]], pa.list_(pa.int64())).slice(1)  # noqa: B023, E731
        got = chunking._cut(pa.array(["xx", *[t for t, _ in rows]]).slice(1), longs(0), longs(1), limit).to_pylist()
        assert got == [None if s is None else [t and t[k : min(k + limit, b)] if t is not None else None for a, b in s for k in range(a, b, limit)] for t, s in rows]


def test_cuts_do_not_walk_from_the_start(spark, sf_dir):
    assert "substring" not in plan(catalogue.QUERIES["cut_text"](spark, sf_dir))


def test_buckets_without_python(spark):
    keys = [None, -5, 0, 1, 1, 1, 2, 3, 10**17, 10**17 + 1] * 30
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for buckets in (1, 2, 3, 5, 40):
        rows = df.select("k", ranks._bucket_of(df, "k", buckets).alias("b"))
        assert "Python" not in plan(rows)
        got = sorted({(r["k"] if r["k"] is not None else -(10**18), r["b"]) for r in rows.collect()})
        assert len(got) == 8 and [b for _, b in got] == sorted(b for _, b in got)  # one bucket a key, in the order of keys


def test_documents_are_judged_once(spark, sf_dir):
    assert plan(catalogue.QUERIES["pretokenise_batch"](spark, sf_dir)).count("FileScan") == 1
