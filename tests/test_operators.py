import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import metrics
from quern.operators import batch, catalog, chunking, ingest, iterate, labels, masking, pretok, ranks, tokenise, views
from quern.operators.permute import Permutation
from quern.sources import readers, sinks


@given(st.integers(1, 3000), st.integers(0, 100))
@settings(max_examples=60, deadline=None)
def test_permutation_is_a_bijection(n, seed):
    p = Permutation.draw(n, seed)
    assert sorted(map(p.at, range(min(n, 3000)))) == list(range(n))
    assert all((p.inverse * (p.at(i) - p.b)) % n == i for i in range(min(n, 50)))


def test_permutation_known_draws():
    p = Permutation.draw(1000, 27)
    assert (p.a, p.b, p.inverse) == (719, 283, 879)
    with pytest.raises(ValueError):
        Permutation.draw(0)


def test_position_above_63_bits(spark):
    p = Permutation.draw(5_000_000_029, 3)
    i = [0, 1, 4_999_999_999]
    df = spark.createDataFrame([(p.at(x),) for x in i], "g long")
    assert [r[0] for r in df.select(p.position(F.col("g"))).collect()] == i


def test_numbers_over_hot_and_empty_groups(spark):
    df = spark.range(1000).select((F.col("id") * 3).alias("k"), F.when(F.col("id") < 900, "hot").otherwise("cold").alias("s"))
    for size in (150, 10_000):  # several buckets, or one
        got = ranks.numbered(df, "k", ["s"], "n", in_bucket=size).groupBy("s").agg(F.min("n"), F.max("n"), F.count_distinct("n")).collect()
        assert {tuple(r) for r in got} == {("hot", 0, 899, 900), ("cold", 0, 99, 100)}
        sums = ranks.with_prefixes(df, "k", [], {"n": F.lit(1), "v": F.col("k")}, in_bucket=size).collect()
        assert all(r["n"] == r["k"] // 3 and r["v"] == sum(range(0, r["k"], 3)) for r in sums)
    assert ranks.numbered(df.limit(0), "k", ["s"], "n").count() == 0


def test_numbers_of_clustered_keys(spark):
    keys = [0] + [10**15 + k for k in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    rows = df.select("k", ranks._bucket_of(df, "k", 5).alias("b")).groupBy("b").count().collect()
    assert len(rows) == 5 and max(r["count"] for r in rows) < 150
    assert [r["n"] for r in ranks.numbered(df, "k", [], "n", in_bucket=100).orderBy("k").collect()] == list(range(501))


def test_located_and_scans(spark):
    rows = [("a", 1, 3, 0), ("b", 2, 0, 3), ("c", 3, 2, 3)]
    df = spark.createDataFrame([(g,) for g in (-1, 0, 2, 3, 4, 5)], "g long")
    got = sorted((r["g"], r["source"], r["doc_key"]) for r in views.located(df, rows).collect())
    assert got == [(0, "a", 0), (2, "a", 2), (3, "c", 0), (4, "c", 1)]
    index = spark.createDataFrame([(k, "a" if k < 7 else "b", k if k < 7 else k - 7) for k in range(10)], "g long, source string, doc_key long")
    order = [r["doc_key"] for r in views.source_scan(index, "a", 7, 27).orderBy("at").collect()]
    p = Permutation.draw(7, 27)
    assert order == [p.at(i) for i in range(7)] and [r["at"] for r in views.source_scan(index, "b").orderBy("at").collect()] == [0, 1, 2]
    assert views.document(index, "b", 2).first()["g"] == 9


@pytest.mark.parametrize("value", ["x", "-1K", -1, 1.5, True])
def test_bad_selection(value):
    with pytest.raises(ValueError):
        views.Take.parse(value)


def test_selection_must_name_all_sources(spark):
    v = spark.createDataFrame([("a", 0, "t")], "source string, pos long, text string")
    with pytest.raises(ValueError):
        views.select(v, {}, ["a"])
    assert views.select(v, {"a": 0}, ["a"]).count() == 0
    assert views.select(v, {"a": "skipped"}, ["a"]).count() == 0
    with pytest.raises(views.NameAlreadyUsed):
        views.head(v, 1, 1, "x", {"x"})


def test_parse_reasons(spark):
    lines = ['{"text": "long enough text", "a": 1}', '{"raw_content": "also long enough"}', '{"a": 1}', '{"text": null}', "{bad", '{"text": "short"}', '{"text": "é é é é"}']
    rows = ingest.parsed(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r["reason"] for r in rows] == [None, None, "missingDataKey", "missingDataKey", "generatorReturnedNone", "data<=10", None]
    assert rows[0]["meta"] == '{"a":1}' and rows[1]["meta"] == "{}"
    deep = spark.createDataFrame([('{"b": {"c": [1, 2.5, null]}, "text": "a long text", "raw_content": "x"}',)], "value string")
    assert ingest.parsed(deep).first()["meta"] == '{"b":{"c":[1,2.5,null]},"raw_content":"x"}'
    hooked = ingest.parsed(deep, transform=F.upper, accept=lambda d, m: F.length(d) > 50).first()
    assert hooked["data"] == "A LONG TEXT" and hooked["reason"] == "filtered"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(v for v, _ in values.values())], ", ".join(f"{k} {t}" for k, (_, t) in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_hand_worked_chunks(spark):
    sizes = [4, 5, 3, 12, 2]
    assert one(spark, chunking.aligned(F.col("s"), 10), s=(sizes, "array<int>")) == [9, 3, 10, 4]
    assert chunking.fold_sentences(sizes, 10) == [9, 3, 10, 4]
    assert chunking.fold_equal_parts(sizes, 10) == [9, 3, 6, 8]
    assert chunking.fold_equal_parts([12], 10) == [0, 6, 6]


@given(st.lists(st.integers(0, 40), max_size=30), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_folds_keep_all_tokens(sizes, limit):
    for fold in chunking.FOLDS.values():
        got = fold(sizes, limit)
        assert sum(got) == sum(sizes) and all(n <= limit for n in got)


def test_hand_worked_entropy(spark):
    h = ([1.0, 2.0, 1.5, 1.55, 1.9], "array<double>")
    assert one(spark, chunking.entropy_groups(F.col("h"), 0.1), h=h) == [0, 1, 1, 1, 2]
    assert [tuple(r) for r in one(spark, chunking.entropy_spans(F.col("h"), 0.1), h=h)] == [(0, 1), (1, 4), (4, 5)]
    spans = ([(0, 5), (5, 8)], "array<struct<start:bigint,end:bigint>>")
    assert one(spark, chunking.cut_text(F.lit("abcdefgh"), F.col("s"), 2), s=spans) == ["ab", "cd", "e", "fg", "h"]


def test_spans_and_sizes(spark):
    spans = one(spark, chunking.spans(F.col("s")), s=([3, 2, 4], "array<int>"))
    assert [tuple(r) for r in spans] == [(0, 3), (3, 5), (5, 9)]
    assert one(spark, chunking.sizes_of(chunking.spans(F.col("s"))), s=([3, 2, 4], "array<int>")) == [3, 2, 4]
    with pytest.raises(Exception, match="chunk sizes"):
        one(spark, pretok.checked_sizes(F.col("s"), F.col("t"), 5), s=([3], "array<int>"), t=([1], "array<int>"))


def test_byte_ids(spark):
    assert one(spark, tokenise.byte_ids(F.col("t")), t=("é", "string")) == [257, 195, 169, 258]
    assert one(spark, tokenise.byte_text(tokenise.byte_ids(F.col("t"))), t=("é\n", "string")) == "é\n"
    assert one(spark, tokenise.byte_ids(F.col("t")), t=(None, "string")) == [257, 258]


def test_sequences_and_fillers(spark):
    v = spark.createDataFrame([(0, [[1, 7, 7, 7, 2], [1, 8, 8, 2], [1, 9, 9, 9, 9, 2]]), (1, [])], "pos long, chunks array<array<int>>")
    got = [(r["pos"], r["step"], r["ids"]) for r in iterate.sequences(v, "chunks", 2).orderBy("pos", "step").collect()]
    assert got == [(0, 0, [1, 7, 7, 7, 2, 1, 8, 8, 2]), (0, 1, [1, 9, 9, 9, 9, 2])]
    counts = spark.createDataFrame([(0, 5), (1, 3)], "rank long, chunk_count long")
    assert [(r["rank"], r["at"]) for r in iterate.fillers(counts).orderBy("at").collect()] == [(1, 3), (1, 4)]
    shards = spark.createDataFrame([(k, n) for k, n in enumerate([7, 1, 2, 3])], "worker_id long, chunk_count long")
    assert [r["chunk_count"] for r in iterate.rebucketed(shards, 2, 4).orderBy("rank").collect()] == [9, 4]
    with pytest.raises(ValueError):
        iterate.multiplier(100, 64)


def test_recurrence_cells():
    assert [(d, s) for _, d, s in iterate.cells([3, 1, 2, 1], 2)] == [(0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (2, 1), (3, 0)]
    assert [(d, s) for _, d, s in iterate.cells([3, 1], 2)] == [(0, 0), (1, 0), (0, 1)]
    assert [(d, s) for _, d, s in iterate.cells([3, 1], 2, drain=True)] == [(0, 0), (1, 0), (0, 1), (0, 2)]


def test_unpad_and_back(spark):
    rows = spark.createDataFrame([(0, [7, 8]), (1, [9])], "i long, ids array<int>")
    b = batch.unpadded(rows, "i", "ids", 2, 4)
    r = b.first()
    assert (r["flat"], r["cu_seqlens"], r["indices"], r["max_seq_len"]) == ([7, 8, 9], [0, 2, 3], [0, 1, 4], 2)
    back = b.select(batch.repadded(F.col("flat"), F.col("indices"), F.lit(2), 4, 0).alias("x")).first()["x"]
    assert back == [[7, 8, 0, 0], [9, 0, 0, 0]]


def test_masking_shares_and_padding(spark):
    ids = [[(k * 7 + j) % 97 + 1 if j < 200 - k else 0 for j in range(256)] for k in range(40)]
    df = spark.createDataFrame(list(enumerate(ids)), "doc long, ids array<int>")
    run = lambda seed: df.select("ids", masking.masked(F.col("ids"), F.col("doc"), seed, F.lit(0.5), 99, 0, 100, 0.8, 0.1, 0.1).alias("m")).collect()
    rows = run(1)
    kinds = [k for r in rows for x, k in zip(r["ids"], r["m"]["kinds"]) if x]
    assert all(k == 0 for r in rows for x, k in zip(r["ids"], r["m"]["kinds"]) if not x)
    chosen = [k for k in kinds if k]
    assert abs(len(chosen) / len(kinds) - 0.5) < 0.05
    assert all(abs(chosen.count(k) / len(chosen) - p) < 0.1 for k, p in ((1, 0.8), (2, 0.1), (3, 0.1)))
    assert rows == run(1) and rows != run(2)
    with pytest.raises(ValueError):
        masking.masked(F.col("ids"), F.col("doc"), 1, F.lit(0.5), 99, 0, 100, 0.5)


def test_labels(spark):
    df = spark.createDataFrame([(0,)] * 4 + [(1,)], "y int")
    assert [round(r["weight"], 6) for r in labels.class_weights(df, "y", 2).orderBy("class").collect()] == [0.4, 1.6]
    assert one(spark, labels.aligned(F.col("p"), F.col("y")), p=([2, 3], "array<int>"), y=([5, 6], "array<int>")) == [5, -100, 6, -100, -100]
    with pytest.raises(ValueError):
        labels.required(df, ["z"])
    with pytest.raises(Exception, match="unmapped"):
        labels.mapped(spark.createDataFrame([("q",)], "l string"), "l", {"a": 0}).collect()


def test_registry(spark, tmp_path):
    r = catalog.Registry(spark, f"file://{tmp_path}/r")
    assert r.largest_number() == 0 and r.one("source") == {} and r.names("view") == []
    source = lambda *rows: spark.createDataFrame([(k, n, "document", "text", d, 10 * d, 0, "{}") for k, n, d in rows], catalog.KINDS["source"].columns)
    r.add("source", source((1, "a", 5), (2, "b", 7)))
    with pytest.raises(catalog.AlreadyThere):
        r.add("source", source((2, "c", 1)))
    assert r.numbers() == {"a": 1, "b": 2} and r.number_of("b") == 2 and r.largest_number() == 2
    assert r.change("source", F.col("name") == "b", {"documents": 9}) == 1 and r.one("source", name="b")["documents"] == 9
    with pytest.raises(ValueError):
        r.change("source", F.lit(True), {"source_no": 1})
    strategy = {"strategy_name": "x y", "tokenizer_type": "t", "splitter_class": "s", "chunk_size": 64, "modality": "document"}
    assert r.register_strategy(strategy)["strategy_name"] == "x_y" and r.strategy("x_y")["chunk_size"] == 64 and r.strategy("none") == {}
    with pytest.raises(catalog.AlreadyThere):
        r.register_strategy(strategy)
    for k in (1, 2):
        r.link("v", k, "preserved", 5 * k, 50)
    r.link("v", 2, "skipped")
    with pytest.raises(ValueError):
        r.link("v", 1, "both")
    r.put("view", spark.createDataFrame([("v", 27, True)], catalog.KINDS["view"].columns))
    assert r.set_view("v") == 5 and r.view == "v" and r.forget_shuffle("v") == 1 and not r.one("view", view="v")["shuffled"]
    with pytest.raises(KeyError):
        r.set_view("w")
    lengths = lambda rows: spark.createDataFrame([("x_y", k, m, n) for k, m, n in rows], catalog.KINDS["sequences"].columns)
    r.put("sequences", lengths([(1, 1, 10), (1, 2, 5), (2, 1, 8)]))
    assert len(r.rows("sequences", strategy="x_y", source_no=1)) == 2 and len(r.rows("sequences", strategy="x_y", multiplier=None)) == 3
    r.replace_all("sequences", lengths([(1, 3, 4)]), source_no=1)
    assert sorted((x["source_no"], x["multiplier"]) for x in r.rows("sequences")) == [(1, 3), (2, 1)]
    assert r.remove("source", name="b") == 1 and [x["source_no"] for x in r.rows("view_source")] == [1] and len(r.rows("sequences")) == 1
    assert r.remove("strategy", strategy="x_y") == 1 and r.rows("sequences") == []
    with pytest.raises(catalog.ReadOnly):
        catalog.Registry(spark, f"file://{tmp_path}/r", read_only=True).put("source", source((3, "c", 1)))
    view = spark.createDataFrame([("a", 10), ("a", 20)], "source string, n_bytes long")
    r.register_view("w", view, {"a": 2})
    assert r.one("view_source", view="w")["bytes"] == 30 and r.set_view("w") == 2
    with pytest.raises(views.NameAlreadyUsed):
        r.register_view("w", view, {"a": 2})
    with pytest.raises(ValueError):
        r.register_view("z", view, {})


def test_catalog(spark):
    shards = spark.createDataFrame([("s", "v", 4, k, 1, n) for k, n in enumerate([7, 1, 2, 3])], catalog.KINDS["shard"].columns)
    assert catalog.shard_length(shards, 2, 0) == 9 and catalog.shard_length(shards, 4, 1) == 1
    with pytest.raises(ValueError):
        catalog.shard_length(shards, 3, 0)
    with pytest.raises(ValueError):
        catalog.validated_strategy({"strategy_name": "x"})
    assert catalog.safe_name("a b/c") == "a_b_c"
    old, new = (spark.createDataFrame(r, "k int, v string, n int") for r in ([(1, "a", 0), (2, "b", 0)], [(2, "c", 1), (2, "d", 2), (3, "e", 1)]))
    assert sorted(tuple(r)[:2] for r in catalog.upserted(old, new, ["k"], "n").collect()) == [(1, "a"), (2, "d"), (3, "e")]
    strategy = {"modality": "document", "required_databases": ["data"]}
    assert catalog.compatible(strategy, "document", {"data", "meta"}) and not catalog.compatible(strategy, "document", {"meta"})
    flags = spark.createDataFrame([("v", 1, "skipped"), ("v", 2, None), ("v", 3, "x")], "view string, source_no int, flag string")
    assert sorted(r["source_no"] for r in catalog.checked_links(flags).collect()) == [2, 3]
    assert [r[0] for r in catalog.ask_view(flags, "v", "skipped").collect()] == [1]


def test_bytes_that_are_no_utf8(spark):
    assert one(spark, tokenise.byte_text(F.col("b")), b=([104, 255, 105, 195, 257, 300], "array<int>")) == "hi"
    assert one(spark, tokenise.byte_text(F.col("b")), b=(None, "array<int>")) is None


PATH = "byte_bpe_50k.json"
TEXTS = ["A first sentence. And a second one!  What of a third?\n\nYes.", "", None, "one", "word " * 300 + ". End.", "é ü — 漢字。 naïve. Ünïcode sentences here."]


def test_tokenizer_files_against_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(PATH)
    library = Tokenizer.from_file(path)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k long, text string")
    want = {k: library.encode(t or "", add_special_tokens=False) for k, t in enumerate(TEXTS)}
    for r in tokenise.encoded(df, path, bos=7, eos=8, limit=50).collect():
        assert r["tokens"] == ([7] + want[r["k"]].ids + [8])[:50]
    for r in tokenise.encoded_with_offsets(df, path).collect():
        assert r["encoding"]["ids"] == want[r["k"]].ids and list(zip(r["encoding"]["starts"], r["encoding"]["ends"])) == want[r["k"]].offsets
    for r in tokenise.batch_encoded(df, path, 20, 0).collect():
        ids = want[r["k"]].ids[:20]
        assert r["ids"] == ids + [0] * (20 - len(ids)) and r["n_ids"] == len(ids) and r["padding"] == [x == 0 for x in r["ids"]]
    back = tokenise.encoded(df, path).select("k", tokenise.decoded(F.col("tokens"), path).alias("t"))
    assert {r["k"]: r["t"] for r in back.collect()} == {k: t or "" for k, t in enumerate(TEXTS)}


def plain_chunks(text, encoding, limit, small):
    """Sentences by their ends, tokens handed out one by one."""
    import re

    ends, at = [], 0
    for part in [p for p in re.split("\x01", re.sub(r"([.!?]+[ \n]+)", "\\1\x01", text)) if p]:
        at += len(part)
        ends.append(at)
    owner = []
    for s, _ in encoding.offsets:
        if small:
            owner.append(next((k for k, e in enumerate(ends) if s < e), None))
        else:
            owner.append(0)
    if not small:
        begins = [0, *ends[:-1]]
        firsts = [max([k for k, (s, _) in enumerate(encoding.offsets) if s <= b], default=0) for b in begins]
        owner = [max(j for j, f in enumerate(firsts) if f <= k) for k in range(len(encoding.offsets))]
    sizes = [owner.count(k) for k in range(len(ends))]
    out, held = [], 0
    for n in sizes:
        if small and n > limit:
            out += [held] * (held > 0) + [limit] * (n // limit)
            held = n % limit
            continue
        for piece in [limit] * (n // limit) + [n % limit] * (n % limit > 0):
            if held and held + piece > limit:
                out.append(held)
                held = 0
            held += piece
    return out + [held] * (held > 0)


@pytest.mark.parametrize("splitter", ["aligned", "small"])
def test_chunks_by_offsets(spark, sf_dir, splitter):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(PATH)
    library = Tokenizer.from_file(path)
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    for r in chunking.tokenised_chunks(df, path, 30, splitter).collect():
        encoding = library.encode(r["text"] or "", add_special_tokens=False)
        assert r["sizes"] == plain_chunks(r["text"] or "", encoding, 30, splitter == "small"), r["text"]
        assert r["tokens"] == encoding.ids[: sum(r["sizes"])] and max(r["sizes"], default=0) <= 30


def test_registered_splitters(spark, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tokenise, "REGISTRY", {})

    def missing():
        raise ImportError("a library that is not there")

    tokenise.register("pairs", missing, 5)
    with pytest.raises(ImportError):
        tokenise.resolve("pairs")
    tokenise.register("pairs", lambda: lambda starts, ends, stops, limit: [2] * (len(starts) // 2) + [1] * (len(starts) % 2))
    df = spark.createDataFrame([("one two three",)], "text string")
    r = chunking.tokenised_chunks(df, public_tokenizers.path(PATH), 9, "pairs").first()
    assert sum(r["sizes"]) == len(r["tokens"]) and set(r["sizes"][:-1]) <= {2}
    with pytest.raises(KeyError):
        chunking.tokenised_chunks(df, public_tokenizers.path(PATH), 9, "none")


def test_patches_as_tables(spark):
    rows = spark.createDataFrame([([[97, 98], [99]],)], "p array<array<int>>")
    got = rows.select(tokenise.batch_encoded_patches(F.col("p"), 3, 3, 0).alias("x")).first()["x"]
    assert got["ids"] == [[97, 98, 0], [99, 0, 0], [0, 0, 0]] and got["outer"] == [[False] * 3, [False] * 3, [True] * 3]
    assert got["inner"][1] == [False, True, True]


def test_older_cuts(spark):
    h = ([1.0, 2.0, 1.5, 1.55, 1.9], "array<double>")
    assert [tuple(r) for r in one(spark, chunking.entropy_spans_closed(F.col("h"), 0.1), h=h)] == [(0, 2), (2, 5)]
    assert one(spark, chunking.entropy_spans_closed(F.col("h"), 9.0), h=h) == []
    text = "some words that are cut by chance " * 9
    cut = one(spark, chunking.word_cuts(F.col("t"), F.lit(3)), t=(text.rstrip(), "string"))
    assert "".join(cut) == text.rstrip() and len(cut) > 9 and all(len(c) <= 27 for c in cut)
    assert one(spark, chunking.window_ends(F.col("t"), 10), t=("aaaa bbbb cccc dddd", "string")) == chunking.byte_windows("aaaa bbbb cccc dddd", 10)


def test_unicode_ranges(spark):
    assert len(tokenise.UNICODE_RANGES) == 32 and len(tokenise.UNICODE_RANGES["arabic"]) == 3
    assert one(spark, tokenise.only_ranges(F.col("t"), ["emoticons", (0x61, 0x62)], digits=False), t=("abc 1 \U0001F600ж", "string")) == "ab  \U0001F600"
    with pytest.raises(ValueError):
        tokenise.only_ranges(F.lit("x"), ["no such"])


def test_masking_never_draws_mask_or_padding(spark):
    df = spark.createDataFrame([(k, [j % 17 + 3 for j in range(400)]) for k in range(25)], "doc long, ids array<int>")
    run = lambda **o: df.select(masking.masked(F.col("ids"), F.col("doc"), 5, F.lit(0.5), 1, 0, 20, 0.0, 1.0, 0.0, **o).alias("m")).collect()
    rows = run()
    drawn = [x for r in rows for x, k in zip(r["m"]["masked"], r["m"]["kinds"]) if k == 2]
    assert set(drawn) == set(range(2, 20)) and len(drawn) > 4000
    assert all((k > 0) == c for r in rows for k, c in zip(r["m"]["kinds"], r["m"]["cloze_mask"]))
    assert run(call=1) != run(call=2) and run(call=1) == run(call=1)
    assert masking.settings({"cloze_probability": 0.8, "random_probability": 0.2})["masked_substitution_rate"] == 0.15
    for wrong in ({"cloze_probability": 0.5}, {"rate": 1}):
        with pytest.raises(ValueError):
            masking.settings(wrong)


def test_packed_masking_keeps_the_layout(spark):
    rows = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5, 6, 7]), (2, [8, 9, 10])], "i long, ids array<int>")
    b = batch.unpadded(rows, "i", "ids", 3, 8).withColumn("m", masking.masked_batch(F.col("flat"), F.col("batch"), 1, F.lit(0.3), 999, 0, 1000))
    r = b.first()
    assert r["cu_seqlens"] == [0, 3, 7, 10] and len(r["m"]["cloze_mask"]) == 10
    assert all(x == (999 if c else y) for x, y, c in zip(r["m"]["masked"], r["flat"], r["m"]["cloze_mask"]))


def test_classification_batches(spark):
    df = spark.createDataFrame([(0, [5, 6, 7, 8], [1, 2, 3, 4]), (1, [9], [5])], "i long, ids array<int>, y array<int>")
    cut, count = labels.truncation(df, "ids", 3, "y")
    got = [(r["ids"], r["y"], r["attention"]) for r in labels.batch_rows(cut, "ids", "y", 3, 0).orderBy("i").collect()]
    assert count.first()[0] == 1 and got == [([5, 6, 7], [1, 2, 3], [True] * 3), ([9, 0, 0], [5, -100, -100], [True, False, False])]
    assert [r[0] for r in labels.unique(df, "y").collect()] == [1, 2, 3, 4, 5]
    ranks_ = [labels.sampled(spark.range(10), "id", 10, k, 4, epoch=1).collect() for k in range(4)]
    assert [len(r) for r in ranks_] == [3] * 4 and {x["id"] for r in ranks_ for x in r} == set(range(10))
    assert all(sorted(x["at"] for x in r) == [0, 1, 2] for r in ranks_)
    with pytest.raises(ValueError):
        labels.projected(df, ["none"])
    assert labels.projected(df, text="ids", label="y", id_="i").columns == ["ids", "y", "i"]
    assert one(spark, labels.first_pooled(F.col("v")), v=([[1.0, 2.0], [3.0, 4.0]], "array<array<double>>")) == [1.0, 2.0]


def test_losses_bans_and_checkpoints(spark):
    df = spark.createDataFrame([(100.0, 1, 1.0), (-100.0, 1, float("nan")), (0.0, 0, 3.0)], "z double, y int, v double")
    r = df.agg(metrics.binary_cross_entropy(F.col("z"), F.col("y"), F.lit(True)).alias("b"), metrics.squared_error(F.col("z"), F.col("v")).alias("s"), metrics.absolute_error(F.col("z"), F.col("v")).alias("a")).first()
    assert math.isclose(r["b"], (100 + math.log(2)) / 3) and r["s"] == (99**2 + 9) / 2 and r["a"] == (99 + 3) / 2
    assert df.where("z < 0").agg(metrics.squared_error(F.col("z"), F.col("v")).alias("s")).first()["s"] == 0.0
    ids = ([1, 2, 3, 1, 2, 4, 1, 2], "array<int>")
    assert one(spark, metrics.banned_next(F.col("i"), 3), i=ids) == [3, 4] and one(spark, metrics.banned_next(F.col("i"), 1), i=([2, 1], "array<int>")) == [1, 2]
    assert one(spark, metrics.banned_next(F.col("i"), 3), i=([1], "array<int>")) == []
    names = spark.createDataFrame([(f"m_v{v}_s{s}.ckpt",) for v, s in ((1, 10), (1, 50), (2, 20), (2, 40))] + [("other",)], "name string")
    v, s = metrics.checkpoint_of(F.col("name"), "m")
    found = names.select("name", v.alias("version"), s.alias("step"))
    at = lambda **o: tuple(metrics.resumed_checkpoint(found, **o).first() or ())[:2]
    assert at() == (2, 40) and at(version=1) == (1, 50) and at(at_least=30) == (2, 40) and at(at_least=99) == (2, 20) and at(version=7) == ()


def test_batches_with_more(spark):
    got = one(spark, batch.unpadded_with(F.col("i"), F.col("m"), cloze=F.col("c")), i=([5, 6, 0], "array<int>"), m=([False, False, True], "array<boolean>"), c=([True, False, True], "array<boolean>"))
    assert got["ids"] == [5, 6] and got["cloze"] == [True, False]
    rows = spark.createDataFrame([(0, False), (1, True), (2, False), (3, None)], "i long, f boolean")
    assert [r[1] for r in batch.any_finished(rows, "i", "f", 2).orderBy("batch").collect()] == [True, False]
    states = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (1, "c", 1)], "rank int, state string, saved_at int")
    last, saved = batch.rank_states(states, 1)
    assert [(r["rank"], r["state"]) for r in last.collect()] == [(0, "b")] and saved == 2


def test_pretokenised_failures(spark):
    df = spark.createDataFrame([(1, "s", [1, 2], [2]), (2, "s", [1, 2], [1]), (3, "s", [], []), (4, "s", [1, 2, 3], [3]), (5, "s", None, [1])], "doc_id long, source string, t array<int>, c array<int>")
    done, failed = pretok.pretokenised(df, {"chunk_size": 2}, F.col("t"), F.col("c"))
    assert [r["doc_id"] for r in done.collect()] == [1]
    assert {r["doc_id"]: r["failure"] for r in failed.collect()} == {2: "chunks do not cover the tokens", 3: "no tokens", 4: "a chunk is too large", 5: "no output"}
    with pytest.raises(catalog.MissingDataKey):
        pretok.pretokenised(df, {"chunk_size": 2, "required_databases": ["html"]}, F.col("t"), F.col("c"))
    with pytest.raises(catalog.MissingSplitterOutput):
        pretok.pretokenised(df, {"chunk_size": 2}, F.col("t"), None)


def test_small_functions(spark):
    assert one(spark, metrics.parsed_size(F.col("t")), t=("1.5k", "string")) == 1536
    assert one(spark, metrics.parsed_size(F.col("t")), t=("what", "string")) == 0
    assert one(spark, metrics.layer_of(F.col("t")), t=("model.layers.12.attn.weight", "string")) == 12
    assert one(spark, metrics.size_text(F.col("n")), n=(1536, "long")) == "1.50 KB"
    v, s = metrics.checkpoint_of(F.col("t"), "m")
    assert one(spark, F.array(v, s), t=("m_v2_s500.ckpt", "string")) == [2, 500]
    assert math.isclose(one(spark, metrics.learning_rate(F.col("n"), 100, 0.1, 0.0, 0.0), n=(5, "long")), 0.5)


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.conllu").write_text("# s\n1\tEin\t_\tDET\n1-2\tx\t_\tX\n2\tHaus\t_\tNOUN\n\n1\tJa\t_\tINTJ\n")
    rows = readers.conll(spark, str(tmp_path / "a.conllu")).orderBy("sentence").collect()
    assert [(r["tokens"], r["tags"]) for r in rows] == [(["Ein", "Haus"], ["DET", "NOUN"]), (["Ja"], ["INTJ"])]
    (tmp_path / "l.tsv").write_text("text\tlabel\na\tx\n")
    assert readers.labelled(spark, str(tmp_path / "l.tsv")).collect()[0]["label"] == "x"
    with pytest.raises(ValueError):
        readers.open_source(spark, "sqlite", "x")
    df = spark.createDataFrame([("s", "t", "é")], "source string, k string, data string")
    sinks.write_json_lines(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first()["data"] == "é"
    sinks.write_corpus(df, str(tmp_path / "corpus"))
    assert spark.read.parquet(str(tmp_path / "corpus")).where("source = 's'").count() == 1


def test_more_readers(spark, tmp_path):
    (tmp_path / "c" / "one").mkdir(parents=True)
    (tmp_path / "c" / "none").mkdir()
    (tmp_path / "c" / "one" / "a.jsonl").write_text('{"text": "x", "label": "p"}\n')
    assert readers.discovered(spark, f"file://{tmp_path}/c") == ["one"]
    (tmp_path / "t.json").write_text('[{"text": "y", "more": 1}]')
    (tmp_path / "u.csv").write_text('text,label\n"z, ""q""",n\n')
    parts = [readers.labelled(spark, f"{tmp_path}/{p}") for p in ("c/one/a.jsonl", "t.json", "u.csv")]
    assert {r["text"] for r in readers.united(parts).collect()} == {"x", "y", 'z, "q"'}
    parts[0].write.parquet(str(tmp_path / "p.parquet"))
    assert readers.open_source(spark, "labelled", str(tmp_path / "p.parquet")).count() == 1
    got = readers.folder(spark, str(tmp_path / "c"), recursive=True).collect()
    assert [(r["source"], r["value"]) for r in got] == [("a", '{"text": "x", "label": "p"}')]
    assert readers.json_lines(spark, str(tmp_path / "c" / "one")).first()["file"] == "a.jsonl"
    sinks.write_ranked(spark.createDataFrame([(0, 1), (1, 2)], "rank int, pos int"), str(tmp_path / "ranks"))
    assert sorted(p.name for p in (tmp_path / "ranks").glob("rank=*")) == ["rank=0", "rank=1"]


def test_totals_of_a_strategy(spark):
    kinds = catalog.KINDS
    t = spark.createDataFrame([("s", k, 10 * k, 5, k, 1, 1) for k in (1, 2, 3)], kinds["tokenised"].columns)
    q = spark.createDataFrame([("s", k, 2, k) for k in (1, 2, 3)], kinds["sequences"].columns)
    v = spark.createDataFrame([("v", 1, "preserved", 1, 1), ("v", 2, "skipped", 1, 1), ("v", 3, "partial", 1, 1)], kinds["view_source"].columns)
    assert iterate.strategy_totals(t, q, v, "s", "v", 128, 64) == {"multiplier": 2, "tokens": 40, "chunks": 4, "sequences": 4}


def test_streaming_ingest(spark, tmp_path):
    from quern.streaming import ingest as stream

    source = tmp_path / "in"
    source.mkdir()
    (source / "1.jsonl").write_text('{"text": "long enough text"}\n{"a": 1}\n')
    stream.start(spark, str(source), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    (source / "2.jsonl").write_text('{"text": "another long text"}\n')
    stream.start(spark, str(source), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert {tuple(r) for r in stream.totals(spark, str(tmp_path / "t")).collect()} == {("accepted", 2), ("missingDataKey", 1)}
