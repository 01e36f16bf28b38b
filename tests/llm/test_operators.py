"""The training-data operators against brute force, and on awkward input: nulls, empty and long texts,
ties, repeated rows, empty tables and extra columns with clashing names."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import (
    image_copies,
    licences,
    mixing,
    packing,
    quality_classifier,
    quality_rules,
    queries,
    repeats,
    simhash,
    suffix_array,
    url_filter,
    warc,
)

from .. import twins

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, digest string, score double, p double, tokens int, t string"
PROSE = "The quick brown fox jumps over the lazy dog and runs away from it to the end of the long and winding road by the sea."


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward documents, with columns whose names the operators use themselves."""
    texts = {1: PROSE, 2: PROSE, 3: None, 4: "", 5: " \n\t ", 6: "word " * 5000, 7: "x" * 30_000, 8: PROSE + " " + PROSE, 9: "é" * 120 + "ü", 10: PROSE.lower()}
    rows = [(k, t, "en" if k % 2 else None, "s", None, "i", 1, "d", 0.5, 0.1, 3, "q") for k, t in texts.items()]
    rows += [rows[0], (None, PROSE, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, sf_dir, name):
    twins.check(spark, sf_dir, queries.QUERIES[name], queries.ORACLES[name])


def test_rules_on_odd_texts(odd):
    rows = {r["doc_id"]: r for r in quality_rules.apply_rules(odd).collect()}
    assert rows[3]["n_words"] == rows[4]["n_words"] == rows[5]["n_words"] == 0
    assert not rows[3]["kept"] and rows[3]["base_failed"] and not rows[6]["kept"] and rows[6]["n_repeat_words"] == 5000
    assert rows[1]["kept"] and rows[1]["n_repeat_words"] == 0 and rows[8]["base_failed"]
    assert quality_rules.apply_rules(odd).count() == 12 and quality_rules.apply_rules(odd.limit(0)).count() == 0


def brute_repeat_words(words):
    seen, hit = {}, set()
    for k in range(len(words) - 7):
        seen.setdefault(tuple(words[k : k + 8]), []).append(k)
    for at in seen.values():
        if len(at) > 1:
            for k in at:
                hit |= set(range(k, k + 8))
    return len(hit)


def test_repeat_words_by_brute_force(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(list("ab"), n)) for n in range(0, 60)] + [" ".join(map(str, rng.integers(0, 9, n))) for n in range(0, 300, 7)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.measure(df).collect()}
    assert got == {k: brute_repeat_words(t.split()) for k, t in enumerate(texts)}


def brute_components(values, radius):
    ids = list(values)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if bin(values[a] ^ values[b]).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint_by_definition():
    for text in ("", "A", "one Two three", "a b c d e f a b c d", "É é\x0bx\x0cy z w"):
        words = text.encode().lower().split()
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(None) == 0


def test_links_by_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    values = []
    for b in base:  # chains whose neighbours are close and whose ends are not
        for _ in range(int(rng.integers(1, 9))):
            values.append(int(b))
            for bit in rng.choice(64, int(rng.integers(0, 5)), replace=False):
                b ^= np.uint64(1) << np.uint64(bit)
    distinct = sorted(set(values))
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in distinct], "fp long")
    roots = simhash.components(simhash.shard_links(df, 4))
    got = {int(np.int64(r["u"]).view(np.uint64)): int(np.int64(r["v"]).view(np.uint64)) for r in roots.collect()}
    want = brute_components({v: v for v in distinct}, 4)
    groups = lambda m: {frozenset(k for k in distinct if m.get(k, k) == r) for r in {m.get(k, k) for k in distinct}}
    assert groups(got) == groups(want)


def test_near_duplicates_on_odd_texts(odd):
    rows = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()]
    by = {i: (f, c) for i, f, c in rows if i is not None}
    assert len(rows) == 12 and by[3] == by[4] == by[5] == ("0" * 16, 3)
    assert by[1][1] == by[2][1] == by[10][1] == 1 and {c for i, _, c in rows if i is None} == {1}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_frequent_keys_join_like_others(spark, monkeypatch):
    from quern.llm import common

    rows = spark.range(3000).select("id", F.when(F.col("id") < 1500, 7).otherwise(F.col("id") % 50).alias("k"))
    small = spark.range(40).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    want = sorted((r["id"], r["v"]) for r in rows.join(small, "k").collect())
    assert sorted((r["id"], r["v"]) for r in common.join_frequent(rows, small, "k", 3000).collect()) == want
    monkeypatch.setattr(common, "FEW", 0)
    assert sorted((r["id"], r["v"]) for r in common.join_frequent(rows, small, "k", 3000).collect()) == want and len(want) > 1500


def test_large_groups_give_stars(spark):
    values = [(7 << 20) ^ (1 << k) for k in range(20)] * 3
    df = spark.createDataFrame([(v,) for v in set(values)], "fp long")
    assert simhash.shard_links(df, 4).count() <= 20 * 4 * 16


def test_suffix_array_by_brute_force():
    rng = np.random.default_rng(2)
    for k in range(120):
        text = rng.integers(0, 1 + k % 4 + 1, int(rng.integers(0, 300))).astype(np.uint8)
        if k % 3 == 0 and len(text):
            text = np.tile(text[: 1 + len(text) // 9], 7)
        depth = 24 if k % 2 else 100
        raw = text.tobytes() + bytes(depth)
        order = suffix_array.suffix_array(text, depth)
        cut = [raw[i : i + depth] for i in order]
        assert sorted(order) == list(range(len(text))) and cut == sorted(cut)
        lcp = suffix_array.common_prefixes(order, suffix_array.words8(text), depth)
        for a, b, n in zip(cut, cut[1:], lcp[1:]):
            assert n == next((j for j in range(depth) if a[j] != b[j]), depth)


def brute_removed(docs, length):
    """Per text of ``docs``, given in order: bytes, removed bytes, spans and the sum of what stays."""
    seen, out = set(), []
    for text in docs:
        covered = bytearray(len(text))
        for i in range(len(text) - length + 1):
            w = text[i : i + length]
            if w in seen:
                covered[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, m in zip(text, covered) if not m)
        spans = sum(1 for i, m in enumerate(covered) if m and (i == 0 or not covered[i - 1]))
        out.append((len(text), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    rng = np.random.default_rng(9)
    shared = "".join(rng.choice(list("abcdefgh "), 2000))
    texts = {}
    for k in range(80):
        parts = ["".join(rng.choice(list("abcdefgh é"), int(rng.integers(0, 300))))]
        for _ in range(int(rng.integers(0, 4))):
            at = int(rng.integers(0, 1800))
            parts += [shared[at : at + int(rng.integers(50, 260))], "".join(rng.choice(list("xyz"), int(rng.integers(0, 40))))]
        texts[k] = "".join(parts)
    texts |= {100: "ab" * 400, 101: "ab" * 60, 102: "z" * 99, 103: "z" * 100, 104: "z" * 101, 105: "é" * 300, 106: shared}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:5] for r in repeats.remove_repeats(df).collect()}
    assert list(got.values()) and got == dict(zip(sorted(texts), brute_removed([texts[k].encode() for k in sorted(texts)], 100)))


def test_repeats_of_null_and_repeated_ids(spark):
    """Rows without an id and rows that share one, with different texts, by brute force in the documented order."""
    rng = np.random.default_rng(21)
    passage = "".join(rng.choice(list("abcdefgh "), 240))
    own = lambda n: "".join(rng.choice(list("klmnop "), n))
    rows = [(None, own(50) + passage + own(30)), (None, own(200)), (None, passage[40:] + own(5)), (None, own(50)), (None, None)]
    rows += [(3, own(50) + passage), (3, own(50) + passage[:180] + own(120)), (3, own(20)), (3, passage), (7, passage * 2), (None, own(50) + passage[3:])]
    rows += [rows[0], rows[5], (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = {(r["doc_id"], r["text"]): r["h"] for r in df.withColumn("h", F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))).collect()}
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, key.get(r, key.get((r[0], None)))))
    want = dict(zip(order, brute_removed([t.encode() for _, t in order], 100)))
    got = sorted((tuple(r)[:5] for r in repeats.remove_repeats(df).collect()), key=repr)
    assert got == sorted(((i, *want[i, t or ""]) for i, t in rows), key=repr)


def test_repeats_of_a_frequent_anchor(spark, monkeypatch):
    """A phrase in every document, in different contexts: met window by window, sorted in turns, as by brute force."""
    monkeypatch.setattr(repeats, "FLUSH", 3000)
    rng = np.random.default_rng(5)
    phrase = "".join(rng.choice(list("abcdefgh"), 70))
    words = ["".join(rng.choice(list("uvwxyz"), 40)) for _ in range(12)]
    texts = {k: words[int(rng.integers(12))] + phrase + words[int(rng.integers(12))] + str(k) for k in range(300)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = dict(zip(texts, brute_removed([t.encode() for t in texts.values()], 100)))
    assert len(repeats.frequent_anchors(repeats._keyed(df, "doc_id", "text"))) > 0
    run = lambda: {r["doc_id"]: tuple(r)[1:5] for r in repeats.remove_repeats(df).collect()}
    assert run() == want
    rows = repeats.Batch(100)
    for k, t in texts.items():
        rows.add(k, k, t.encode())
    found, at, data = rows.stretches()
    whole = np.concatenate(repeats.settle(found, at, data)[0])["n"].sum()
    monkeypatch.setattr(repeats, "LIMIT", 4000)
    monkeypatch.setattr(repeats, "SORTED", 2000)
    assert np.concatenate(repeats.settle(found, at, data)[0])["n"].sum() == whole


def test_repeats_on_odd_texts(odd):
    rows = repeats.remove_repeats(odd, texts=True, keep=("lang", "t")).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 12 and by[3]["n_bytes"] == 0 and by[3]["kept_text"] == "" and by[1]["t"] == "q"
    assert by[7]["n_removed"] == 30_000 - 100 or by[7]["n_removed"] == 30_000 - 1  # a run of one letter
    assert by[None]["n_removed"] == 0 and by[1]["n_removed"] == len(PROSE) and by[1]["kept_text"] == ""
    assert repeats.remove_repeats(odd.limit(0)).count() == 0


def test_packing_is_whole_and_tight(spark, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = [r.asDict() for r in packing.pack(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), tokenizer_path(), window=64).collect()]
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for doc in {r["doc_id"] for r in rows}:
        ids = np.array([*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 1], dtype="<u4")
        pieces = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows if r["doc_id"] == doc)
        at = 0
        for start, n, crc, total in pieces:
            assert (start, total) == (at, len(ids)) and zlib.crc32(ids[start : start + n].tobytes()) == crc
            at += n
        assert at == len(ids)
    for s in {r["sequence_id"] for r in rows}:
        own = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == s)
        assert all(o == sum(n for _, n in own[:k]) for k, (o, _) in enumerate(own)) and sum(n for _, n in own) <= 64
    assert packing.pack(odd, tokenizer_path()).count() == sum(1 for _ in packing.pack(odd, tokenizer_path()).collect()) >= 12
    assert packing.pack(odd.limit(0), tokenizer_path()).count() == 0


def brute_best_fit(lengths, window):
    open_ = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(open_) if room >= n]
        if fits:
            k = min(fits, key=lambda k: open_[k])
            open_[k] -= n
        else:
            open_.append(window - n)
    return sorted(open_)


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(1)
    for k in range(60):
        window = int(rng.integers(5, 60))
        lengths = rng.integers(1, window, int(rng.integers(0, 200))).tolist()
        counts = {n: lengths.count(n) for n in set(lengths)}
        rooms, got = {}, {n: [] for n in counts}
        for n, first, until, sequence, offset in packing.plan(counts, window):
            got[n] += range(first, until)
            for r in range(first, until):
                s = sequence + r - first
                assert rooms.get(s, 0) == offset
                rooms[s] = offset + n
        assert all(sorted(v) == list(range(counts[n])) for n, v in got.items())
        assert sorted(window - v for v in rooms.values()) == brute_best_fit(lengths, window)


def test_encoder_matches_the_library():
    import random

    e, dice = packing.Encoder(tokenizer_path()), random.Random(3)
    letters = "abcDEF 0123 .,!'’“–…€ éüßñΩяж中あア한\n\t\r\x00\x1b\x1c\x85\xa0\u2028\u180e  's 'll"
    for k in range(500):
        text = "".join(dice.choice(letters) for _ in range(dice.randint(0, 60))) + ("<|endoftext|> a" if k % 7 == 0 else "")
        assert np.frombuffer(e(text), dtype="<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_matches_the_library_on_every_text():
    """All texts of the largest given table, ids in whole, whichever way the encoder takes."""
    import os

    import duckdb

    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no such table")
    e = packing.Encoder(tokenizer_path())
    cur = duckdb.connect().execute(f"select distinct coalesce(text, '') from '{path}'")
    while rows := cur.fetchmany(2000):
        texts = [t for t, in rows]
        for text, want in zip(texts, e.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            assert e(text) == np.array(want.ids, dtype="<u4").tobytes()


def test_urls_on_odd_rows(spark):
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "http://a.net/es", "http://a.net/es/", "ftp://net/fr/1", "http://x.org/a?utm_source=1", "http://x.org/a", "http://notexample.com/en/", "http://example.com/en/", "x://y.com"]
    df = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(urls)] + [(0, None, "", "")], "page_id long, url string, host string, key string")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_filter.judge(df, url_filter.tracked_urls(df)).collect()}
    assert got[0] == got[1] == got[2] == ("", None, "allow")
    assert got[4] == ("www.example.com", "www.example.com/en/", "allow") and got[11] == ("example.com", "example.com/en/", "block")
    assert got[5][1:] == (None, "allow") and got[6][1:] == ("net/es/", "block") and got[7][1:] == ("net/fr/", "block")
    assert got[8][2] == got[9][2] == "block" and got[10][1:] == ("com/", "allow") and got[12][1:] == (None, "allow")
    assert url_filter.judge(df.limit(0), url_filter.tracked_urls(df.limit(0))).count() == 0
    assert url_filter.judge(df, url_filter.tracked_urls(df.limit(0)), rules=()).where("verdict = 'block'").count() == 0


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    words = url_filter.build_filter(keys, 5000)
    probe = url_filter.may_contain(spark, words)
    share = lambda df: df.select(probe(F.array(F.xxhash64("key")))[0].cast("int").alias("x")).agg(F.avg("x")).first()[0]
    assert share(keys) == 1.0 and share(spark.range(5000).select(F.concat(F.lit("o"), "id").alias("key"))) < 0.05


def test_classifier_held_out(spark, sf_dir):
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = queries.QUERIES["op10_quality_classifier"](spark, sf_dir).join(seen, "doc_id").where("held_out").collect()
    assert docs.count() == queries.QUERIES["op10_quality_classifier"](spark, sf_dir).count()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_classifier_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (8, None), (3, 1)], "doc_id long, quality int")
    rows = quality_classifier.score(odd, quality_classifier.fit(odd, labels)).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    none = quality_classifier.fit(odd, labels.limit(0))
    assert {r["score"] for r in quality_classifier.score(odd, none).collect()} == {0.5}
    assert quality_classifier.score(odd.limit(0), none).count() == 0


def test_labels_that_disagree(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, "bad bad"), (3, "both ways"), (1, "another text")], "doc_id long, text string")
    both = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 1), (1, 1)], "doc_id long, quality int")
    one = spark.createDataFrame([(2, 0), (1, 1)], "doc_id long, quality int")
    assert (quality_classifier.fit(docs, both) == quality_classifier.fit(docs.where("doc_id < 3"), one)).all()


def plain_ftrl(rows, bits, epochs=3, seed=11):
    """FTRL-Proximal coordinate by coordinate, over dicts; then the score of every row as a sum of products."""
    z, n = {}, {}
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= 0.02 else -(z[i] - np.sign(z[i]) * 0.02) / ((1.0 + n[i] ** 0.5) / 0.5 + 0.1)
    ones = sum(y for _, _, y in rows)
    order = np.random.default_rng(seed).permutation(len(rows))
    rng = np.random.default_rng(seed)
    rng.permutation(len(rows))
    for _ in range(epochs):
        for k in rng.permutation(order):
            at, x, y = rows[k]
            pairs = [*zip(at.tolist(), x.tolist()), (1 << bits, 1.0)]
            margin = sum(weight(i) * v for i, v in pairs)
            share = len(rows) / (2 * (ones if y else len(rows) - ones))
            step = {i: (1 / (1 + np.exp(-margin)) - y) * v * share for i, v in pairs}
            old = {i: weight(i) for i in step}
            for i, g in step.items():
                z[i] = z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / 0.5 * old[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_ftrl_and_scores_by_brute_force(spark):
    rng = np.random.default_rng(8)
    bits = 10
    texts = [" ".join(rng.choice(["a", "Bb", "cc!", "d1", "e", "ff"] if k % 2 else ["a", "x", "yy", "z9", "q"], int(rng.integers(0, 30)))) for k in range(40)]
    rows = [(*quality_classifier.unique_features(t.encode(), bits), float(k % 2)) for k, t in enumerate(texts)]
    got, want = quality_classifier.train(rows, bits), plain_ftrl(rows, bits)
    assert np.allclose(got, [want.get(i, 0.0) for i in range(len(got))], atol=1e-5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in quality_classifier.score(df, got, bits).collect()}
    for k, (at, x, _) in enumerate(rows):
        margin = want.get(1 << bits, 0.0) + sum(want.get(i, 0.0) * v for i, v in zip(at.tolist(), x.tolist()))
        assert abs(scores[k] - 1 / (1 + np.exp(-margin))) < 1e-5


def test_training_rows_are_bounded(spark):
    rows = [(k, 1.0, f"w{k} v{k} u{k}".encode()) for k in range(50)]
    df = spark.createDataFrame(rows, "h long, y double, t binary")
    each = len(quality_classifier.unique_features(rows[0][2], 12)[0])
    got = quality_classifier.training_rows(df, 12, 10 * each + 5)
    assert 8 <= len(got) <= 12 and sum(len(at) for at, _, _ in got) <= 10 * each + 5 and quality_classifier.training_rows(df.limit(0), 12) == []


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + PROSE * 20
    pages = [(1, "http://a/\nx", big, "d"), (2, None, big, "d"), (3, "u", None, "d"), (4, "u", "", "d"), (5, "u", "short", "d"), (6, "u", "short", "d"), (7, "u", "é" * 500, "d"), (8, "u", "é" * 500, "d"), (8, "u", "é" * 500, "d"), (8, "u", "other", "d"), (9, "u", "x" * 3_000_000, "d"), (None, "u", big, "d")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string")
    manifest = warc.archive(df, f"file://{tmp_path}/w")
    rows = warc.read_archives(manifest).collect()
    assert len(rows) == len(pages) == manifest.agg(F.sum("records")).first()[0]
    name = lambda u: u and u.rpartition(":")[0] + ">"
    kinds = {(name(r["record_id"]), r["record_type"], name(r["refers"])) for r in rows}
    assert {r["refers"] for r in rows} - {None} <= {r["record_id"] for r in rows if r["record_type"] == "response"}
    assert ("<urn:page:1>", "revisit", "<urn:page:2>") in kinds and ("<urn:page:2>", "response", None) in kinds
    assert ("<urn:page:7>", "revisit", "<urn:page:8>") in kinds and ("<urn:page:5>", "response", None) in kinds
    for r in rows:
        if r["record_type"] == "response":
            assert hashlib.sha1(r["payload"]).hexdigest() == r["digest"].removeprefix("sha1:") and len(r["payload"]) == r["payload_bytes"]
    assert warc.read_archives(warc.archive(df.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_archives_start_with_the_dictionary(tmp_path, spark):
    import zstandard

    df = spark.createDataFrame([(k, "u", f"<html>{k} {PROSE * 3}</html>") for k in range(300)], "page_id long, url string, html string")
    path = warc.archive(df, f"file://{tmp_path}/w").first()["path"].removeprefix("file://")
    data = open(path, "rb").read()
    assert int.from_bytes(data[:4], "little") == warc.DICT_MAGIC
    size = int.from_bytes(data[4:8], "little")
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj().decompress(data[8 + size :])
    assert plain.startswith(b"WARC/1.1\r\n")
    # Trained on records as they are archived: their headers are in it.
    assert b"WARC-Target-URI: u" in data[8 : 8 + size]


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."
    cases = ["no such words", "Licensed under CC BY-NC 4.0.\nText.", "text\nReleased under the MIT License.\nmore", mit, "x. Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.", "Some odd license text.", None, ""]
    df = spark.createDataFrame([(k, t, "l") for k, t in enumerate(cases)] + [(0, cases[0], "l")], "doc_id long, text string, lines string")
    rows = licences.scan(df).collect()
    got = {r["doc_id"]: r["licences"] for r in rows}
    assert len(rows) == 9 and got == {0: [], 1: ["CC-BY-NC-4.0"], 2: ["MIT"], 3: ["MIT"], 4: ["Apache-2.0"], 5: [], 6: [], 7: []}
    assert {r["doc_id"]: r["n_unknown"] for r in rows}[5] == 1 and licences.scan(df.limit(0)).count() == 0


def test_licence_notices_as_published(spark):
    gpl = "This program is free software{} you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation{} either version {} of the License, or\n(at your option) any later version.\n"
    hope = "\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."
    cases = [
        (gpl.format(":", ",", 3) + hope, "GPL-3.0-or-later"), (gpl.format(":", ",", 3), "GPL-3.0-or-later"),
        (gpl.format(";", ";", 2) + hope, "GPL-2.0-or-later"), (gpl.format(";", ";", 2), "GPL-2.0-or-later"),
        (mpl + " If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"), (mpl, "MPL-2.0"),
        (licences._APACHE.format("http").replace("at http", "at\n\n    http").replace("2.0 Unless", "2.0\n\nUnless"), "Apache-2.0"),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licences.scan(df).collect()}
    assert got == {k: [name] for k, (_, name) in enumerate(cases)}
    old = spark.createDataFrame([(k, ". ".join(next(s for s, n in licences.KNOWN.items() if n == i) for i in ids) + ".") for k, (_, ids) in enumerate(licences.ALL_RULES) if "mpl-2-terms" not in ids], "doc_id long, text string")
    assert all(licences.ALL_RULES[r["doc_id"]][0] in r["licences"] for r in licences.scan(old).collect())


def brute_licences(text):
    """Sentences one after another, looked up; each rule takes its sentences by index, from the left."""
    found = set()
    for way in (text, re.sub(r"[\n\r]+", ". ", text)):
        ids = [licences.KNOWN.get(s, licences.UNKNOWN) for s in licences.cut(way)]
        for name, rule in licences.ALL_RULES:
            at = 0
            while at <= len(ids) - len(rule):
                if tuple(ids[at : at + len(rule)]) == rule:
                    ids[at : at + len(rule)] = [None]
                    found.add(name)
                at += 1
    return sorted(found)


def test_licences_by_brute_force(spark):
    rng = np.random.default_rng(12)
    known = list(licences.KNOWN)
    bsd = [s for s, i in licences.KNOWN.items() if i.startswith("bsd-")]
    texts = [". ".join(bsd) + ". " + ". ".join(bsd) + ".", ".\n".join(bsd * 3) + ".", ". ".join(bsd[:3] + bsd) + "."]
    texts += [". ".join([*rng.choice(known, int(rng.integers(1, 9))), *rng.choice([*bsd, "some odd license text"], int(rng.integers(0, 7)))]) + "." for _ in range(150)]
    for name, rule in licences.ALL_RULES:  # each rule twice in a row, and in the middle of a very long text
        one = ". ".join(next(s for s, i in licences.KNOWN.items() if i == k) for k in rule) + ". "
        texts += [one * 2, PROSE * 50 + " . " + one + PROSE]
    texts += ["word " * 200_000 + texts[0], texts[0] * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licences.scan(df).collect()}
    assert got == {k: brute_licences(t) for k, t in enumerate(texts)} and got[0] == got[1] == ["BSD-3-Clause"] and got[2] == ["BSD-2-Clause", "BSD-3-Clause"]


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [float(p), float(1 - p)], int(rng.integers(10, 500))) for k, p in enumerate(rng.choice([0.02, 0.9, 0.98], 400))]
    members = spark.createDataFrame(rows, "doc_id long, p array<double>, tokens long")
    totals = np.sum([[t * x for x in p] for _, p, t in rows], axis=0)
    targets = [float(totals[0] * 0.5), float(totals[1] * 2)]
    rate, _ = mixing.fit_rates(members, targets, rounds=200, ridge=1e-4)
    got = members.withColumn("r", rate).agg(F.sum(F.expr("r * tokens * p[0]")), F.sum(F.expr("r * tokens * p[1]")), F.min("r")).first()
    assert np.allclose(got[:2], targets, rtol=0.02) and got[2] >= 0


@pytest.mark.parametrize("shares", [(0.7, 0.2, 0.05, 0.05), (0.85, 0.05, 0.05, 0.05), (0.05, 0.05, 0.05, 0.85)])
def test_mixing_meets_skewed_targets_as_registered(spark, shares):
    rng = np.random.default_rng(3)
    rows = [(np.where(np.arange(4) == k % 4, 0.97, 0.01).tolist(), int(rng.integers(50, 500))) for k in range(400)]
    members = spark.createDataFrame(rows, "p array<double>, tokens long")
    targets = [s * sum(t for _, t in rows) for s in shares]
    rate, _ = mixing.fit_rates(members, targets)
    got = members.withColumn("r", rate).agg(*[F.sum(F.expr(f"r * tokens * p[{i}]")) for i in range(4)], F.min("r")).first()
    assert np.allclose(got[:4], targets, rtol=mixing.TOLERANCE) and got[4] >= 0
    with pytest.raises(ValueError):
        mixing.fit_rates(members, targets, rounds=1)


def test_mixing_on_odd_rows(odd):
    mixed, names = mixing.mix(odd, keep=("t",))
    rows = mixed.collect()
    assert len(rows) == 12 and names == ["en"] and all(r["rate"] >= 0 for r in rows)
    assert mixing.mix(odd.limit(0))[0].count() == 0
    assert mixing.mix(odd.withColumn("lang", F.lit(None).cast("string")))[1] == ["other"]


def test_mixing_by_brute_force(spark):
    """The query's numbers, one document at a time: tokens, posterior of the fitted weights, rates by one pull, totals on target."""
    rng = np.random.default_rng(14)
    vocabulary = {"en": "the and of to in", "de": "der und die das ist", "fr": "le la et les des"}
    rows = []
    for k in range(240):
        lang = ["en", "en", "de", "fr"][k % 4]
        rows.append((k, " ".join(rng.choice((vocabulary[lang] + " x y z").split(), int(rng.integers(5, 60)))), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    weights = {"en": 6.0, "de": 1.0, "fr": 3.0}
    mixed, names = mixing.mix(docs, weights=weights)
    got = {r["doc_id"]: r for r in mixed.collect()}
    model = mixing.train_posterior(docs, "lang", "doc_id", "text")
    for k, text, _ in rows:
        at, x = mixing.features(text.encode(), mixing.BITS, shapes=False)
        z = [float(w[-1]) + sum(float(w[i]) * float(v) for i, v in zip(at, x)) for w in model.weights]
        p = [np.exp(v - max(z)) / sum(np.exp(u - max(z)) for u in z) for v in z]
        assert got[k]["tokens"] == len(text.split()) and np.allclose(got[k]["p"], p, atol=1e-5)
    totals = [sum(r["tokens"] * r["p"][d] for r in got.values()) for d in range(3)]
    top = max(totals)
    whole = sum(top * (t / top) ** mixing.TEMPERATURE for t in totals)
    for d, name in enumerate(names):
        reached = sum(r["rate"] * r["tokens"] * r["p"][d] for r in got.values())
        assert abs(reached / (whole * weights[name] / 10.0) - 1) <= mixing.TOLERANCE
    # max(0, 1 + p . x): all rates above zero are one affine function of the posteriors, the others lie below it.
    live = [r for r in got.values() if r["rate"] > 1e-9]
    x = np.linalg.lstsq(np.array([r["p"] for r in live]), np.array([r["rate"] - 1 for r in live]), rcond=None)[0]
    assert all(abs(r["rate"] - max(0.0, 1 + float(np.dot(r["p"], x)))) < 1e-6 for r in got.values())


def test_sums_by_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 90)), rng.dirichlet([1, 1, 1]).tolist()) for _ in range(50)]
    pull = np.array([-3.0, 0.5, 1.5])
    square, got, curvature = mixing._sums(spark.createDataFrame(rows, "tokens long, p array<double>"), pull)
    rates = [max(0.0, 1 + sum(a * b for a, b in zip(p, pull))) for _, p in rows]
    assert np.isclose(square, sum(t * r * r for (t, _), r in zip(rows, rates))) and min(rates) == 0
    for i in range(3):
        assert np.isclose(got[i], sum(t * r * p[i] for (t, p), r in zip(rows, rates)))
        for j in range(3):
            assert np.isclose(curvature[i, j], sum(t * p[i] * p[j] for (t, p), r in zip(rows, rates) if r > 0))


def test_images(spark):
    rng = np.random.default_rng(1)
    vectors = [(k, rng.normal(size=64).astype(float).tolist()) for k in range(30)]
    vectors += [(100, vectors[0][1]), (101, None), (102, [])]
    rows = [tuple(r) for r in image_copies.pictures(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()]
    rows += [(900, 10, 10, b"\0" * 100), (901, 5, 5, b"\0"), (902, None, None, None), (None, 96, 96, rows[0][3]), rows[0]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "image_id long, width int, height int, pixels binary, digest string")
    got = image_copies.copies(df).collect()
    assert len(got) == len(rows)
    part = {r["image_id"]: r["component_id"] for r in got}
    assert sum(part[2 * k] == part[2 * k + 1] for k in range(30)) >= 28
    assert len({part[2 * k] for k in range(30)}) == 30 and part[200] == part[0] == part[None] and part[902] == 902
    assert image_copies.copies(df.limit(0)).count() == 0


def test_images_of_a_frequent_key(spark, monkeypatch):
    monkeypatch.setattr(image_copies, "BLOCK", 16)
    rng = np.random.default_rng(6)
    rows = [(int(i), int(g), int(t * 100 + k)) for g, (i, t, k) in enumerate(zip(rng.integers(0, 300, 700), rng.integers(0, 2, 700), rng.integers(0, 3, 700) ** 3))]
    rows += [(int(i), 1000 + n, int(300 + k)) for n, (i, k) in enumerate(zip(rng.integers(0, 50, 200), rng.integers(0, 60, 200)))]
    got = sorted(tuple(r) for r in image_copies.meetings(spark.createDataFrame(rows, "id long, g long, key long")).select("a", "b", "ga", "gb").collect())
    assert got == sorted((p[0], q[0], p[1], q[1]) for p in rows for q in rows if p[0] < q[0] and p[2] == q[2])


def brute_image_links(pictures, votes=image_copies.VOTES):
    """Every two pictures, every two of their corners: which agree on one turn, scale and shift."""
    corners = {}
    for k, p in pictures.items():
        h, w = p.shape
        corners[k] = [(int(y[i]) - h // 2, int(x[i]) - w // 2, int(t[i]), int(s[i]), words[i].tolist()) for y, x, t, s, words in image_copies.describe(p) for i in range(len(y))]
    links = set()
    cell, turns, wide = image_copies.CELL, image_copies.TURNS, image_copies.TURN_CELL
    for i in corners:
        for j in corners:
            if i == j:
                continue
            cells = {}
            for n, (ya, xa, ta, sa, wa) in enumerate(corners[i]):
                for yb, xb, tb, sb, wb in corners[j]:
                    if wa[:2] != wb[:2] and wa[2:] != wb[2:]:
                        continue
                    t = (tb - ta) % turns
                    f, c, s = 2.0 ** (sb - sa), np.cos(t * (2 * np.pi / turns)), np.sin(t * (2 * np.pi / turns))
                    dx, dy = xb - f * (c * xa - s * ya), yb - f * (s * xa + c * ya)
                    for g in range(8):
                        key = (g, sb - sa, np.floor(dx / cell + (g & 1) / 2), np.floor(dy / cell + (g >> 1 & 1) / 2), np.floor(t / wide + (g >> 2) / 2) % (turns // wide))
                        cells.setdefault(key, set()).add(n)
            if any(len(v) >= votes for v in cells.values()):
                links.add((i, j))
    return links


def test_images_by_brute_force(spark):
    rng = np.random.default_rng(3)
    pictures = {}
    for k in range(7):
        p = image_copies.render(rng.normal(size=64))
        y, x = rng.integers(0, 40, 2)
        pictures |= {10 * k: p, 10 * k + 1: np.ascontiguousarray(p[y : y + 56, x : x + 56]), 10 * k + 2: image_copies.edited(p, int(rng.integers(0, 999)))}
    links = brute_image_links(pictures)
    rows = [(k, p.shape[1], p.shape[0], p.tobytes()) for k, p in pictures.items()]
    got = image_copies.copies(spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary")).collect()
    # The operator counts corners of the image whose hash is smaller, so that links are those of one of the two directions.
    either, both = {frozenset(p) for p in links}, {frozenset((i, j)) for i, j in links if (j, i) in links}
    degree = {r["image_id"]: r["n_links"] for r in got}
    assert all(sum(k in p for p in both) <= degree[k] <= sum(k in p for p in either) for k in pictures)
    assert len({r["component_id"] for r in got}) == 7 and {r["component_id"] for r in got} == set(range(0, 70, 10))


@pytest.mark.parametrize("share", ["half", "quarter"])
def test_images_recall_of_crops(spark, share):
    """Crops to half and to a quarter of the area, brightened or not: at least nine of ten find their original."""
    rng = np.random.default_rng(17)
    side = {"half": 68, "quarter": 48}[share]
    rows = []
    for k in range(60):
        p = image_copies.render(rng.normal(size=64))
        y, x = rng.integers(0, 96 - side + 1, 2)
        crop = p[y : y + side, x : x + side]
        if k % 2:
            crop = np.clip(crop * 0.87 + 11, 0, 255).astype(np.uint8)
        rows += [(2 * k, 96, 96, p.tobytes()), (2 * k + 1, side, side, crop.tobytes())]
    got = {r["image_id"]: r["component_id"] for r in image_copies.copies(spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary")).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(60)) >= 54 and all(got[2 * k] == 2 * k for k in range(60))


def test_images_of_one_id_and_without_id(spark):
    rng = np.random.default_rng(4)
    p, q = (image_copies.render(rng.normal(size=64)) for _ in range(2))
    rows = [(1, p), (1, q), (2, p[:70]), (3, q[:70]), (None, p[10:80, 5:90])]
    df = spark.createDataFrame([(k, v.shape[1], v.shape[0], np.ascontiguousarray(v).tobytes()) for k, v in rows], "image_id long, width int, height int, pixels binary")
    got = sorted((r["image_id"] or 0, r["component_id"], r["n_links"]) for r in image_copies.copies(df).collect())
    assert got == [(0, 1, 2), (1, 1, 1), (1, 1, 2), (2, 1, 2), (3, 1, 1)]


def test_images_with_many_copies(spark):
    picture = image_copies.render(np.random.default_rng(8).normal(size=64)) // 2
    rows = [(k, 96, 96, (picture + k).tobytes()) for k in range(40)]
    got = image_copies.copies(spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary")).collect()
    assert {(r["component_id"], r["n_links"]) for r in got} == {(0, 39)}


def test_stages_by_brute_force(spark, sf_dir):
    """Every stage on a small set with nulls, repeated and clashing rows and extra columns, against plain Python."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    base = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    odd = [(None, base[0][1], "en", None, None), (None, "alone " * 30, None, "s", 5), base[1], (base[2][0], base[3][1], None, "s", 1), (None, None, None, None, None), (9001, "", "de", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    docs = spark.createDataFrame([(*r, "x") for r in base + odd], schema)
    stages = dict(corpus_pipeline.STAGES)
    plain = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    mine = [tuple(r[:5]) for r in docs.collect()]

    weights = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    def passes(text):
        at, x = quality_classifier.unique_features((text or "").encode(), quality_classifier.BITS)
        return sum(float(weights[i]) * float(v) for i, v in zip(at, x)) + float(weights[-1])
    kept = plain(stages["quality classifier"](spark, docs, sf_dir))
    sure = [r for r in mine if passes(r[1]) > 1e-4]
    assert set(sure) <= set(kept) and len(kept) <= len([r for r in mine if passes(r[1]) > -1e-4])

    prints = {t: simhash.fingerprint((t or "").encode()) for _, t, *_ in mine}
    group = brute_components({k: prints[r[1]] for k, r in enumerate(mine)}, 4)
    h = {(r["doc_id"], r["text"]): r["h"] for r in docs.withColumn("h", simhash.text_hash("text")).collect()}
    first = {}
    for k, r in enumerate(mine):
        rank = (r[0] is None, r[0] or 0, h[r[0], r[1]])
        if group[k] not in first or rank < first[group[k]][0]:
            first[group[k]] = (rank, (r[0], r[1]))
    got = stages["near-duplicates"](spark, docs, sf_dir).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted((r for _, r in first.values()), key=repr)

    got = plain(stages["repeated passages"](spark, docs, sf_dir).select("doc_id", F.octet_length("text")))
    order = sorted({(r[0], r[1] or "") for r in mine}, key=lambda r: (r[0] is not None, r[0] or 0, by_bytes(docs)[r]))
    want = {k: v for k, v in zip(order, brute_removed([t.encode() for _, t in order], 100))}
    assert got == sorted(((r[0], want[r[0], r[1] or ""][0] - want[r[0], r[1] or ""][1]) for r in mine), key=repr)

    mixed = stages["mixing"](spark, docs, sf_dir).collect()
    assert {tuple(r) for r in mixed} == set(mine) and len(mixed) >= len(mine)

    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = stages["packing"](spark, docs, sf_dir).collect()
    assert sum(r["length"] for r in pieces) == sum(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in mine)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name


def by_bytes(docs):
    h = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("h"))
    return {(r["doc_id"], r["t"]): r["h"] for r in h.collect()}


def test_pipeline_against_its_parts(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert ids <= before, name
        if name != "packing":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
            docs = corpus_pipeline.stash(docs, "test-stage")
        if name in ("repeated passages", "mixing", "packing"):
            assert ids == before, name  # only the first two stages drop documents
        before = ids
