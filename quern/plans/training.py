"""Queries over tokenisation, chunks, iteration, batches, masking and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import batch, chunking, ingest, iterate, labels, masking, pretok, tokenise, views
from ..operators.permute import Permutation
from .corpus import INDEX_SQL, _view
from .registry import query, table

LIMIT = 62  # chunk size 64, two places for begin and end


def _docs(spark, sf_dir, *columns):
    return table(spark, sf_dir, "documents").select("doc_id", *columns)


# --- tokens -----------------------------------------------------------------

@query("""
select doc_id, len(b)::bigint n_ids, array_to_string(b, ' ') ids from (
  select doc_id, list_concat([257], list_transform(range(octet_length(encode(text))), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::int), [258]) b from documents)
""")  # fmt: skip
def byte_tokens(spark, sf_dir):
    ids = tokenise.byte_ids(F.col("text"))
    return _docs(spark, sf_dir, ids.alias("b")).select("doc_id", F.size("b").cast("long").alias("n_ids"), F.array_join("b", " ").alias("ids"))


@query("select doc_id, text from documents")
def byte_decode_roundtrip(spark, sf_dir):
    return _docs(spark, sf_dir, tokenise.byte_ids(F.col("text")).alias("b")).select("doc_id", tokenise.byte_text(F.col("b")).alias("text"))


@query("""
with b as (select doc_id, list_transform(range(least(32, octet_length(encode(text)))), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::int) x from documents)
select doc_id, array_to_string(list_resize(list_append(x, 258)[1:32], 32, 259), ' ') ids, (32 - len(list_append(x, 258)[1:32]))::bigint n_pad from b
""")  # fmt: skip
def byte_fixed_length(spark, sf_dir):
    x = tokenise.fitted(tokenise.byte_ids(F.col("text"), bos=None), 32)
    return _docs(spark, sf_dir, x.alias("x")).select(
        "doc_id", F.array_join("x", " ").alias("ids"), F.size(F.filter(tokenise.is_pad(F.col("x")), lambda m: m)).cast("long").alias("n_pad")
    )


@query("select source, count(*) n, case when count(*) <= 255 then 'uint8' when count(*) <= 65535 then 'uint16' else 'uint32' end dtype from documents group by 1")
def dtype_select(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.withColumn("dtype", tokenise.dtype_of(F.col("n")))


@query("select doc_id, nfc_normalize(text) nfc from documents")
def nfc_normalise(spark, sf_dir):
    return tokenise.nfc(_docs(spark, sf_dir, "text")).drop("text")


@query(r"select doc_id, regexp_replace(text, '[^\x{0}-\x{7F}\x{370}-\x{3FF}\s\pN\pP]', '', 'g') kept from documents")
def unicode_filter(spark, sf_dir):
    return _docs(spark, sf_dir, tokenise.only_ranges(F.col("text"), ["basic_latin", "greek"]).alias("kept"))


@query("select 'greek' as name, unnest(range(880, 1024))::int code union all select 'hebrew', unnest(range(1424, 1536))::int")
def unicode_alphabet(spark, sf_dir):
    return tokenise.alphabet(spark, ["greek", "hebrew"])


@query()
def hf_bpe_encode(spark, sf_dir):
    """Ids of a vocabulary file; no SQL twin, the tests compare with the library itself."""
    import public_tokenizers

    got = tokenise.encoded(_docs(spark, sf_dir, "text"), public_tokenizers.path("byte_bpe_50k.json"), eos=50_256)
    return got.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.element_at("tokens", 1).alias("first"), F.crc32(F.array_join("tokens", " ").cast("binary")).alias("checksum"))


@query("select doc_id, text from documents")
def hf_decode_roundtrip(spark, sf_dir):
    """Ids of a byte-level vocabulary and back: nothing is lost."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = tokenise.encoded(_docs(spark, sf_dir, "text"), path)
    return got.select("doc_id", tokenise.decoded(F.col("tokens"), path).alias("text"))


@query()
def hf_batch_encode(spark, sf_dir):
    """Cut and padded to 128 ids; the tests compare with the library itself."""
    import public_tokenizers

    rows = tokenise.batch_encoded(_docs(spark, sf_dir, "text"), public_tokenizers.path("byte_bpe_50k.json"), 128, 0, eos=50_256)
    return rows.select("doc_id", F.array_join("ids", " ").alias("ids"), "n_ids", F.size(F.filter("padding", lambda m: m)).alias("n_pad"))


@query()
def chunk_aligned_tokens(spark, sf_dir):
    """Chunks of a tokenizer's ids at sentence bounds, by offsets; tested against a plain model."""
    import public_tokenizers

    rows = chunking.tokenised_chunks(_docs(spark, sf_dir, "text"), public_tokenizers.path("byte_bpe_50k.json"), LIMIT)
    return rows.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("sizes", " ").alias("sizes"))


@query()
def chunk_small_tokens(spark, sf_dir):
    """The same by the carried-tail rule."""
    import public_tokenizers

    rows = chunking.tokenised_chunks(_docs(spark, sf_dir, "text"), public_tokenizers.path("byte_bpe_50k.json"), LIMIT, "small")
    return rows.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("sizes", " ").alias("sizes"))


# --- sentences and chunks ---------------------------------------------------

SENTENCE_SQL = r"""
sent as (select doc_id, source, list_filter(string_split(regexp_replace(text, '([.!?]+[ \n]+)', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') s from documents),
cnt as (select doc_id, source, list_transform(s, lambda x: len(list_filter(regexp_split_to_array(x, '[ \n\r\t]+'), lambda w: w <> ''))::int) c from sent)"""
CHUNK_SQL = f"""{SENTENCE_SQL},
pieces as (select doc_id, source, flatten(list_transform(list_filter(c, lambda n: n > 0), lambda n: list_transform(range((n + {LIMIT} - 1) // {LIMIT}), lambda k: least({LIMIT}, n - k * {LIMIT})::int))) p from cnt),
folded as (select doc_id, source, list_reduce(list_prepend({{'o': 0, 'd': []::int[]}}, list_transform(p, lambda x: {{'o': x, 'd': []::int[]}})),
  lambda a, x: case when a.o + x.o <= {LIMIT} then {{'o': (a.o + x.o)::int, 'd': a.d}} else {{'o': x.o, 'd': list_append(a.d, a.o)}} end) f from pieces),
chunks as (select doc_id, source, case when f.o > 0 then list_append(f.d, f.o) else f.d end sizes from folded)"""


def _counts(spark, sf_dir, *more):
    words = lambda s: F.size(F.filter(F.split(s, r"[ \n\r\t]+"), lambda w: w != ""))
    return _docs(spark, sf_dir, "source", F.transform(chunking.sentences(F.col("text")), words).alias("counts"), *more)


def _pretok(spark, sf_dir, *more):
    """(doc_id, source, sizes): whitespace words packed at sentence boundaries."""
    return _counts(spark, sf_dir, *more).select("doc_id", "source", chunking.aligned(F.col("counts"), LIMIT).alias("sizes"), *[c for c in ("tokens",) if more])


@query(f"""
with {SENTENCE_SQL}, l as (select doc_id, unnest(s) x, generate_subscripts(s, 1) k from sent)
select doc_id, (k - 1)::int sentence, coalesce(sum(length(x)) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0)::bigint as start,
  sum(length(x)) over (partition by doc_id order by k)::bigint as "end" from l
""")
def sentence_spans(spark, sf_dir):
    lens = F.transform(chunking.sentences(F.col("text")), lambda s: F.length(s))
    d = _docs(spark, sf_dir, lens.alias("n"))
    return d.select("doc_id", F.posexplode(chunking.spans(F.col("n"))).alias("sentence", "s")).select("doc_id", "sentence", "s.start", "s.end")


@query(f"with {CHUNK_SQL} select doc_id, array_to_string(p, ' ') pieces from pieces")
def chunk_trim(spark, sf_dir):
    return _counts(spark, sf_dir).select("doc_id", F.array_join(chunking.trimmed(F.col("counts"), LIMIT), " ").alias("pieces"))


@query(f"with {CHUNK_SQL} select doc_id, len(sizes)::bigint n_chunks, array_to_string(sizes, ' ') sizes from chunks")
def chunk_greedy(spark, sf_dir):
    return _pretok(spark, sf_dir).select("doc_id", F.size("sizes").cast("long").alias("n_chunks"), F.array_join("sizes", " ").alias("sizes"))


def _fold_sql(step: str) -> str:
    """A fold over the sentences' sizes, with the state o (open) and d (done), as text."""
    return f"""
with {SENTENCE_SQL}, f as (select doc_id, list_reduce(list_prepend({{'o': 0, 'd': []::int[]}}, list_transform(c, lambda x: {{'o': x, 'd': []::int[]}})), lambda a, x: {step}) f from cnt)
select doc_id, array_to_string(case when f.o > 0 then list_append(f.d, f.o) else f.d end, ' ') sizes from f"""


@query(_fold_sql(f"""case when a.o + x.o <= {LIMIT} then {{'o': (a.o + x.o)::int, 'd': a.d}}
  else {{'o': case when x.o > {LIMIT} then (x.o % {LIMIT})::int else x.o end,
    'd': list_concat(case when a.o > 0 then list_append(a.d, a.o) else a.d end, list_transform(range(case when x.o > {LIMIT} then x.o // {LIMIT} else 0 end), lambda k: {LIMIT}))}} end"""))
def chunk_sentences(spark, sf_dir):
    """Strategy with a carried tail."""
    return chunking.folded(_counts(spark, sf_dir), "counts", LIMIT, "sentences").select("doc_id", F.array_join("chunks", " ").alias("sizes"))


_PARTS = f"((x.o + {LIMIT} - 1) // {LIMIT})"


@query(_fold_sql(f"""case when x.o > {LIMIT} then {{'o': (x.o // {_PARTS} + case when {_PARTS} - 1 < x.o % {_PARTS} then 1 else 0 end)::int,
    'd': list_concat(list_append(a.d, a.o), list_transform(range({_PARTS} - 1), lambda k: (x.o // {_PARTS} + case when k < x.o % {_PARTS} then 1 else 0 end)::int))}}
  when a.o + x.o > {LIMIT} then {{'o': x.o, 'd': list_append(a.d, a.o)}} else {{'o': (a.o + x.o)::int, 'd': a.d}} end"""))
def chunk_equal_parts(spark, sf_dir):
    """Legacy strategy with near-equal parts."""
    return chunking.folded(_counts(spark, sf_dir), "counts", LIMIT, "equal_parts").select("doc_id", F.array_join("chunks", " ").alias("sizes"))


@query(f"""
with {CHUNK_SQL}, l as (select doc_id, unnest(sizes) n, generate_subscripts(sizes, 1) k from chunks)
select doc_id, (k - 1)::int chunk, (sum(n) over w - n)::bigint as start, (sum(n) over w)::bigint as "end" from l window w as (partition by doc_id order by k)
""")
def sizes_to_spans(spark, sf_dir):
    p = _pretok(spark, sf_dir)
    return p.select("doc_id", F.posexplode(chunking.spans(F.col("sizes"))).alias("chunk", "s")).select("doc_id", "chunk", "s.start", "s.end")


WORDS_SQL = r"""
words as (select doc_id, list_transform(list_filter(regexp_split_to_array(text, '[ \n\r\t]+'), lambda w: w <> ''), lambda w: (('0x' || substr(md5(w), 1, 8))::bigint % 50000 + 3)::int) t from documents)"""
COMPOSED_SQL = f"""{CHUNK_SQL}, {WORDS_SQL},
sp as (select doc_id, k, sum(n) over (partition by doc_id order by k) - n st, n from (select doc_id, unnest(sizes) n, generate_subscripts(sizes, 1) k from chunks)),
ch as (select doc_id, k, list_concat([1], t[st + 1 : st + n], [2]) ids from sp join words using (doc_id))"""


def _chunked(spark, sf_dir):
    p = _pretok(spark, sf_dir, tokenise.word_ids(F.col("text")).alias("tokens"))  # sizes and tokens in one pass
    checked = p.withColumn("sizes", pretok.checked_sizes(F.col("sizes"), F.col("tokens"), LIMIT))
    return checked.select("doc_id", "source", pretok.chunked(F.col("tokens"), F.col("sizes"), 1, 2).alias("chunks"))


@query(f"with {COMPOSED_SQL} select doc_id, (k - 1)::int chunk, array_to_string(ids, ' ') ids from ch")
def chunked_tokens(spark, sf_dir):
    c = _chunked(spark, sf_dir)
    return c.select("doc_id", F.posexplode("chunks").alias("chunk", "i")).select("doc_id", "chunk", F.array_join("i", " ").alias("ids"))


@query(f"""
with {CHUNK_SQL} select source, coalesce(sum(list_sum(sizes)), 0)::bigint total_tokens, max(coalesce(list_sum(sizes), 0))::bigint max_tokens,
  sum(len(sizes))::bigint total_chunks, max(len(sizes))::bigint max_chunks, count(*) processed_docs from chunks group by 1
""")
def pretok_stats(spark, sf_dir):
    return pretok.strategy_stats(_pretok(spark, sf_dir))


@query(f"""
with {CHUNK_SQL}, m as (select unnest(range(1, 101))::int multiplier)
select source, multiplier, sum((len(sizes) + multiplier - 1) // multiplier)::bigint precomputed_length from chunks, m where len(sizes) > 0 group by all
""")
def length_table(spark, sf_dir):
    return pretok.length_table(_pretok(spark, sf_dir))


@query(f"""
with {CHUNK_SQL} select doc_id, source, row_number() over (partition by source order by doc_id) - 1 doc_key from chunks where list_sum(sizes) >= 20
""")
def filter_min_tokens(spark, sf_dir):
    return ingest.filtered_clone(_pretok(spark, sf_dir))[0].select("doc_id", "source", "doc_key")


@query(f"""
with {CHUNK_SQL} select source, sum(list_sum(sizes))::bigint total_tokens, max(list_sum(sizes))::bigint max_tokens,
  sum(len(sizes))::bigint total_chunks, max(len(sizes))::bigint max_chunks, count(*) processed_docs from chunks where list_sum(sizes) >= 20 group by 1
""")
def filter_clone_stats(spark, sf_dir):
    return ingest.filtered_clone(_pretok(spark, sf_dir))[1]


@query(f"""
with {CHUNK_SQL} select source, case when coalesce(list_sum(sizes), 0) = 0 then 'no tokens' when list_max(sizes) > 40 then 'a chunk is too large' end failure, count(*) n
from chunks group by all
""")
def pretokenise_batch(spark, sf_dir):
    """All sources in one job; what does not fit a strategy of 40 tokens a chunk is told apart, here counted with the rest."""
    rows = _pretok(spark, sf_dir, tokenise.word_ids(F.col("text")).alias("tokens"))
    strategy = {"chunk_size": 40, "returns": ["tokens", "chunks"], "required_databases": ["doc_id"]}
    judged = pretok.judged(rows, strategy, F.col("tokens"), F.col("sizes"))
    return judged.groupBy("source", "failure").agg(F.count("*").alias("n"))


@query(f"""
with {CHUNK_SQL}, c as (select len(sizes) k, coalesce(list_sum(sizes), 0) t from chunks)
select count(*) documents, sum(k)::bigint chunks, sum(t)::bigint tokens, (sum(k) // greatest(count(*), 1))::bigint mean_chunks,
  {", ".join(f"sum((k + {j} - 1) // {j})::bigint length_{j}" for j in range(1, 9))} from c
""")
def merged_totals(spark, sf_dir):
    p = _pretok(spark, sf_dir)
    return pretok.merged_corpora([p.where("source < 'src2'"), p.where("source >= 'src2'")], 512)[1]


# --- iteration --------------------------------------------------------------

VIEW_CHUNKS_SQL = f"{INDEX_SQL}, {CHUNK_SQL}, vc as (select vw.doc_id, pos, len(sizes) k from vw join chunks using (doc_id))"


def _view_chunks(spark, sf_dir):
    pos = _view(spark, sf_dir).select("doc_id", "pos")
    return pos.join(_pretok(spark, sf_dir), "doc_id")


@query(f"""
with {INDEX_SQL}, {COMPOSED_SQL}, q as (select doc_id, (k - 1) // 4 step, flatten(list(ids order by k))[1:256] ids from ch group by all)
select pos, step::int step, array_to_string(ids, ' ') ids from q join vw using (doc_id)
""")
def seq_chunks_m(spark, sf_dir):
    """Four chunks a sequence, in the order of the shuffled view."""
    v = _view(spark, sf_dir).select("doc_id", "pos").join(_chunked(spark, sf_dir), "doc_id")
    return iterate.sequences(v, "chunks", iterate.multiplier(256, 64), 256).select("pos", "step", F.array_join("ids", " ").alias("ids"))


@query(f"with {INDEX_SQL} select doc_id, pos, (pos % 4)::bigint as rank from vw")
def rank_shard(spark, sf_dir):
    return _view(spark, sf_dir).select("doc_id", "pos", iterate.rank_of(F.col("pos"), 4).alias("rank"))


@query(f"with {VIEW_CHUNKS_SQL} select pos % 840 worker_id, sum((k + 1) // 2)::bigint chunk_count from vc group by 1")
def shard_lengths_840(spark, sf_dir):
    return iterate.shard_counts(_view_chunks(spark, sf_dir), F.size("sizes"), 2)


@query(f"with {VIEW_CHUNKS_SQL} select pos % 4 as rank, sum((k + 1) // 2)::bigint chunk_count from vc group by 1")
def rebucket_lengths(spark, sf_dir):
    return iterate.rebucketed(iterate.shard_counts(_view_chunks(spark, sf_dir), F.size("sizes"), 2), 4)


@query(f"""
with {VIEW_CHUNKS_SQL}, c as (select pos % 4 as rank, sum((k + 1) // 2)::bigint n from vc group by 1)
select rank, unnest(range(n, (select max(n) from c)))::bigint as "at", true worker_has_finished from c
""")
def finished_filler(spark, sf_dir):
    counts = iterate.rebucketed(iterate.shard_counts(_view_chunks(spark, sf_dir), F.size("sizes"), 2), 4)
    return iterate.fillers(counts).drop("ids")


@query(f"with {VIEW_CHUNKS_SQL} select max(n)::bigint steps from (select pos % 8 r, sum(k) n from vc group by 1)")
def steps_before_training(spark, sf_dir):
    return iterate.longest(iterate.rebucketed(iterate.shard_counts(_view_chunks(spark, sf_dir), F.size("sizes"), 1), 8))


@query(f"""
with {VIEW_CHUNKS_SQL}, q as (select doc_id, pos, unnest(range((k + 1) // 2))::int step from vc)
select pos, step from q where pos > 50 or (pos = 50 and step >= 1)
""")
def resume_at(spark, sf_dir):
    v = _view_chunks(spark, sf_dir).withColumn("chunks", F.transform("sizes", lambda n: F.array(n)))
    return iterate.resumed(iterate.sequences(v, "chunks", 2), 50, 1).select("pos", "step")


@query(f"""
with {VIEW_CHUNKS_SQL}, r as (select pos % 4 as rank, count(*) d, sum((k + 3) // 4) s from vc group by 1)
select sum(d)::bigint documents, sum(s)::bigint sequences, max(s)::bigint per_rank, (max(s) * 4)::bigint given_out from r
""")
def iteration_lengths(spark, sf_dir):
    return iterate.lengths(_view_chunks(spark, sf_dir), F.size("sizes"), 4, 4)


@query(f"""
with {VIEW_CHUNKS_SQL}, q as (select doc_id, pos, unnest(range((k + 1) // 2))::int step from vc), n as (select *, row_number() over (order by pos, step) - 1 i from q)
select pos, step, i from n where i % 4 = 1
""")
def sample_rank_skip(spark, sf_dir):
    """Samples, not documents, dealt out in turn: those of rank 1 of 4."""
    v = _view_chunks(spark, sf_dir).withColumn("chunks", F.transform("sizes", lambda n: F.array(n)))
    numbered = iterate.sample_numbers(iterate.sequences(v, "chunks", 2).select("pos", "step"))
    return numbered.where(iterate.rank_of(F.col("i"), 4) == 1).select("pos", "step", "i")


@query(f"""
with {VIEW_CHUNKS_SQL}, q as (select doc_id, pos, unnest(range((k + 3) // 4))::int step from vc)
select pos, step, lang, n_chars from q join documents using (doc_id)
""")
def sequence_metadata(spark, sf_dir):
    v = _view_chunks(spark, sf_dir).withColumn("chunks", F.transform("sizes", lambda n: F.array(n)))
    rows = iterate.sequences(v, "chunks", 4).select("doc_id", "pos", "step")
    return iterate.with_metadata(rows, table(spark, sf_dir, "documents"), ["lang", "n_chars"]).drop("doc_id")


@query("""
with b as (select doc_id, octet_length(encode(text))::bigint n from documents)
select doc_id, g::int "group", least(100, n - g * 100)::int n from (select *, unnest(range((n + 99) // 100)) g from b)
""")
def byte_groups(spark, sf_dir):
    rows = iterate.unit_groups(_docs(spark, sf_dir, F.col("text").cast("binary").alias("b")), "b", 100)
    return rows.select("doc_id", "group", F.size(tokenise.utf8_bytes(F.col("b"))).alias("n"))


@query()
def recurrence_schedule(spark, sf_dir):
    return iterate.recurrence_schedule(_view_chunks(spark, sf_dir), F.ceil(F.size("sizes") / 2), width=4, world=4)


# --- batches ----------------------------------------------------------------

@query(f"with {WORDS_SQL} select doc_id, array_to_string(list_resize(t[1:16], 16, 0), ' ') ids, (16 - len(t[1:16]))::bigint n_pad from words")
def pad_batch(spark, sf_dir):
    x = batch.padded(tokenise.word_ids(F.col("text")), 16, 0)
    return _docs(spark, sf_dir, x.alias("x")).select("doc_id", F.array_join("x", " ").alias("ids"), F.size(F.filter(batch.pad_mask(F.col("x"), 0), lambda m: m)).cast("long").alias("n_pad"))


@query(f"""
with {WORDS_SQL}, r as (select doc_id, doc_id // 8 batch, t[1:16] x from words),
i as (select *, row_number() over (partition by batch order by doc_id) - 1 k from r)
select batch, array_to_string(flatten(list(x order by doc_id)), ' ') flat,
  array_to_string(list_transform(range(count(*) + 1), lambda j: coalesce(list_sum(list(len(x) order by doc_id)[1:j]), 0)::int), ' ') cu_seqlens,
  array_to_string(flatten(list(list_transform(range(len(x)), lambda j: (k * 16 + j)::int) order by doc_id)), ' ') indices, max(len(x))::int max_seq_len
from i group by batch
""")
def unpad_cu_seqlens(spark, sf_dir):
    rows = _docs(spark, sf_dir, tokenise.word_ids(F.col("text")).alias("ids"))
    b = batch.unpadded(rows, "doc_id", "ids", 8, 16)
    return b.select("batch", *[F.array_join(c, " ").alias(c) for c in ("flat", "cu_seqlens", "indices")], "max_seq_len")


@query(f"with {WORDS_SQL} select doc_id, array_to_string(t[1:len(t) - 1], ' ') inputs, array_to_string(t[2:], ' ') targets from words")
def lm_shift(spark, sf_dir):
    d = _docs(spark, sf_dir, tokenise.word_ids(F.col("text")).alias("ids"))
    x, y = batch.inputs_targets(F.col("ids"))
    return d.select("doc_id", F.array_join(x, " ").alias("inputs"), F.array_join(y, " ").alias("targets"))


@query(r"""
with w as (select doc_id, list_filter(regexp_split_to_array(text, '[ \n\r\t]+'), lambda w: w <> '') w from documents)
select doc_id, array_to_string(flatten(list_transform(w, lambda x: list_concat([length(x) % 5], list_transform(range((length(x) + 2) // 3 - 1), lambda j: -100)))), ' ') labels from w
""")
def class_pad_align(spark, sf_dir):
    """Words cut into pieces of three letters; the first piece keeps the word's label."""
    words = F.filter(F.split("text", r"[ \n\r\t]+"), lambda w: w != "")
    d = _docs(spark, sf_dir, words.alias("w"))
    pieces = F.transform("w", lambda x: F.ceil(F.length(x) / 3).cast("int"))
    return d.select("doc_id", F.array_join(labels.aligned(pieces, F.transform("w", lambda x: F.length(x) % 5)), " ").alias("labels"))


@query(f"""
with {WORDS_SQL} select doc_id, array_to_string(list_resize(t[1:32], 32, 0), ' ') ids,
  array_to_string(list_resize(list_transform(t[1:32], lambda x: x % 7), 32, -100), ' ') labels, len(t[1:32])::bigint n_attended from words
""")
def classification_batch(spark, sf_dir):
    """A labelled token sequence as model input: cut, padded, labels ignored where padded."""
    d = _docs(spark, sf_dir, tokenise.word_ids(F.col("text")).alias("ids")).withColumn("labels", F.transform("ids", lambda x: x % 7))
    rows = labels.batch_rows(labels.truncation(d, "ids", 32, "labels")[0], "ids", "labels", 32, 0)
    attended = F.size(F.filter("attention", lambda m: m)).cast("long")
    return rows.select("doc_id", F.array_join("ids", " ").alias("ids"), F.array_join("labels", " ").alias("labels"), attended.alias("n_attended"))


@query(f"with {WORDS_SQL} select count(*) filter (len(t) > 32) truncated from words")
def truncation_count(spark, sf_dir):
    return labels.truncation(_docs(spark, sf_dir, tokenise.word_ids(F.col("text")).alias("ids")), "ids", 32)[1]


@query("select distinct event_type as label from events where event_type is not null")
def unique_labels(spark, sf_dir):
    return labels.unique(table(spark, sf_dir, "events"), "event_type")


_SAMPLER = ", ".join(str((p.n, p.b, p.inverse)) for p in (Permutation.draw(n, 5) for n in (200, 1000, 10_000)))


@query(f"""
with p(n, b, i) as (values {_SAMPLER}), d as (
  select doc_id, (((p.i * (doc_id - p.b)) % p.n + p.n) % p.n)::bigint pos, p.n from documents, p where p.n = (select count(*) from documents)),
r as (select doc_id, pos from d union all select doc_id, pos + n from d)
select doc_id, pos // 3 as "at" from r where pos % 3 = 1 and pos < ((select any_value(n) from d) + 2) // 3 * 3
""")
def sampler_rank(spark, sf_dir):
    """What rank 1 of 3 reads in epoch 2; the ranks are filled up from the beginning."""
    d = _docs(spark, sf_dir)
    return labels.sampled(d, "doc_id", d.count(), 1, 3, epoch=2, seed=3).select("doc_id", "at")


# --- masking ----------------------------------------------------------------

def _u(*parts: str) -> str:
    key = " || ':' || ".join(parts)
    return f"(('0x' || substr(md5({key}), 1, 8))::bigint / 4294967296.0)"


def _mask_sql(rate: str, cloze: float, random: float) -> str:
    draw = lambda at: f"(('0x' || substr(h, {at}, 8))::bigint / 4294967296.0)"
    # Ids 0 and 4 are the padding and the mask: a random id is neither.
    drawn = f"floor({draw(17)} * 50001)::int"
    moved = f"(case when {drawn} + 1 >= 4 then {drawn} + 2 else {drawn} + 1 end)"
    return f"""
with {WORDS_SQL}, x as (select doc_id, unnest(t) id, generate_subscripts(t, 1) - 1 i from words),
y as (select *, md5('42:' || doc_id::varchar || ':' || i::varchar) h from x),
k as (select *, case when {draw(1)} >= {rate} then 0 when {draw(9)} < {cloze} then 1 when {draw(9)} < {cloze + random} then 2 else 3 end kind from y)
select doc_id, array_to_string(list(case kind when 1 then 4 when 2 then {moved} else id end order by i), ' ') masked,
  count(*) filter (kind > 0) n_masked, count(*) filter (kind = 2) n_random from k group by 1
union all select doc_id, '', 0, 0 from words where len(t) = 0"""


def _masked(spark, sf_dir, rate, **shares):
    d = _docs(spark, sf_dir, tokenise.word_ids(F.col("text")).alias("ids"))
    m = d.select("doc_id", masking.masked(F.col("ids"), F.col("doc_id"), 42, rate, 4, 0, 50_003, **shares).alias("m"))
    kind = lambda test: F.size(F.filter("m.kinds", test)).cast("long")
    return m.select("doc_id", F.array_join("m.masked", " ").alias("masked"), kind(lambda k: k > 0).alias("n_masked"), kind(lambda k: k == 2).alias("n_random"))


@query(_mask_sql("0.15", 1.0, 0.0))
def mask_tokens(spark, sf_dir):
    return _masked(spark, sf_dir, F.lit(0.15))


@query(_mask_sql("0.5", 0.8, 0.1))
def mask_mix_80_10_10(spark, sf_dir):
    return _masked(spark, sf_dir, F.lit(0.5), cloze=0.8, random=0.1, same=0.1)


@query(_mask_sql(f"(0.1 + (0.3 - 0.1) * {_u(chr(39) + '42' + chr(39), chr(39) + 'rate' + chr(39), 'doc_id::varchar')})", 1.0, 0.0))
def mask_rate_range(spark, sf_dir):
    return _masked(spark, sf_dir, masking.rate_between(0.1, 0.3, 42, F.col("doc_id")))


# --- labels -----------------------------------------------------------------

@query("select quality, count(*) n from labels group by 1")
def label_distribution(spark, sf_dir):
    return labels.distribution(table(spark, sf_dir, "labels"), "quality")


@query("""
with c as (select i::int as class, coalesce(n, 1) n from range(3) r(i) left join (select quality q, count(*) n from labels group by 1) on q = i)
select class, (1.0 / n) * 3 / sum(1.0 / n) over () weight from c
""")
def class_weights(spark, sf_dir):
    return labels.class_weights(table(spark, sf_dir, "labels"), "quality", 3)


@query("select doc_id, case lang when 'de' then 0 when 'en' then 1 when 'es' then 2 when 'fr' then 3 end::int label_id, quality from documents join labels using (doc_id) where text is not null and quality is not null")
def label_join_dropna(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    kept, _ = labels.complete(d, ["text", "quality"])
    return labels.mapped(kept, "lang", {"de": 0, "en": 1, "es": 2, "fr": 3}).select("doc_id", "label_id", "quality")


@query("select distinct event_type as label from events where event_type not in ('click', 'view')")
def unseen_labels(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("label"))
    known = spark.createDataFrame([("click",), ("view",)], "label string")
    return labels.unseen(e, "label", known)


# --- numbers ----------------------------------------------------------------

SERIES_SQL = "s as (select vec_id, list_transform(embedding, lambda x: round(x::double, 4)) h from embeddings)"


def _series(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("h"))


@query(f"with {SERIES_SQL} select vec_id, array_to_string(list_filter(range(len(h)), lambda i: i > 0 and h[i + 1] > h[i] + 0.1), ' ') cuts from s")
def entropy_cuts(spark, sf_dir):
    cut = chunking.entropy_cuts(F.col("h"), 0.1)
    places = F.filter(F.transform(cut, lambda c, i: F.when(c, i)), lambda i: i.isNotNull())
    return _series(spark, sf_dir).select("vec_id", F.array_join(places, " ").alias("cuts"))


@query(f"with {SERIES_SQL} select vec_id, array_to_string(list_transform(range(len(h)), lambda j: len(list_filter(range(j + 1), lambda i: i > 0 and h[i + 1] > h[i] + 0.1))), ' ') patches from s")
def entropy_groups(spark, sf_dir):
    return _series(spark, sf_dir).select("vec_id", F.array_join(chunking.entropy_groups(F.col("h"), 0.1), " ").alias("patches"))


@query(f"""
with {SENTENCE_SQL} select doc_id, coalesce(array_to_string(flatten(list_transform(s, lambda x: list_transform(range((length(x) + 15) // 16), lambda k: substr(x, 16 * k + 1, 16)))), '|'), '') pieces from sent
""")
def cut_text(spark, sf_dir):
    """Whole texts, cut at sentences and no piece longer than 16 characters."""
    lens = F.transform(chunking.sentences(F.col("text")), lambda s: F.length(s))
    d = _docs(spark, sf_dir, "text", chunking.spans(lens).alias("spans"))
    return d.select("doc_id", F.array_join(chunking.cut_text(F.col("text"), F.col("spans"), 16), "|").alias("pieces"))


@query("""
with x as (select label, unnest(embedding)::double x from embeddings),
m as (select label, avg(x) mean, var_pop(x) var, stddev_pop(x) std, count(x) n from x group by 1)
select m.label, round(any_value(mean), 6) mean, round(any_value(var), 6) var, round(any_value(std), 6) std, any_value(n) n,
  round(avg(pow((x - mean) / std, 3)), 6) skewness, round(avg(pow((x - mean) / std, 4)) - 3, 6) kurtosis from x join m using (label) group by 1
""")
def array_moments(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("v")).select("label", F.col("v").cast("double").alias("x"))
    m = metrics.moments(x, "x", ["label"])
    return m.select("label", *[F.round(c, 6).alias(c) for c in ("mean", "var", "std", "skewness", "kurtosis")], "n")


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) norm from embeddings")
def frobenius(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(metrics.frobenius(F.col("embedding")), 6).alias("norm"))


@query()
def spectral_stats(spark, sf_dir):
    return metrics.spectral(table(spark, sf_dir, "embeddings"), "embedding", 64)


@query("select event_type, round(sum(abs(value) * 4) / (ln(2.0) * sum(length(props))), 8) bpb from events group by 1")
def bits_per_byte(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.round(metrics.bits_per_byte(F.abs("value"), F.lit(4), F.length("props")), 8).alias("bpb"))


@query("""
with g as (select quality t, case when n_chars > 300 then 1 else 0 end p from documents join labels using (doc_id)),
c as (select unnest([0, 1])::int as class)
select class, round(2.0 * count(*) filter (t = class and p = class) / greatest(count(*) filter (p = class) + count(*) filter (t = class), 1), 8) f1 from g, c group by 1
""")
def f1_by_class(spark, sf_dir):
    g = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    g = g.select(F.col("quality").alias("t"), F.when(F.col("n_chars") > 300, 1).otherwise(0).alias("p"))
    return metrics.f1_scores(g, "p", "t").select("class", F.round("f1", 8).alias("f1"))


@query("""
with g as (select quality t, case when n_chars > 300 then 1 else 0 end p from documents join labels using (doc_id)),
c as (select unnest([0, 1])::int as class),
f as (select class, 2.0 * count(*) filter (t = class and p = class) / greatest(count(*) filter (p = class) + count(*) filter (t = class), 1) f1 from g, c group by 1)
select round(avg(f1), 8) macro_f1 from f
""")
def f1_macro(spark, sf_dir):
    g = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    g = g.select(F.col("quality").alias("t"), F.when(F.col("n_chars") > 300, 1).otherwise(0).alias("p"))
    return metrics.macro_f1(g, "p", "t").select(F.round("macro_f1", 8).alias("macro_f1"))


@query("""
select l_returnflag flag, round(avg(case when y then 2.5 * ln(1 + exp(-z)) else ln(1 + exp(z)) end), 8) bce, round(avg(pow(l_tax - l_discount, 2)), 8) mse, round(avg(abs(l_tax - l_discount)), 8) mae
from (select *, (l_quantity - 25) / 10 z, l_linenumber % 2 = 1 y from lineitem) group by 1
""")
def loss_means(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("z", (F.col("l_quantity") - 25) / 10).withColumn("y", F.col("l_linenumber") % 2)
    return rows.groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.round(metrics.binary_cross_entropy(F.col("z"), F.col("y"), F.lit(True), 2.5), 8).alias("bce"),
        F.round(metrics.squared_error(F.col("l_tax"), F.col("l_discount")), 8).alias("mse"),
        F.round(metrics.absolute_error(F.col("l_tax"), F.col("l_discount")), 8).alias("mae"),
    )


@query(f"""
with {WORDS_SQL} select doc_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(
  list_filter(range(1, len(t) - 1), lambda k: t[k] = t[len(t) - 1] and t[k + 1] = t[len(t)]), lambda k: t[k + 2]))), ' '), '') banned from words
""")
def ngram_ban(spark, sf_dir):
    """Tokens that would end a trigram a second time."""
    d = _docs(spark, sf_dir, tokenise.word_ids(F.col("text")).alias("ids"))
    return d.select("doc_id", F.array_join(metrics.banned_next(F.col("ids"), 3), " ").alias("banned"))


@query(f"""
with {WORDS_SQL}, x as (select doc_id, unnest(t) id, generate_subscripts(t, 1) - 1 i from words),
c as (select doc_id, i // 64 k, avg((id % 3 = 0)::int) a, count(*) n from x group by all)
select doc_id, count(*) chunks, sum(n)::bigint tokens, round(avg(a), 8) mean_accuracy, arg_max(k, (a, -k))::bigint best, arg_min(k, (a, k))::bigint worst from c group by 1
""")
def chunk_accuracy(spark, sf_dir):
    d = _docs(spark, sf_dir, F.posexplode(tokenise.word_ids(F.col("text"))).alias("i", "id")).withColumn("hit", F.col("id") % 3 == 0)
    return metrics.chunk_report(d, "doc_id", "i", "hit", 64)[1].withColumn("mean_accuracy", F.round("mean_accuracy", 8))


@query("""
with s as (select unnest(range(0, 1001, 50))::bigint step),
p as (select step, least(greatest(step - 150, 0) / 850.0, 1.0) p from s)
select step, round(case when step < 50 then step / 50.0 when step < 150 then 1.0 else 0.1 + 0.9 * 0.5 * (1 + cos(pi() * p)) end, 8) factor from p
""")
def lr_schedule(spark, sf_dir):
    return spark.range(0, 1001, 50).select(F.col("id").alias("step"), F.round(metrics.learning_rate(F.col("id"), 1000, 0.05, 0.1, 0.1), 8).alias("factor"))


@query("""
with r as (select l_orderkey g, l_linenumber tok, l_discount * 20 lg from lineitem),
k as (select *, row_number() over (partition by g order by lg desc, tok) rk from r),
e as (select *, exp(lg - max(lg) over (partition by g)) e from k where rk <= 4),
p as (select *, coalesce(sum(e) over (partition by g order by lg desc, tok rows between unbounded preceding and 1 preceding), 0) / sum(e) over (partition by g) before from e)
select g, tok from p where before <= 0.9
""")
def logits_top_k_top_p(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("tok"), (F.col("l_discount") * 20).alias("lg"))
    return metrics.filtered_logits(rows, ["g"], "tok", "lg", top_k=4, top_p=0.9).select("g", "tok")


@query("select * from (values (1, 'a'), (1, 'b'), (2, 'a'), (2, 'b')) t(depth, kind)")
def grid_expansion(spark, sf_dir):
    return metrics.grid(spark, {"depth": [1, 2], "kind": ["a", "b"]})


@query("""
with n as (select doc_id, n_chars::bigint * n_chars n from documents)
select doc_id, case when n < 1024 then printf('%.2f B', n::double) when n < 1048576 then printf('%.2f KB', n / 1024.0) when n < 1073741824 then printf('%.2f MB', n / 1048576.0)
  else printf('%.2f GB', n / 1073741824.0) end size from n
""")
def size_texts(spark, sf_dir):
    d = _docs(spark, sf_dir, (F.col("n_chars") * F.col("n_chars")).alias("n"))
    return d.select("doc_id", metrics.size_text(F.col("n")).alias("size"))


# --- export -----------------------------------------------------------------

@query(f"""
with {INDEX_SQL} select vw.pos, vw.source as "group", vw.text as data, json_object('lang', d.lang, 'n_chars', d.n_chars)::varchar meta
from vw join documents d using (doc_id)
""")
def export_jsonl(spark, sf_dir):
    """A view as JSON lines with metadata, read back."""
    from ..sources import sinks

    meta = F.struct("lang", "n_chars").alias("meta")
    rows = _view(spark, sf_dir).select("doc_id", "pos", F.col("source").alias("group")).join(_docs(spark, sf_dir, F.col("text").alias("data"), meta), "doc_id")
    lines = sinks.json_lines(rows.select("pos", "group", "data", "meta"))
    back = F.from_json("value", "pos long, `group` string, data string, meta string")
    return lines.select(back.alias("r")).select("r.*")


@query("select conv_id, count(*) n_turns, string_agg(role || ': ' || text, chr(10) order by turn) as text from conversations group by 1")
def conversation_docs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("t"))))
    g = c.groupBy("conv_id").agg(F.count("*").alias("n_turns"), turns.alias("turns"))  # bounded by one conversation
    return g.select("conv_id", "n_turns", F.array_join(F.transform("turns", lambda t: t["t"]), "\n").alias("text"))
