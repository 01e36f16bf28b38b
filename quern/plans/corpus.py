"""Queries over ingestion, catalogue and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, ingest, store, views
from ..operators.permute import Permutation
from .registry import query, table

#: Draws for the table sizes the twins are run on; Spark draws for whatever size it finds.
PERMUTATIONS = ", ".join(str((p.n, p.a, p.b, p.inverse)) for p in map(Permutation.draw, (200, 1000, 10_000)))

#: The same for the sizes a single source may have there.
SOURCE_PERMUTATIONS = ", ".join(str((p.n, p.b, p.inverse)) for p in map(Permutation.draw, range(1, 1501)))

LINES_SQL = """
lines as (
  select doc_id, source, lang, text,
    case when source = 'src3' then json_object('doc_id', doc_id, 'lang', lang) else json_object('doc_id', doc_id, 'lang', lang, 'more', json_object('chars', n_chars)) end meta,
    case when source = 'src11' then 'generatorReturnedNone' when source = 'src7' then 'missingDataKey'
      when octet_length(encode(text)) <= 10 then 'data<=10' end reason
  from documents)"""

INDEX_SQL = f"""
src as (select source, (row_number() over (order by source))::int source_id, count(*) n from documents group by source),
off as (select *, coalesce(sum(n) over (order by source_id rows between unbounded preceding and 1 preceding), 0)::bigint o from src),
idx as (
  select d.doc_id, d.text, d.source, source_id, row_number() over (partition by d.source order by doc_id) - 1 doc_key,
    o + row_number() over (partition by d.source order by doc_id) - 1 g
  from documents d join off using (source)),
perm(n, a, b, i) as (values {PERMUTATIONS}),
vw as (
  select idx.*, (((perm.i * (g - perm.b)) % perm.n + perm.n) % perm.n)::bigint pos
  from idx, perm where perm.n = (select count(*) from documents)),
ranked as (
  select *, row_number() over (partition by source order by pos) - 1 r, count(*) over (partition by source) cnt,
    coalesce(sum(octet_length(encode(text))) over (partition by source order by pos rows between unbounded preceding and 1 preceding), 0) before
  from vw)"""


def lines(spark, sf_dir):
    """The documents as JSON lines, as different sources would write them: src3 under another key,
    src7 without the text, src11 cut off."""
    d = table(spark, sf_dir, "documents")
    other = F.when(F.col("source") == "src3", F.struct(F.col("text").alias("raw_content"), "lang", "doc_id"))
    plain = F.to_json(F.struct("text", "lang", "doc_id", F.struct(F.col("n_chars").alias("chars")).alias("more")))
    line = (
        F.when(F.col("source") == "src3", F.to_json(other))
        .when(F.col("source") == "src7", F.to_json(F.struct("lang", "doc_id")))
        .when(F.col("source") == "src11", F.concat(F.lit('{"text": "'), F.col("lang")))
        .otherwise(plain)
    )
    return d.select("doc_id", "source", line.alias("value"))


@query(f"with {LINES_SQL} select doc_id, source, row_number() over (partition by source order by doc_id) - 1 doc_key, octet_length(encode(text))::bigint n_bytes, meta::varchar meta from lines where reason is null")
def ingest_accepted(spark, sf_dir):
    rows = ingest.accepted(ingest.parsed(lines(spark, sf_dir)))
    slim = rows.select("doc_id", "source", ingest.size_bytes(F.col("data")).alias("n_bytes"), "meta")
    # At most as many rows as documents: that decides how they are numbered.
    return ingest.with_dense_ids(slim, "doc_id", n=table(spark, sf_dir, "documents").count()).select("doc_id", "source", "doc_key", "n_bytes", "meta")


@query(f"with {LINES_SQL} select source, reason, count(*) n from lines where reason is not null group by all")
def ingest_rejects(spark, sf_dir):
    return ingest.reject_counts(ingest.parsed(lines(spark, sf_dir)), ["source"])


@query(f"""
with {LINES_SQL}
select source, count(*) document_number, sum(octet_length(encode(text)))::bigint data_bytes, sum(octet_length(encode(meta::varchar)))::bigint meta_bytes
from lines where reason is null group by 1
""")
def source_stats(spark, sf_dir):
    return ingest.source_stats(ingest.accepted(ingest.parsed(lines(spark, sf_dir))))


@query(f"""
with {LINES_SQL}, c as (select source, count(*) filter (reason = 'data<=10') d, count(*) filter (reason = 'generatorReturnedNone') g,
  count(*) filter (reason = 'missingDataKey') m from lines group by 1)
select source, json_object('data<=10', d, 'generatorReturnedNone', g, 'hasDataError', 0, 'missingDataKey', m)::varchar counters from c
""")
def ingest_reject_report(spark, sf_dir):
    return ingest.reject_report(ingest.parsed(lines(spark, sf_dir)), ["source"])


@query(f"with {LINES_SQL} select source, 'preserved' flag, count(*) document_number, sum(octet_length(encode(text)))::bigint bytes from lines where reason is null group by 1")
def default_view(spark, sf_dir):
    return ingest.default_view(ingest.source_stats(ingest.accepted(ingest.parsed(lines(spark, sf_dir)))))


@query(f"with {INDEX_SQL} select doc_id, source, source_id, doc_key, g, pos from vw")
def perm_pos(spark, sf_dir):
    return _view(spark, sf_dir).drop("n_bytes")


def _index(spark, sf_dir):
    """(doc_id, source, n_bytes, source_id, doc_key, g), the sources as a list, and the number of rows: texts are read for their sizes only."""
    docs = table(spark, sf_dir, "documents")
    rows = views.source_rows(docs)
    sources = spark.createDataFrame(rows, "source string, source_id int, n long, offset long")
    n = sum(r[2] for r in rows)
    return views.indexed(docs.select("doc_id", "source", ingest.size_bytes(F.col("text")).alias("n_bytes")), sources, n=n), rows, n


def _view(spark, sf_dir):
    index, _, n = _index(spark, sf_dir)
    return views.shuffled(index, n)


@query(f"with {INDEX_SQL} select source_id, doc_key, pos from vw")
def shuffle_full(spark, sf_dir):
    return views.materialised(_view(spark, sf_dir).select("source_id", "doc_key", "pos"), 8)


@query(f"with {INDEX_SQL} select g, source, source_id, doc_key from idx")
def locate_global_index(spark, sf_dir):
    index, rows, _ = _index(spark, sf_dir)
    return views.located(index.select("g"), rows)


@query(f"with {INDEX_SQL} select doc_id, doc_key from idx where source = 'src2' and doc_key = 3")
def point_lookup(spark, sf_dir):
    return views.document(_index(spark, sf_dir)[0], "src2", 3).select("doc_id", "doc_key")


@query(f"with {INDEX_SQL} select doc_id, g as pos from idx")
def sequential_read(spark, sf_dir):
    return views.sequential(_index(spark, sf_dir)[0]).select("doc_id", "pos")


@query(f"with {INDEX_SQL} select doc_id, doc_key as \"at\" from idx where source = 'src4'")
def source_scan(spark, sf_dir):
    return views.source_scan(_index(spark, sf_dir)[0], "src4").select("doc_id", "at")


@query(f"""
with {INDEX_SQL}, own as (select * from idx where source = 'src4'), p(n, b, i) as (values {SOURCE_PERMUTATIONS})
select doc_id, (((p.i * (doc_key - p.b)) % p.n + p.n) % p.n)::bigint "at" from own, p where p.n = (select count(*) from own)
""")
def source_scan_permuted(spark, sf_dir):
    index, rows, _ = _index(spark, sf_dir)
    return views.source_scan(index, "src4", next((r[2] for r in rows if r[0] == "src4"), 0), seed=27).select("doc_id", "at")


@query(f"with {INDEX_SQL} select doc_id, source, pos from ranked where r < 7")
def view_by_count(spark, sf_dir):
    index, _, n = _index(spark, sf_dir)
    return views.first_of_each(views.shuffled(index, n), F.lit(7), n=n).select("doc_id", "source", "pos")


@query(f"with {INDEX_SQL} select doc_id, source, pos from ranked where r < floor(cnt * 0.3)")
def view_by_fraction(spark, sf_dir):
    index, rows, n = _index(spark, sf_dir)
    names = [r[0] for r in rows]
    return views.select(views.shuffled(index, n), {x: 0.3 for x in names}, names, n=n).select("doc_id", "source", "pos")


@query(f"with {INDEX_SQL} select source, count(*) document_number, sum(octet_length(encode(text)))::bigint bytes from ranked where before < 20000 group by 1")
def view_by_bytes(spark, sf_dir):
    """The first rows of each source, in shuffled order, that fill a byte budget."""
    index, _, n = _index(spark, sf_dir)
    size = F.col("n_bytes")
    return views.view_stats(views.first_of_each(views.shuffled(index, n), F.lit(20_000), size, n), size)


MIXED = {"src0": "preserved", "src1": "skipped", "src2": 5, "src3": 0.5, "src4": "8K"}


@query(f"""
with {INDEX_SQL}, kept as (
  select * from ranked where source = 'src0' or (source = 'src2' and r < 5) or (source = 'src3' and r < floor(cnt * 0.5))
    or (source = 'src4' and before < 8192) or (source not in ('src0', 'src1', 'src2', 'src3', 'src4') and r < 3))
select doc_id, source, row_number() over (order by pos) - 1 pos from kept
""")
def view_mixed(spark, sf_dir):
    index, rows, n = _index(spark, sf_dir)
    names = [r[0] for r in rows]
    kept = views.select(views.shuffled(index, n), {x: MIXED.get(x, 3) for x in names}, names, n=n)
    return views.compacted(kept, n).select("doc_id", "source", "pos")


@query(f"""
with {INDEX_SQL} select src.source, count(vw.source) document_number, count(vw.source) = 0 is_skipped
from src left join vw on src.source = vw.source and pos < 40 group by src.source
""")
def head_view(spark, sf_dir):
    index, rows, n = _index(spark, sf_dir)
    sources = spark.createDataFrame([(r[0],) for r in rows], "source string")
    return views.head_sources(views.head(views.shuffled(index, n), 40, n), sources, 40)


@query("select (row_number() over (order by source))::int source_no, source as name, count(*) document_number from documents group by source")
def sources_catalog(spark, sf_dir):
    return catalog.sources(table(spark, sf_dir, "documents"))


CATALOG_SQL = """
s as (select (row_number() over (order by source))::int source_no, source as name, count(*) document_number,
  sum(octet_length(encode(text)))::bigint data_bytes, sum(octet_length(encode(lang)))::bigint meta_bytes from documents group by source),
db as (
  select 2 * source_no - 1 database_id, source_no source_ref, data_bytes raw_data_bytes, true is_data, false is_meta, 'data' as type from s
  union all select 2 * source_no, source_no, meta_bytes, false, true, 'meta' from s)"""


@query(f"with {CATALOG_SQL} select source_ref, database_id, type, raw_data_bytes, is_data, is_meta from db")
def source_databases_join(spark, sf_dir):
    c = catalog.build(table(spark, sf_dir, "documents"))
    return catalog.source_databases(c)


@query(f"with {CATALOG_SQL} select source_no, name, document_number, raw_data_bytes from s left join db on source_no = source_ref where is_data")
def source_info_join(spark, sf_dir):
    return catalog.source_info(catalog.build(table(spark, sf_dir, "documents")))


@query(f"""
with {CATALOG_SQL}, v as (select *, case when source_no % 3 = 0 then 'skipped' when source_no % 3 = 1 then 'preserved' else 'partial' end flag,
  case when source_no % 3 = 2 then null else data_bytes end bytes_criteria from s)
select 'active' as criterion, sum(coalesce(document_number, 0))::bigint documents, sum(coalesce(bytes_criteria, 0))::bigint bytes from v where flag <> 'skipped'
union all select 'preserved', sum(coalesce(document_number, 0))::bigint, sum(coalesce(bytes_criteria, 0))::bigint from v where flag = 'preserved'
union all select 'all', sum(coalesce(document_number, 0))::bigint, sum(coalesce(bytes_criteria, 0))::bigint from v
""")
def view_totals(spark, sf_dir):
    c = catalog.build(table(spark, sf_dir, "documents"))
    return catalog.view_totals(catalog.thirds_view(c))


@query(f"""
with {CATALOG_SQL}
select strategy_name, source_no source_ref, 2 * source_no - 1 database_id, kind, type
from db join s on source_ref = source_no, (values ('bytes', 'tokens'), ('bytes', 'chunks')) k(strategy_name, kind) where is_data
""")
def strategy_db_join(spark, sf_dir):
    return catalog.strategy_databases(catalog.build(table(spark, sf_dir, "documents")))


@query("select event_id, user_id from events where not exists (select 1 from supplier where s_suppkey = user_id)")
def orphan_rows(spark, sf_dir):
    """A foreign key as a validation: events whose user is no supplier."""
    return catalog.orphans(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", table(spark, sf_dir, "supplier"), "s_suppkey")


@query("""
with l as (select o_orderkey k, o_orderstatus v, -1 as step from orders union all select l_orderkey, l_shipdate::varchar, l_linenumber from lineitem where l_quantity > 25)
select k, arg_max(v, step) v from l group by k
""")
def upsert_keep_last(spark, sf_dir):
    """New rows repeat their key: the one with the largest number stays."""
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    new = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(
        F.col("l_orderkey").alias("k"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("v"), F.col("l_linenumber").alias("step")
    )
    return catalog.upserted(old, new, ["k"], "step")


@query("""
with d as (select source, lang, count(*) n from documents group by all) select source, lang, n from d where source <> 'src5'
""")
def delete_cascade(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    gone = d.where("source = 'src5'").select("source").distinct()
    return catalog.deleted(d, gone, ["source"])


@query("""
with s as (select source, count(*) n from documents group by 1), t as (select sum(n)::bigint total from s),
e as (select source, (t.total * 7 * n // greatest(t.total, 1))::bigint est from s, t)
select source, m, (est + m - 1) // m chunks from e, (select unnest(range(1, 101)) m)
""")
def estimated_view_chunks(spark, sf_dir):
    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return catalog.estimated_chunks(s, chunks_per_doc=7)


def _registry(spark, sf_dir):
    """A registry of the documents' sources, one strategy and two views, in a folder of its own."""
    import uuid

    index, rows, n = _index(spark, sf_dir)
    r = catalog.Registry(spark, f"{store.shared_dir(spark)}/registry-{uuid.uuid4().hex}")
    sized = {x["source"]: x["b"] for x in index.groupBy("source").agg(F.sum("n_bytes").alias("b")).collect()}
    r.put("source", spark.createDataFrame([(k, name, "document", "text", count, sized[name], 0, "{}") for name, k, count, _ in rows], catalog.KINDS["source"].columns))
    r.register_strategy({"strategy_name": "by words", "tokenizer_type": "words", "splitter_class": "aligned", "chunk_size": 64, "modality": "document"})
    made = [("by_words", k, count * 10, 10, count, 1, count) for _, k, count, _ in rows]
    r.put("tokenised", spark.createDataFrame(made, catalog.KINDS["tokenised"].columns))
    v = views.shuffled(index, n)
    r.register_view("all", v, {name: "preserved" for name, *_ in rows})
    few = {name: "skipped" if k % 3 == 0 else 4 for name, k, *_ in rows}
    r.register_view("few", views.select(v, few, list(few), n=n), few)
    return r


@query(f"""
with {CATALOG_SQL}
select 'all' as "view", source_no, 'preserved' flag, document_number documents, data_bytes bytes from s where name <> 'src5'
""")
def registry_after_delete(spark, sf_dir):
    """A source is removed with all that refers to it."""
    r = _registry(spark, sf_dir)
    r.remove("source", name="src5")
    return r.find("view_source", view="all")


@query("""
with s as (select source, row_number() over (order by source) k, count(*) n from documents group by source)
select 'all' as "view", sum(n)::bigint documents from s union all select 'few', sum(least(n, 4))::bigint from s where k % 3 <> 0
""")
def registry_set_view(spark, sf_dir):
    r = _registry(spark, sf_dir)
    return spark.createDataFrame([(name, r.set_view(name)) for name in r.names("view")], "view string, documents long")
