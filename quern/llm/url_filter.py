"""URL filter: a blocked Bloom filter in front of an exact hash join.

The list holds canonical urls of single pages (host, path and the query's parameters
in order, without those that only track a visit), and rules, whose host stands for
all its subdomains and whose path for all paths that start with it.  A url asks for its own canonical key and for every (host suffix, path
prefix of a listed length) it has.  The filter lets through the keys that may be
listed; only those meet the list in an exact hash join, which removes false
positives, so the filter decides cost and never the result.

Scale: the filter is a fixed number of 256-bit blocks, never above
``max_filter_bytes`` however long the list is (a fuller filter passes more keys
on to the join); it is built by a partial-aggregated ``bit_or`` per block, and
only these blocks, at most ``max_filter_bytes``, reach the driver and are sent out.  Rules are broadcast up to
``max_rules``; the page list is never broadcast.  The key of the join is salted, as one
url may hold a large part of all rows.

Defined results: a null url, or one without ``://``, has empty host and path, fits no
rule and is allowed; repeated rows are judged one by one; an empty table or an
empty list gives verdicts by what remains; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, table

LANES = 8
#: Odd multipliers, one per 32-bit lane of a block.
MULTIPLIERS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


#: The rules of the registered query (host, path): the longest that fits wins.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def _lower_az(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return _lower_az(host), path


#: Parameters that name a visit and not a page.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|msclkid|mc_cid|mc_eid)(=|$)"


def canonical(url: Column) -> Column:
    """Host and path, and the query without tracking parameters, its parameters sorted."""
    host, path = host_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _block_and_masks(key_hash: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    low = key_hash.bitwiseAND(F.lit(0xFFFFFFFF))
    block = F.pmod(F.shiftrightunsigned(key_hash, 32), F.lit(n_blocks)).cast("int")
    # 32-bit products, taken in 64 bits: the top five bits name the lane's bit.
    product = lambda m: (low.bitwiseAND(F.lit(0xFFFF)) * F.lit(m) + F.shiftleft((F.shiftright(low, 16) * F.lit(m)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))
    return block, [F.shiftright(product(m), 27).cast("int") for m in MULTIPLIERS]


def build_filter(keys: DataFrame, n_keys: int, bits_per_key: int = 12, max_filter_bytes: int = 32 << 20) -> np.ndarray:
    """(blocks, 8) uint32 words of a blocked Bloom filter over the column ``key``."""
    n_blocks = int(min(max(1, -(-n_keys * bits_per_key // 256)), max_filter_bytes // 32))
    block, bits = _block_and_masks(F.xxhash64("key"), n_blocks)
    words = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), b)).alias(f"w{i}") for i, b in enumerate(bits)]
    out = np.zeros((n_blocks, LANES), dtype=np.uint32)
    got = keys.groupBy(block.alias("block")).agg(*words).toPandas()  # at most n_blocks rows
    if len(got):
        out[got["block"].to_numpy()] = got[[f"w{i}" for i in range(LANES)]].to_numpy(dtype=np.int64).astype(np.uint32)
    return out


def may_contain(spark, words: np.ndarray):
    """A vectorised probe of the filter: arrays of xxhash64 keys to arrays of booleans."""
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("array<boolean>")
    def probe(hashes: pd.Series) -> pd.Series:
        sizes = hashes.map(len).to_numpy()
        h = (np.concatenate(hashes.to_list()) if sizes.sum() else np.zeros(0)).astype(np.int64).view(np.uint64)
        rows = shared.value[((h >> np.uint64(32)) % np.uint64(len(shared.value))).astype(np.int64)]
        low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        found = np.ones(len(h), dtype=bool)
        for lane, m in enumerate(MULTIPLIERS):
            bit = (low * np.uint32(m)) >> np.uint32(27)
            found &= ((rows[:, lane] >> bit) & np.uint32(1)).astype(bool)
        return pd.Series(np.split(found, np.cumsum(sizes)[:-1]) if len(sizes) else [], dtype=object)

    return probe


def judge(
    pages: DataFrame,
    listed: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    salts: int = 16,
    max_rules: int = 100_000,
) -> DataFrame:
    """Every row of ``pages``: id, host, path, ``rule`` (the longest that fits, else null),
    ``listed`` (its canonical url is on the list) and the verdict.

    ``listed`` has one column ``key``: urls as ``canonical`` gives them, to block where no rule fits.
    """
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; more than {max_rules} are not broadcast")
    spark = pages.sparkSession
    host, path = host_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), canonical(F.col(url_col)).alias("own"))

    rule_rows = spark.createDataFrame(
        [(r.host + r.path, r.verdict) for r in rules], "key string, rule_verdict string"
    ).dropDuplicates(["key"])
    listed = stash(listed.where(F.col("key").isNotNull()).select("key").distinct(), "listed-urls")
    keys = listed.unionByName(rule_rows.select("key"))
    probe = may_contain(spark, build_filter(keys, keys.count()))

    # What a url asks for: its own key, then every host suffix with every path prefix of a length some rule has.
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    prefixes = F.filter(
        F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted({len(r.path) for r in rules})]),
        lambda p: p.isNotNull(),
    )
    asked = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    own = F.array("own")
    asked = urls.withColumn("asked", F.concat(own, asked) if rules else own)
    hit = probe(F.transform("asked", lambda k: F.xxhash64(k)))
    flagged = asked.withColumn("hit", hit).withColumn("n", F.monotonically_increasing_id())
    # Written once, so that row numbers stay the same whatever is computed again.
    flagged = stash(
        flagged.select("n", "id", "host", "path", F.expr("if(hit[0], own, null) as own"), F.expr("hit[0] as own_hit"), F.expr("filter(asked, (k, i) -> i > 0 and hit[i]) as hits")),
        "flagged-urls",
    )

    fits = (
        flagged.select("n", F.explode("hits").alias("key"))
        .join(F.broadcast(rule_rows), "key")
        .groupBy("n")
        .agg(F.max(F.struct(F.length("key").alias("len"), "key", "rule_verdict")).alias("best"))
    )
    possible = flagged.where("own_hit").select(
        "n", F.col("own").alias("key"), F.pmod("n", F.lit(salts)).cast("int").alias("salt")
    )
    salted = listed.select("key", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    on_list = possible.join(salted, ["key", "salt"]).select("n", F.lit(True).alias("listed"))
    return (
        flagged.drop("hits", "own", "own_hit")
        .join(fits, "n", "left")
        .join(on_list, "n", "left")
        .select(
            F.col("id").alias(id_col),
            "host",
            "path",
            F.col("best.key").alias("rule"),
            F.coalesce("best.rule_verdict", F.when(F.col("listed"), "block"), F.lit("allow")).alias("verdict"),
            F.coalesce("listed", F.lit(False)).alias("listed"),
        )
    )


def tracked_urls(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The list of the registered query: canonical urls of all pages that were linked with a tracking parameter."""
    return pages.where(F.col(url_col).contains("utm_source=")).select(canonical(F.col(url_col)).alias("key"))


def op9_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return judge(pages, tracked_urls(pages))


_RULE_VALUES = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)
OP9_SQL = f"""
with u as (
  select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
h as (
  select page_id, url,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path
  from u),
q as (
  select *, list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '://[^?#]*\\?([^#]*)', 1), '&'),
    lambda p: p <> '' and not regexp_matches(p, '{TRACKING}'))) params from h),
c as (select *, host || path || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end own from q),
r(rhost, rpath, v) as (values {_RULE_VALUES}),
fit as (
  select page_id, url, arg_max(rhost || rpath, length(rhost || rpath)) rule, arg_max(v, length(rhost || rpath)) v
  from h join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by 1, 2),
listed as (select distinct own k from c where contains(url, 'utm_source='))
select c.page_id, host, path, rule, coalesce(fit.v, case when k is null then 'allow' else 'block' end) verdict, k is not null listed
from c left join fit on c.page_id is not distinct from fit.page_id and c.url is not distinct from fit.url
left join listed on k = own
"""
