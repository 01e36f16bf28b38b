"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression, so the whole operator is a narrow
projection over the scan: no shuffle, no user function, bounded by one row.

Defined results: a null or empty text has no words and fails the base rule;
texts of any length are read whole; repeated rows are judged row by row; an
empty table gives an empty table; columns of the input other than the id and
text columns are not looked at, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Frequent function words of the corpus languages, matched as whole words, lower-case or capitalised.
STOP_WORDS = (
    "the be to of and that have with it is in for on a was are from this by as at or he an not "
    "der die das und ist von mit den des ein eine zu im für auf dem sich nicht es als auch "
    "le la les de des et un une est pour dans que qui par sur pas plus en du au avec ce il "
    "el los las y en con por para del se su al lo como más una"
).split()
STOP_FORMS = tuple(dict.fromkeys(form for w in STOP_WORDS for form in (w, w.capitalize())))


@dataclass(frozen=True)
class Rule:
    """Keep a text only while ``low <= measure <= high`` (an open side is None)."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: measure is a SQL expression over the measured columns.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 1.5, 15.0),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.2),
    Rule("stop_word_ratio", "n_stop_words / n_words", 0.01, None),
    Rule("duplicate_line_ratio", "n_dup_lines / greatest(n_lines, 1)", None, 0.5),
    Rule("bullet_line_ratio", "n_bullet_lines / greatest(n_lines, 1)", None, 0.9),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines / greatest(n_lines, 1)", None, 0.3),
)


def _count(array: Column) -> Column:
    return F.size(array).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts) per row of ``docs``; counts are over the whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    has_word = "[^\\x20\\x09-\\x0D]"
    base = docs.select(
        F.col(id_col),
        text.alias("t"),
        words_of(F.col(text_col)).alias("w"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(has_word)).alias("lines"),
    )
    # Hashes of 2 and then 4 words in a row; a text whose 4-word hashes all differ repeats no window and goes no further.
    two = base.select(
        id_col, "t", "w", "lines", F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1))).alias("h2"),
        F.size("w").alias("n"),
    )
    four = two.select(
        id_col, "t", "w", "lines", "n", F.transform("h2", lambda x, i: F.xxhash64(x, F.get("h2", i + 2))).alias("h4"),
        F.size("h2").alias("n2"),
    )
    eight = four.select(
        id_col, "t", "w", "lines", "h4",
        F.when(
            (F.col("n2") >= WINDOW) & (F.size(F.array_distinct("h4")) < F.col("n")),
            F.transform(F.slice("h4", 1, F.col("n") - (WINDOW - 1)), lambda x, i: F.xxhash64(x, F.get("h4", i + 4))),
        ).alias("h"),
    )
    ranked = eight.withColumn(
        "s",
        F.when(
            F.size(F.array_distinct("h")) < F.size("h"),
            F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i")))),
        ),
    )
    twin = F.expr(
        "sort_array(transform(filter(sequence(0, size(s) - 1), k -> "
        "(k > 0 and s[k].h = s[greatest(k - 1, 0)].h) or (k < size(s) - 1 and s[k].h = s[least(k + 1, size(s) - 1)].h)), k -> s[k].i))"
    )
    placed = ranked.withColumn("at", F.when(F.col("s").isNotNull(), twin))
    covered = F.expr(
        f"aggregate(at, named_struct('n', 0L, 'e', 0L), (a, i) -> named_struct("
        f"'n', a.n + i + {WINDOW} - greatest(a.e, cast(i as bigint)), 'e', cast(i + {WINDOW} as bigint)), a -> a.n)"
    )
    return placed.select(
        id_col,
        _count("w").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        _count("lines").alias("n_lines"),
        _count(F.filter("w", lambda x: x.isin(*STOP_FORMS))).alias("n_stop_words"),
        _count(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))).alias("n_bullet_lines"),
        _count(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).alias("n_ellipsis_lines"),
    )


BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def broken(rule: Rule) -> Column:
    value, tests = f"({rule.measure})", []
    if rule.low is not None:
        tests.append(f"{value} < {rule.low}D")
    if rule.high is not None:
        tests.append(f"{value} > {rule.high}D")
    return F.expr(" or ".join(tests))


def apply_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Measures of every text, ``base_failed``, the names of the broken ``rules`` and ``kept``."""
    failed = F.expr(BASE_FAILED)
    names = F.filter(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    verdict = F.lit(True)
    for r in rules:
        verdict = verdict & ~broken(r)
    return measure(docs, id_col, text_col).select(
        "*",
        failed.alias("base_failed"),
        F.when(F.col("n_words") > 0, names).otherwise(F.array().cast("array<string>")).alias("broken_rules"),
        F.when(failed, F.lit(False)).otherwise(verdict).alias("kept"),
    )


def op8_quality_rules(spark, sf_dir):
    from .common import table

    return apply_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_stop_words",
    )


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_FORMS)
_RULE_SQL = " and ".join(
    f"not ({' or '.join(t)})"
    for r in RULES
    for t in [
        [f"({r.measure}) < {r.low}" for _ in [0] if r.low is not None]
        + [f"({r.measure}) > {r.high}" for _ in [0] if r.high is not None]
    ]
)

OP8_SQL = f"""
with d as (select doc_id, coalesce(text, '') t from documents),
a as (
  select doc_id, t,
    list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) lines
  from d),
win as (
  select doc_id, i, list_slice(w, i, i + 7) g
  from (select doc_id, w, unnest(range(1, len(w) - 6)) i from a where len(w) >= 8)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) c from win) where c > 1),
cov as (
  select doc_id, sum(least(8, coalesce(nx - i, 8))) n
  from (select doc_id, i, lead(i) over (partition by doc_id order by i) nx from rep) group by 1),
m as (
  select a.doc_id, len(w)::bigint n_words,
    length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::bigint word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines,
    coalesce(cov.n, 0)::bigint n_repeat_words, len(lines)::bigint n_lines,
    len(list_filter(w, lambda x: x in ({_STOP_SQL})))::bigint n_stop_words,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09]*[-*•]')))::bigint n_bullet_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$')))::bigint n_ellipsis_lines
  from a left join cov using (doc_id)),
b as (select *, ({BASE_FAILED}) base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  case when base_failed then false else {_RULE_SQL} end kept, n_lines, n_stop_words
from b
"""
