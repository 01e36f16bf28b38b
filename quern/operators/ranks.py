"""Dense numbers and running sums over an integer key, without a single-task sort.

A global (or hot) window would put all rows into one task.  Here rows fall into
buckets of about ``IN_BUCKET`` rows, cut at quantiles of the key; sums per
(group, bucket) are pre-aggregated, their prefixes are taken over that small
table, and only rows of one bucket are ordered together.  Tables of one bucket
need no more than a window per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

IN_BUCKET = 250_000


def _bucket_of(df: DataFrame, key: str, buckets: int) -> Column:
    """The bucket of ``key``, by quantiles of all rows: a binary search in their array, without Python."""
    shares = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    edges = sorted(set(df.agg(F.percentile_approx(key, shares, max(10_000, 4 * buckets)).alias("e")).first()["e"] or []))
    if not edges:
        return F.lit(0)
    among = F.split(F.lit(",".join(str(int(e)) for e in edges)), ",").cast("array<bigint>")  # folded to one literal
    steps = [1 << k for k in reversed(range(len(edges).bit_length()))]
    own = F.col(key).cast("long")
    found = F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(among, at + step - 1) <= own, at + step).otherwise(at)
    )  # past the last edge the comparison is null
    return F.when(own.isNull(), 0).otherwise(found)


def with_prefixes(
    df: DataFrame, key: str, by: list[str], values: dict[str, Column], n: int | None = None, in_bucket: int = IN_BUCKET, ties: list[str] | None = None
) -> DataFrame:
    """``df`` with a column per item of ``values``: its sum over the rows before, in the order of ``key`` within ``by``.

    ``n`` is the number of rows, if the caller knows it.
    """
    n = df.count() if n is None else n
    buckets = -(-n // in_bucket)
    order = [key, *(ties or [])]
    before = [Window.unboundedPreceding, -1]
    summed = lambda v, w: F.coalesce(F.sum(v).over(w), F.lit(0)).cast("long")
    if buckets <= 1:
        own = Window.partitionBy(*by).orderBy(*order).rowsBetween(*before)
        return df.select("*", *[summed(v.cast("long"), own).alias(name) for name, v in values.items()])
    df = store.written(df.select("*", *[v.cast("long").alias(f"_v_{name}") for name, v in values.items()]), "to-number")  # read three times
    rows = df.withColumn("_bucket", _bucket_of(df, key, buckets))
    sums = rows.groupBy(*by, "_bucket").agg(*[F.sum(f"_v_{name}").alias(f"_s_{name}") for name in values])
    all_before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(*before)
    prefix = sums.select(*by, "_bucket", *[summed(F.col(f"_s_{name}"), all_before).alias(f"_p_{name}") for name in values])
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(*before)
    joined = rows.join(prefix, [*by, "_bucket"])
    return joined.select(*[c for c in df.columns if not c.startswith("_v_")], *[(F.col(f"_p_{name}") + summed(F.col(f"_v_{name}"), inside)).alias(name) for name in values])


def numbered(df: DataFrame, key: str, by: list[str], name: str, n: int | None = None, in_bucket: int = IN_BUCKET, ties: list[str] | None = None) -> DataFrame:
    """``df`` with a dense number from 0 in the order of ``key`` within ``by``."""
    return with_prefixes(df, key, by, {name: F.lit(1)}, n, in_bucket, ties)
