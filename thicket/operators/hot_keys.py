"""Per-key results that stay balanced when a few keys hold most rows.

Everything is built from counts that merge: the rows are first reduced to (key, value) counts, whose
shuffle key includes the value, so a hot key is spread over all tasks. Coarser histograms are made
by merging finer ones. Quantiles are then found from the top: each level picks, for every key and
wanted rank, the one bucket that holds the rank and refines only that bucket, until a single value
is left. A window or join group never has more than 2**bits rows, whatever the number of rows of a key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

BITS = 11


def long_keys(df: DataFrame, key_columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per row and key column: `key_column`, `key_value`, and the columns in `keep`."""
    pairs = F.array(*(F.struct(F.lit(c).alias("key_column"), F.col(c).cast("string").alias("key_value")) for c in key_columns))
    return df.select(F.explode(pairs).alias("_k"), *keep).select("_k.key_column", "_k.key_value", *keep)


def same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Equality of the named columns in which null equals null."""
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond


def histograms(df: DataFrame, keys: Sequence[str], value: str, width: int = 32, bits: int = BITS, keep: Callable[[DataFrame], DataFrame] = lambda x: x) -> list[DataFrame]:
    """Counts per key and bucket, finest first: columns `keys`, `bucket`, `n`; `keep` may materialise each.

    `value` must be an integer of at most `width` bits; a null value counts in the bucket null of
    every level and never ranks.
    """
    v = F.col(value).cast("bigint") + F.lit(1 << (width - 1))
    levels = [keep(df.groupBy(*keys, v.alias("bucket")).agg(F.count(F.lit(1)).alias("n")))]
    for _ in range((width - 1) // bits):
        levels.append(keep(levels[-1].groupBy(*keys, F.shiftright("bucket", bits).alias("bucket")).agg(F.sum("n").alias("n"))))
    return levels


def totals(levels: list[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows per key (`n_rows`), and those with a value (`n_valued`), merged from the coarsest histogram."""
    valued = F.sum(F.when(F.col("bucket").isNotNull(), F.col("n")).otherwise(0))
    return levels[-1].groupBy(*keys).agg(F.sum("n").alias("n_rows"), valued.cast("bigint").alias("n_valued"))


def exact_quantiles(levels: list[DataFrame], keys: Sequence[str], per_cent: Sequence[int], width: int = 32, bits: int = BITS) -> DataFrame:
    """Exact discrete quantiles per key: `keys`, `pct`, `value`.

    The quantile p of n values is the value of rank max(1, ceil(p * n / 100)). Ties share a value.
    A key without values has no row.
    """
    ranks = F.explode(F.array(*(F.lit(int(p)) for p in per_cent))).alias("pct")
    rank = F.greatest(F.lit(1), F.floor((F.col("pct") * F.col("n_valued") + 99) / 100)).cast("bigint")
    per_key = totals(levels, keys).where("n_valued > 0").select(*keys, "n_valued", ranks)
    want = per_key.select(*keys, "pct", rank.alias("rank"), F.lit(0).cast("bigint").alias("prefix"))
    for at in range(len(levels) - 1, -1, -1):
        up = F.lit(0).cast("bigint") if at == len(levels) - 1 else F.shiftright("bucket", bits)
        level = levels[at].where("bucket is not null").select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("bucket"), F.col("n"), up.alias("_prefix"))
        cond = F.col("prefix") == F.col("_prefix")
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
        inside = Window.partitionBy(*keys, "pct", "prefix").orderBy("bucket")
        want = (
            want.join(level, cond)
            .withColumn("_cum", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
            .where("_cum >= rank and _cum - n < rank")
            .select(*keys, "pct", (F.col("rank") - (F.col("_cum") - F.col("n"))).alias("rank"), F.col("bucket").alias("prefix"))
        )
    return want.select(*keys, "pct", (F.col("prefix") - F.lit(1 << (width - 1))).alias("value"))


def profile(df: DataFrame, key_columns: Sequence[str], value: str, per_cent: Sequence[int] = (25, 50, 75)) -> DataFrame:
    """Per key column and key value: rows, rows with a value, and exact quantiles of `value`.

    Columns key_column, key_value, n_rows, n_valued, q<p>... A null key is a key of its own (null
    key_value); keys without any value have null quantiles. An empty table gives no row. Only the
    named columns are read, so further columns with any name do no harm. The rows are counted once;
    what is kept and merged further are the counts per key and value.
    """
    keys = ["key_column", "key_value"]
    levels = histograms(long_keys(df.select(*dict.fromkeys([*key_columns, value])), key_columns, [value]), keys, value, keep=cut)
    n = totals(levels, keys)
    q = exact_quantiles(levels, keys, per_cent)
    wide = q.groupBy(*keys).agg(*(F.max(F.when(F.col("pct") == p, F.col("value"))).alias(f"q{p}") for p in per_cent))
    wide = wide.select(*(F.col(k).alias(f"_{k}") for k in keys), *(f"q{p}" for p in per_cent))
    cond = F.col("key_column").eqNullSafe(F.col("_key_column")) & F.col("key_value").eqNullSafe(F.col("_key_value"))
    return n.join(wide, cond, "left").drop("_key_column", "_key_value")


def select_ranks(rows: DataFrame, keys: Sequence[str], value: Column, want: DataFrame, width: int = 32, bits: int = BITS) -> DataFrame:
    """keys, tag, value: for each row of `want` (keys, tag, rank) the value of that rank among the key's rows.

    `value` is a bigint from 0 to 2**width - 1 and never null. From the leading bits down, each pass
    over the rows counts, for every key and open prefix, how many rows fall into each of its 2**bits
    buckets; the counts merge map-side, and the bucket that holds the rank becomes the next prefix.
    After the last pass a bucket is one value. `want` must be of a bounded size: its prefixes are
    broadcast. Keys must not be null.
    """
    shift = bits * ((width - 1) // bits)
    want = want.select(*keys, "tag", F.col("rank").cast("bigint").alias("rank"), F.lit(0).cast("bigint").alias("prefix"))
    inside = Window.partitionBy(*keys, "tag", "prefix").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    first = True
    while shift >= 0:
        open_ = F.broadcast(want.select(*keys, "prefix").distinct())
        digits = rows.select(*keys, F.shiftright(value, shift).alias("bucket"))
        digits = digits.withColumn("prefix", F.lit(0).cast("bigint") if first else F.shiftright("bucket", bits))
        level = digits.join(open_, [*keys, "prefix"], "left_semi").groupBy(*keys, "prefix", "bucket").agg(F.count(F.lit(1)).alias("n"))
        step = want.join(level, [*keys, "prefix"]).withColumn("_cum", F.sum("n").over(inside)).where("_cum >= rank and _cum - n < rank")
        want = cut(step.select(*keys, "tag", (F.col("rank") - (F.col("_cum") - F.col("n"))).alias("rank"), F.col("bucket").alias("prefix")))
        shift, first = shift - bits, False
    return want.select(*keys, "tag", F.col("prefix").alias("value"))


#: Bits of the hash by which keys are put in order to find the heavy ones.
HASH_BITS = 33


def heavy(df: DataFrame, key_columns: Sequence[str], value: str, share: float, per_cent: Sequence[int] = (25, 50, 75), width: int = 32, bits: int = BITS) -> DataFrame:
    """Non-null key values that hold at least `share` of all rows, with exact quantiles of `value`.

    Columns key_column, key_value, n_rows, n_valued, q<p>. In the order of the keys' hashes, a key with
    that many rows covers a whole run of ranks that long, so one of the ranks m, 2 m, 3 m, ... lies in
    it, m being the least number of rows. `select_ranks` finds the hashes at those ranks; keys with
    such a hash are counted exactly, and those with m rows or more stay. The quantiles of their
    values come from `select_ranks` again. No pass ever shuffles all keys or gathers a key's rows:
    a task sends at most 2**bits counts per open prefix, of which there are at most
    len(key_columns) / share, and three per heavy key later. A heavy key without any value has null
    quantiles. An empty table gives no row.
    """
    keys = ["key_column", "key_value"]
    rows = long_keys(df.select(*dict.fromkeys([*key_columns, value])), key_columns, [value]).where("key_value is not null")
    rows = rows.withColumn("_hash", F.shiftrightunsigned(F.xxhash64("key_value"), 64 - HASH_BITS))
    n_all, *n_keys = df.select(F.count(F.lit(1)), *(F.count(c) for c in key_columns)).first()
    # a hair less, against a share of a whole number of rows that comes out a bit above it
    least = max(1, math.ceil(share * n_all * (1 - 1e-12)))
    ranks = [(c, k, k * least) for c, n in zip(key_columns, n_keys) for k in range(1, n // least + 1)]
    want = df.sparkSession.createDataFrame(ranks, "key_column string, tag int, rank bigint")
    at = select_ranks(rows, ["key_column"], F.col("_hash"), want, HASH_BITS, bits)
    candidates = F.broadcast(at.select("key_column", F.col("value").alias("_hash")).distinct())
    counted = rows.join(candidates, ["key_column", "_hash"], "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("n_valued"))
    found = counted.where(F.col("n_rows") >= least)
    if not per_cent:
        return found
    found = cut(found)
    tags = F.explode(F.array(*(F.lit(int(p)) for p in per_cent))).alias("tag")
    rank = F.greatest(F.lit(1), F.floor((F.col("tag") * F.col("n_valued") + 99) / 100)).cast("bigint")
    want = found.where("n_valued > 0").select(*keys, "n_valued", tags).select(*keys, "tag", rank.alias("rank"))
    offset = F.lit(1 << (width - 1))
    at = select_ranks(rows.where(F.col(value).isNotNull()), keys, F.col(value).cast("bigint") + offset, want, width, bits)
    wide = at.groupBy(*keys).agg(*(F.max(F.when(F.col("tag") == p, F.col("value") - offset)).alias(f"q{p}") for p in per_cent))
    return found.join(wide, keys, "left")


def category_counts(df: DataFrame, key_columns: Sequence[str], category: Column) -> DataFrame:
    """Rows per key and category; counts are merged map-side, a hot key sends one row per task and category."""
    rows = df.select(*key_columns, category.alias("category"))
    return long_keys(rows, key_columns, ["category"]).groupBy("key_column", "key_value", "category").agg(F.count(F.lit(1)).alias("n_rows"))


def distinct_per_key(df: DataFrame, key_columns: Sequence[str], parts: dict[str, Column]) -> DataFrame:
    """Number of distinct `parts` tuples per key (null is a value), in two steps.

    The first groups by key and tuple, so that the tuples of a hot key are spread over all tasks; the
    second only adds up ones.
    """
    names = [f"_p{i}" for i in range(len(parts))]
    rows = df.select(*key_columns, *(c.alias(n) for n, c in zip(names, parts.values())))
    once = long_keys(rows, key_columns, names).groupBy("key_column", "key_value", *names).agg(F.count(F.lit(1)).alias("_n"))
    return once.groupBy("key_column", "key_value").agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"))
