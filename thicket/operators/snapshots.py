"""What changed between neighbouring full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain_path(c: Column) -> Column:
    """A relative path with `/` only and without empty or `.` steps; null stays null.

    A path made of nothing but such steps becomes the empty string. `..` is kept as it is.
    """
    # steps in the middle, at the beginning, at the end, and a single dot
    plain = F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"/(?:\.?/)+", "/")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"^(?:\.?/)+", ""), r"(?:/\.?)+$", ""), r"^\.$", "")
    return F.when(c.rlike(r"\\|//|^/|/$|(^|/)\.(/|$)"), plain).otherwise(c)


def canonical_hash(columns: Sequence[Column]) -> Column:
    """One 128-bit digest of a row's values; a null differs from every value, and borders count."""
    tagged = [F.coalesce(F.concat(F.lit("v"), F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("n")) for c in columns]
    return F.unhex(F.md5(F.concat(*tagged)))


#: Snapshots whose states are aggregated side by side.
SIDE_BY_SIDE = 32


def snapshot_numbers(rows: DataFrame, number: str) -> list[int]:
    """The snapshot numbers that occur, in order: one entry per snapshot, not per row."""
    return sorted(r[0] for r in rows.select(number).where(F.col(number).isNotNull()).distinct().collect())


def latest_rows(df: DataFrame, group: dict[str, Column], order: Column, digest: Column) -> DataFrame:
    """One row per group: the digest of the row with the greatest `order`.

    Of rows that tie on `order` the one with the greatest digest counts, so the result doesn't depend
    on how rows are spread; a null order comes first.
    """
    rows = df.select(*(c.alias(n) for n, c in group.items()), F.struct(order.alias("o"), digest.alias("d")).alias("_v"))
    return rows.groupBy(*group).agg(F.max("_v").alias("_v")).select(*group, F.col("_v.d").alias("digest"))


def latest_by_snapshot(df: DataFrame, number: Column, numbers: Sequence[int], keys: dict[str, Column], order: Column, digest: Column) -> DataFrame:
    """snapshot_no, keys, digest: as latest_rows per snapshot and key. The maxima of all snapshots are taken side by side
    in one aggregation by key: copies merge where they are read, so a record delivered very often
    sends one row per task, and the result lies spread by key for what follows.
    """
    rows = df.select(number.alias("_n"), *(c.alias(n) for n, c in keys.items()), F.struct(order.alias("o"), digest.alias("d")).alias("_v"))
    out = None
    for at in range(0, max(len(numbers), 1), SIDE_BY_SIDE):
        some = list(numbers[at : at + SIDE_BY_SIDE])
        wide = rows.where(F.col("_n").isin(some)).groupBy(*keys).agg(*(F.max(F.when(F.col("_n") == n, F.col("_v"))).alias(f"_{i}") for i, n in enumerate(some)), F.count(F.lit(1)).alias("_rows"))
        states = [F.struct(F.lit(n).alias("n"), F.col(f"_{i}.d").alias("digest")) for i, n in enumerate(some)] or [F.struct(F.lit(0).alias("n"), F.lit(None).cast("binary").alias("digest"))]
        each = wide.select(F.explode(F.array(*states)).alias("_s"), *keys).select(F.col("_s.n").alias("snapshot_no"), *keys, F.col("_s.digest").alias("digest")).where("digest is not null")
        out = each if out is None else out.unionByName(each)
    return out


def diff_snapshots(rows: DataFrame, number: str, keys: Sequence[str], digest: str = "digest", numbers: Sequence[int] | None = None) -> DataFrame:
    """Added, removed and changed keys for each pair of neighbouring snapshots.

    `rows` has one row per snapshot number and key, `numbers` may name the snapshots
    where they are known already. A pair is formed where both n and n + 1 occur. Full outer join of the two sides of each pair on the key: a
    key on one side only is `added` or `removed`, unequal digests mean `changed`. Keys must not be
    null (they'd never meet); an empty table gives no row. The join key is the whole record key, so no
    value of one key column can make a task hot; that the snapshots are neighbours is a range condition
    beside it, so both sides are the one shuffle by key that `latest_by_snapshot` left.
    """
    if numbers is None:
        numbers = snapshot_numbers(rows, number)
    old = rows.select(F.col(number).alias("_old_no"), *(F.col(k).alias(f"_old_{k}") for k in keys), F.col(digest).alias("_old"))
    new = rows.select(F.col(number).alias("_new_no"), *(F.col(k).alias(f"_new_{k}") for k in keys), F.col(digest).alias("_new"))
    # written as a range, since an equality would become a part of the key and cost a shuffle of each side
    on = (F.col("_old_no") < F.col("_new_no")) & (F.col("_old_no") >= F.col("_new_no") - 1)
    for k in keys:
        on = (F.col(f"_old_{k}") == F.col(f"_new_{k}")) & on
    both = old.join(new, on, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    from_no = F.coalesce(F.col("_old_no"), F.col("_new_no") - 1)
    either = [F.coalesce(f"_old_{k}", f"_new_{k}").alias(k) for k in keys]
    first = [n for n in numbers if n + 1 in set(numbers)]
    # what belongs to no pair is left out after the join, so that both sides stay the same
    changes = both.select(from_no.alias("from_no"), (from_no + 1).alias("to_no"), *either, change.alias("change"))
    return changes.where(F.col("change").isNotNull() & F.col("from_no").isin(first))
