"""Drawing records so that every source has its share of the total size.

Every record gets a hash-random key. Within a source the records are range-sorted by key: equal key
ranges (buckets) are summed first, prefix sums over the buckets give each bucket its offset, and a
running sum inside the bucket gives each record its place. The source's budget then is cut: all
records for every whole epoch, those before the cut once more. What the record at the cut leaves open
is filled in the same way by records not yet drawn in this epoch, and, if more than NEXT_EPOCH of the
budget stays open, by a further one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Records of a bucket on average.
BUCKET_ROWS = 20_000
#: Open shares of a budget: from the first on a further epoch is begun for it, below the second it is left as it is.
NEXT_EPOCH, TOLERANCE = 0.01, 1e-4


def plain_source(c: Column) -> Column:
    """A source's name without case, blanks at the ends, and with `_` for `-` and blanks."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[-\s]+", "_")


def distinct_texts(sizes: DataFrame, key: str, digest: str) -> DataFrame:
    """key, source, n_tokens of each distinct text of a source: copies under other keys count as one text.

    The record with the smallest key stands for its copies. Sources are plainly named; a null source
    is one of its own.
    """
    named = sizes.withColumn("source", plain_source(F.col("source")))
    return named.groupBy("source", digest).agg(F.min(F.struct(F.col(key), F.col("n_tokens"))).alias("_m")).select(f"_m.{key}", "source", "_m.n_tokens")


def budgets(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """source, target_weight, max_repeats, available, budget of each target source.

    Without `total_tokens` the total is the largest that lets every source that has records keep its
    weight within max_repeats; a source without records gets nothing. With it, a source's budget is
    its weight of that total, capped by what max_repeats allows.
    """
    t = targets.where("target_weight > 0 and max_repeats >= 1").select(plain_source(F.col("source")).alias("source"), "target_weight", "max_repeats").dropDuplicates(["source"])
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count(F.lit(1)).alias("n_records"))
    both = t.join(have, "source", "left").fillna(0, ["available", "n_records"])
    most = F.col("available") * F.col("max_repeats")
    if total_tokens is None:
        total = both.where("available > 0").agg(F.min(most / F.col("target_weight")).alias("t"))
        both = both.withColumn("t", total.scalar())
    else:
        both = both.withColumn("t", F.lit(float(total_tokens)))
    # a thousandth of a token against rounding down an exact product
    budget = F.least(most, F.floor(F.col("t") * F.col("target_weight") + 1e-3)).cast("bigint")
    return both.select("source", "target_weight", "max_repeats", "available", "n_records", F.coalesce(budget, F.lit(0)).alias("budget"))


def prefix_take(rows: DataFrame, key: str, room: DataFrame) -> DataFrame:
    """Of each source the records that fit its `room` (source, room) one after the other in key order.

    Records larger than the whole room are passed over; the first that no longer fits ends the row.
    `rows` has key, source, n_tokens, _h and _bucket (ranges of _h). Only the buckets before the cut
    are sorted.
    """
    fits = rows.join(F.broadcast(room), "source").where("n_tokens <= room")
    sums = fits.groupBy("source", "_bucket", "room").agg(F.sum("n_tokens").alias("_n"))
    before = sums.select("source", "_bucket", "room", (F.sum("_n").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("_n")).alias("_offset"))
    reached = before.where("_offset < room").drop("room")
    inside = Window.partitionBy("source", "_bucket").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, 0)
    placed = fits.join(reached, ["source", "_bucket"]).withColumn("_run", F.sum("n_tokens").over(inside))
    return placed.where(F.col("_offset") + F.col("_run") <= F.col("room")).select(key, "source", "n_tokens")


def draw(sizes: DataFrame, key: str, targets: DataFrame, total_tokens: int | None = None, seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """key, source, n_tokens, n_repeats (>= 1) of every record that is drawn.

    `sizes` has key (unique), source and n_tokens >= 1, one row per text (see `distinct_texts`); sources
    that aren't among the targets and null sources are left out. All records of a source are drawn for
    every whole epoch of its budget. For the rest of the budget records are taken in key order up to
    the cut; what is left open there is filled the same way by later records that fit, until none fits
    or less than TOLERANCE of the budget is open. If more than NEXT_EPOCH is (a record larger than the
    room stays out), a further epoch fills it, as long as records may be repeated. A source never
    exceeds its budget. Equal keys are ordered by record.
    """
    rows = cut(sizes.select(key, plain_source(F.col("source")).alias("source"), "n_tokens", F.xxhash64(F.lit(seed), F.col(key)).alias("_h")))
    plan = budgets(rows, targets, total_tokens).where("budget > 0")
    bits = max(1, rows.count() // bucket_rows).bit_length()
    # the sign bit turned, so that the order of buckets is the order of keys
    rows = rows.withColumn("_bucket", F.shiftrightunsigned(F.col("_h").bitwiseXOR(F.lit(-(2**63))), 64 - bits))
    whole = F.floor(F.col("budget") / F.col("available")).cast("bigint")
    # as many rows as there are targets: source -> whole epochs, most epochs, open room, epoch that is being drawn, budget
    rooms = {r["source"]: [r["whole"], r["max_repeats"], r["room"], r["whole"] + 1, r["budget"]] for r in plan.select("source", "max_repeats", "budget", whole.alias("whole"), (F.col("budget") - whole * F.col("available")).alias("room")).collect()}
    spark, taken, begun = rows.sparkSession, None, dict.fromkeys(rooms, False)
    while True:
        open_ = [(s, room, epoch) for s, (_w, most, room, epoch, budget) in rooms.items() if epoch <= most and room > budget * (TOLERANCE if begun[s] or epoch == _w + 1 else NEXT_EPOCH)]
        if not open_:
            break
        now = spark.createDataFrame(open_, "source string, room bigint, epoch bigint")
        left = rows
        if taken is not None:
            drawn = taken.join(F.broadcast(now.select("source", "epoch")), ["source", "epoch"], "left_semi").select(key)
            left = rows.join(drawn, key, "left_anti")
        more = prefix_take(left, key, now.select("source", "room"))
        more = cut(more.join(F.broadcast(now.select("source", "epoch")), "source"))
        used = {r["source"]: r["n"] for r in more.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
        taken = more if taken is None else taken.unionByName(more)
        for s, *_ in open_:
            rooms[s][2] -= used.get(s, 0)
            if s in used:
                begun[s] = True
            elif begun[s]:
                rooms[s][3], begun[s] = rooms[s][3] + 1, False
            else:
                rooms[s][2] = 0  # nothing fits in a fresh epoch either
    epochs = spark.createDataFrame([(s, w) for s, (w, *_) in rooms.items()], "source string, epochs bigint")
    once = None if taken is None else taken.groupBy(key).agg(F.count(F.lit(1)).alias("_more"))
    drawn = rows.join(F.broadcast(epochs), "source")
    drawn = drawn.withColumn("_more", F.lit(0)) if once is None else drawn.join(once, key, "left")
    times = (F.col("epochs") + F.coalesce("_more", F.lit(0))).cast("int")
    return drawn.select(key, "source", "n_tokens", times.alias("n_repeats")).where("n_repeats >= 1")


def shares(drawn: DataFrame, sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """source, target_weight, budget, n_records, n_tokens (repeats counted), share, most repeats, unfilled of each target.

    `unfilled` is the part of the budget that no record filled.
    """
    plan = budgets(sizes.withColumn("source", plain_source(F.col("source"))), targets, total_tokens)
    got = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("n_drawn"), F.sum(F.col("n_tokens") * F.col("n_repeats")).alias("drawn_tokens"), F.max("n_repeats").alias("most_repeats"))
    both = plan.join(got, "source", "left").fillna(0, ["n_drawn", "drawn_tokens", "most_repeats"])
    whole = Window.partitionBy(F.lit(1))  # the few rows of the targets
    return both.withColumn("share", F.try_divide(F.col("drawn_tokens"), F.sum("drawn_tokens").over(whole))).withColumn("unfilled", F.col("budget") - F.col("drawn_tokens"))
