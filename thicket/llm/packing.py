"""Putting items of varying size into containers of fixed capacity.

Items are spread over partitions of bounded size; each is packed by best-fit decreasing and gets a
lower bound on its number of containers from dual feasible functions. A partition that meets its
bound is certified: no packing of its items needs fewer containers. Partitions with a gap give up
the containers that aren't full; those items are mixed anew and packed again, as long as that saves
containers. Items over the capacity are split into full containers and a rest.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship

#: Items of a partition at most (on average; partitions are hash-made).
PARTITION_ITEMS = 20_000


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item, in the order given; sizes must be 1..capacity.

    The items are taken by falling size, ties in the order given; each goes into the fullest container
    with room (the latest opened of equals), else into a new one. Containers are kept by free space
    with one bit per space in use, so a step costs one search in a bit set.
    """
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    where = [0] * len(sizes)
    by_space: dict[int, list[int]] = {}
    used, opened = 0, 0
    for i in order:
        s = sizes[i]
        fit = used >> s
        if fit:
            space = s + (fit & -fit).bit_length() - 1
            stack = by_space[space]
            b = stack.pop()
            if not stack:
                used &= ~(1 << space)
        else:
            space, b = capacity, opened
            opened += 1
        where[i] = b
        left = space - s
        if left:
            by_space.setdefault(left, []).append(b)
            used |= 1 << left
    return where


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Containers needed at least for histogram[s] items of size s, by dual feasible functions.

    Two families, each for every threshold: items over capacity - t count as a whole container, items
    under t not at all, the rest by size; and the rounding functions of k = 1..20, which count an item
    x as floor((k + 1) x / capacity) / k unless (k + 1) x / capacity is whole, when it counts x.
    """
    s = np.arange(len(histogram))
    n = histogram.astype(np.int64)
    total = int((n * s).sum())
    best = -(-total // capacity)
    many, mass = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * s)])
    t = np.arange(1, capacity // 2 + 1)
    whole = many[-1] - many[capacity - t + 1]
    rest = mass[capacity - t + 1] - mass[t]
    if len(t):
        best = max(best, int((whole + -(-rest // capacity)).max()))
    for k in range(1, 21):
        y = (k + 1) * s
        exact = y % capacity == 0
        # in units of 1 / (k * capacity)
        value = np.where(exact, s * k, (y // capacity) * capacity)
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    return best


def pack_group(df: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Adds bin, fill (of the bin), n_bins and bound (of the group)."""
    df = df.sort_values(["n_tokens", "item", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    sizes = df["n_tokens"].tolist()
    where = best_fit_decreasing(sizes, capacity)
    fill = np.bincount(where, weights=sizes).astype(np.int64)
    bound = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
    return df.assign(bin=where, fill=fill[where], n_bins=len(fill), bound=bound)


PACKED = "pack_id int, capacity int, item bigint, piece int, start bigint, n_tokens bigint, round int, part bigint, bin bigint, fill bigint, n_bins bigint, bound bigint"


def pack_parts(items: DataFrame, round_no: int, parts: int) -> DataFrame:
    """Best-fit decreasing in each of `parts` hash-made partitions per capacity."""
    spread = items.withColumn("part", F.pmod(F.xxhash64("item", "piece", F.lit(round_no)), F.lit(parts)))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        out = pack_group(df, int(df["capacity"].iloc[0]))
        return out.assign(round=round_no)[[c.split()[0] for c in PACKED.split(", ")]]

    return spread.groupBy("pack_id", "part").applyInPandas(run, PACKED)


def pack(sizes: DataFrame, key: str, limits: DataFrame, rounds: int | None = None, partition_items: int = PARTITION_ITEMS) -> DataFrame:
    """pack_id, bin_id, key, piece, start, n_tokens: every item in one container of each capacity.

    `sizes` has key (bigint, unique) and n_tokens >= 1; `limits` has pack_id and capacity_tokens, a few
    rows. An item over the capacity becomes pieces 0, 1, ... that begin at token `start`: full
    containers, and the rest as an item like others. No item, no row; limits that are null or below 1
    are left out. Partitions with a gap exchange items until that saves no more containers, or for
    `rounds` rounds if given.
    """
    ship(sizes.sparkSession)
    caps = limits.where("capacity_tokens >= 1").select(F.col("pack_id").cast("int"), F.col("capacity_tokens").cast("int").alias("capacity")).dropDuplicates(["pack_id"])
    # one copy of the items per capacity: the limits are a fixed, small table, read to the driver
    each = [F.struct(F.lit(r["pack_id"]).alias("pack_id"), F.lit(r["capacity"]).alias("capacity")) for r in caps.orderBy("pack_id").collect()]
    each = F.array(*each) if each else F.array().cast("array<struct<pack_id:int,capacity:int>>")
    wide = sizes.select(F.col(key).cast("bigint").alias("item"), "n_tokens", F.explode(each).alias("_c")).select("item", "n_tokens", "_c.*")
    pieces = F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / F.col("capacity")).cast("int")))
    cutup = wide.select("pack_id", "capacity", "item", pieces.alias("piece"), F.col("n_tokens").alias("_all"))
    cutup = cutup.withColumn("start", F.col("piece").cast("bigint") * F.col("capacity"))
    items = cut(cutup.select("pack_id", "capacity", "item", "piece", "start", F.least(F.col("capacity").cast("bigint"), F.col("_all") - F.col("start")).alias("n_tokens")))
    whole = items.where("n_tokens = capacity").select("pack_id", F.concat_ws("-", F.lit("f"), "item", "piece").alias("bin_id"), "item", "piece", "start", "n_tokens")
    loose = items.where("n_tokens < capacity")
    counts = [r["n"] for r in loose.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n")).collect()]
    done = [whole]
    packed, before = None, None
    for r in itertools.count() if rounds is None else range(rounds + 1):
        n = max(counts, default=0)
        if n == 0:
            break
        now = cut(pack_parts(loose, r, -(-n // partition_items)))
        bins = {x["pack_id"]: x["n"] for x in now.groupBy("pack_id").agg(F.countDistinct("part", "bin").alias("n")).collect()}
        if before is not None:
            # keep the new packing only where it saves containers
            better = [p for p, b in bins.items() if b < before[p]]
            done.append(label(packed.where(~F.col("pack_id").isin(better))) if better else label(packed))
            if not better:
                packed = None
                break
            now = now.where(F.col("pack_id").isin(better))
        gap = (F.col("n_bins") > F.col("bound")) & (F.col("fill") < F.col("capacity"))
        done.append(label(now.where(~gap)))
        packed = now.where(gap)
        loose = packed.select("pack_id", "capacity", "item", "piece", "start", "n_tokens")
        state = packed.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("part", "bin").alias("b")).collect()
        counts, before = [x["n"] for x in state], {x["pack_id"]: x["b"] for x in state}
    if packed is not None:
        done.append(label(packed))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumnRenamed("item", key)


def label(packed: DataFrame) -> DataFrame:
    return packed.select("pack_id", F.concat_ws("-", "round", "part", "bin").alias("bin_id"), "item", "piece", "start", "n_tokens")


def report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """pack_id, capacity, n_bins, n_tokens, fill share, and the lower bound that holds for all items together."""
    caps = limits.select(F.col("pack_id").cast("int"), F.col("capacity_tokens").cast("int").alias("capacity"))
    totals = packed.groupBy("pack_id").agg(F.countDistinct("bin_id").alias("n_bins"), F.sum("n_tokens").alias("n_tokens"))
    # at most `capacity` rows per capacity
    sizes = packed.groupBy("pack_id", "n_tokens").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(caps), "pack_id")

    def bound(df: pd.DataFrame) -> pd.DataFrame:
        c = int(df["capacity"].iloc[0])
        h = np.zeros(c + 1, np.int64)
        h[df["n_tokens"].to_numpy()] = df["n"].to_numpy()
        return pd.DataFrame({"pack_id": [int(df["pack_id"].iloc[0])], "capacity": [c], "lower_bound": [lower_bound(h, c)]})

    bounds = sizes.groupBy("pack_id").applyInPandas(bound, "pack_id int, capacity int, lower_bound bigint")
    return totals.join(bounds, "pack_id").withColumn("fill", F.col("n_tokens") / (F.col("n_bins") * F.col("capacity")))
