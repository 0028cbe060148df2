"""Packing and mixing."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.llm import mixing, packing, tokens


def fewest(sizes, capacity):
    """Fewest containers, by trying all assignments (small inputs)."""
    best = len(sizes)

    def go(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(sizes):
            best = len(free)
            return
        for j in range(len(free)):
            if free[j] >= sizes[i]:
                free[j] -= sizes[i]
                go(i + 1, free)
                free[j] += sizes[i]
        free.append(capacity - sizes[i])
        go(i + 1, free)
        free.pop()

    go(0, [])
    return best


def test_best_fit_and_bound():
    rng = random.Random(1)
    for _ in range(300):
        c = rng.randint(1, 40)
        sizes = sorted((rng.randint(1, c) for _ in range(rng.randint(0, 8))), reverse=True)
        where = packing.best_fit_decreasing(sizes, c)
        fill = np.bincount(where, weights=sizes) if sizes else np.array([])
        assert (fill <= c).all() and len(where) == len(sizes)
        bound, exact = packing.lower_bound(np.bincount(sizes, minlength=c + 1), c), fewest(sizes, c)
        assert bound <= exact <= len(fill) or not sizes and bound == 0


def packed(spark, sizes, caps, **kw):
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens bigint")
    limits = spark.createDataFrame([(i, c) for i, c in enumerate(caps)], "pack_id int, capacity_tokens int")
    return packing.pack(df, "doc_id", limits, **kw), limits


@pytest.mark.parametrize("part", [20_000, 40])
def test_every_token_once(spark, part):
    rng = random.Random(part)
    sizes = [rng.choice([1, 7, 100, 256, 257, rng.randint(1, 60), rng.randint(1, 3000)]) for _ in range(400)]
    out, limits = packed(spark, sizes, [256, 1024, None, 0], partition_items=part)
    rows = out.collect()
    assert {r["pack_id"] for r in rows} == {0, 1}
    for p, c in ((0, 256), (1, 1024)):
        mine = [r for r in rows if r["pack_id"] == p]
        for d, n in enumerate(sizes):
            pieces = sorted((r["start"], r["n_tokens"]) for r in mine if r["doc_id"] == d)
            assert [s for s, _ in pieces] == list(itertools.accumulate([0, *[k for _, k in pieces[:-1]]])) and sum(k for _, k in pieces) == n
            assert len(pieces) == -(-n // c)
        fill = {}
        for r in mine:
            fill[r["bin_id"]] = fill.get(r["bin_id"], 0) + r["n_tokens"]
        assert max(fill.values()) <= c
        rep = {r["pack_id"]: r for r in packing.report(out, limits).collect()}[p]
        assert rep["n_bins"] == len(fill) and rep["lower_bound"] <= rep["n_bins"] <= rep["lower_bound"] * 1.1 + 2


def test_pack_nothing(spark):
    assert packed(spark, [1], [10])[0].count() == 1
    df = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    limits = spark.createDataFrame([(1, 5)], "pack_id int, capacity_tokens int")
    assert packing.pack(df, "doc_id", limits).count() == 0


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "def f(x): return x", "a"), (2, "", "b"), (3, None, "c"), (4, "日本語のテキスト", None)], "doc_id bigint, text string, source string").withColumn("n_tokens", F.lit(-1))
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.sizes(df, "doc_id", "text", "source").collect()}
    assert set(got) == {1, 4} and got[1] == tokens.count("def f(x): return x") > 3
    enc = tokens.encoder(tokens.VOCABULARY)
    assert enc.decode(enc.encode_ordinary("é <|endoftext|> 日本")) == "é <|endoftext|> 日本"


TARGETS = [("Big-Code", 0.5, 1), ("docs", 0.3, 2), ("tiny", 0.1, 5), ("absent", 0.1, 3)]


def mix(spark, rows, total=None, **kw):
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame(TARGETS, "source string, target_weight double, max_repeats int")
    drawn = mixing.draw(sizes, "doc_id", targets, total, **kw)
    return drawn, {r["source"]: r for r in mixing.shares(drawn, sizes, targets, total).collect()}


@pytest.mark.parametrize("bucket", [20_000, 10])
def test_shares(spark, bucket):
    rng = random.Random(bucket)
    rows = [(i, rng.choice(["big_code", " BIG-CODE", "Big Code"]), rng.randint(1, 500)) for i in range(700)] + [(1000 + i, "docs", rng.randint(1, 90)) for i in range(500)] + [(2000 + i, "TINY", rng.randint(1, 20)) for i in range(150)] + [(3000, None, 5), (3001, "other", 5)]
    drawn, shares = mix(spark, rows, bucket_rows=bucket)
    got = drawn.collect()
    assert len({r["doc_id"] for r in got}) == len(got) and all(r["n_repeats"] <= {"big_code": 1, "docs": 2, "tiny": 5}[r["source"]] for r in got)
    assert shares["absent"]["drawn_tokens"] == 0 and shares["absent"]["share"] == 0
    for s in ("big_code", "docs", "tiny"):
        used = sum(r["n_tokens"] * r["n_repeats"] for r in got if r["source"] == s)
        assert used == shares[s]["drawn_tokens"] and 0 <= shares[s]["budget"] - used <= 500
        # an epoch is whole before the next begins
        reps = {r["doc_id"]: r["n_repeats"] for r in got if r["source"] == s}
        if max(reps.values()) > 1:
            assert max(reps.values()) - min(reps.values()) <= 1
    again, _ = mix(spark, rows, bucket_rows=bucket)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_given_total_and_nothing(spark):
    rows = [(i, "docs", 10) for i in range(20)]
    drawn, shares = mix(spark, rows, total=500)
    assert shares["docs"]["drawn_tokens"] == 150 and drawn.count() == 15
    drawn, shares = mix(spark, [])
    assert drawn.count() == 0 and shares["docs"]["budget"] == 0


def test_copies_are_one_text(spark):
    df = spark.createDataFrame([(5, "Docs", "x", 3), (2, "docs ", "x", 3), (9, "docs", "y", 4), (1, "code", "x", 3), (7, None, "x", 3)], "doc_id bigint, source string, digest string, n_tokens bigint")
    got = sorted(map(tuple, mixing.distinct_texts(df, "doc_id", "digest").collect()))
    assert got == [(1, "code", 3), (2, "docs", 3), (7, None, 3), (9, "docs", 4)]


def test_room_of_a_giant_is_filled_by_repeats(spark):
    # the giant of `docs` doesn't fit its budget; small records may come twice
    rows = [(1, "docs", 3000)] + [(10 + i, "docs", 10) for i in range(100)] + [(1000 + i, "big_code", 10) for i in range(500)]
    drawn, shares = mix(spark, rows, total=7000)
    assert shares["docs"]["budget"] == 2100 and shares["docs"]["drawn_tokens"] == 2000 and shares["docs"]["most_repeats"] == 2 and shares["docs"]["unfilled"] == 100
    assert {r["n_repeats"] for r in drawn.where("source = 'docs'").collect()} == {2} and drawn.where("doc_id = 1").count() == 0


def test_exchange_goes_on_until_it_saves_nothing(spark):
    rng = random.Random(9)
    sizes = spark.createDataFrame([(i, rng.choice([34, 35, 51, 66, 67, 20])) for i in range(1500)], "doc_id bigint, n_tokens bigint")
    limits = spark.createDataFrame([(1, 100)], "pack_id int, capacity_tokens int")
    bins = [packing.pack(sizes, "doc_id", limits, rounds=r, partition_items=60).select("bin_id").distinct().count() for r in (0, 3, None)]
    assert bins[0] >= bins[1] >= bins[2]
