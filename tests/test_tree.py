"""Navigation and relations against plain Python on random trees."""

import random

import pytest
from pyspark.sql import functions as F

from thicket.operators import rules as rl
from thicket.operators import tree
from thicket.sources.rules import Rule, parse_rules

from .trees import frame, keys, random_tree, rows_of


def ancestors(rows, r):
    by = {(x["file_id"], x["node_id"]): x for x in rows}
    while r["parent_id"] is not None:
        r = by[r["file_id"], r["parent_id"]]
        yield r


@pytest.fixture(scope="module")
def forest():
    rng = random.Random(5)
    rows = []
    for f in range(6):
        rows += rows_of(random_tree(rng, rng.choice((1, 2, 7, 40, 90))), f)
    deep = ("A", "x", [])
    for i in range(70):
        deep = ("BCD"[i % 3], "y", [("A", None, []), deep])
    return rows + rows_of(deep, 99)


def expect(rows, test):
    return sorted((r["file_id"], r["node_id"]) for r in rows if test(r))


def siblings(rows, r):
    return [x for x in rows if x["file_id"] == r["file_id"] and x["parent_id"] == r["parent_id"] and r["parent_id"] is not None]


def test_relations(spark, forest):
    n = frame(spark, forest).cache()
    is_b = F.col("kind") == "B"
    assert keys(tree.inside(n, is_b)) == expect(forest, lambda r: any(a["kind"] == "B" for a in ancestors(forest, r)))
    assert keys(tree.inside_parent(n, is_b)) == expect(forest, lambda r: next((a["kind"] == "B" for a in ancestors(forest, r)), False))
    below = {(a["file_id"], a["node_id"]) for r in forest if r["kind"] == "B" for a in ancestors(forest, r)}
    assert keys(tree.has(n, is_b)) == sorted(below)
    assert keys(tree.has_child(n, is_b)) == sorted({(r["file_id"], r["parent_id"]) for r in forest if r["kind"] == "B" and r["parent_id"] is not None})
    assert keys(tree.precedes(n, is_b)) == expect(forest, lambda r: any(s["kind"] == "B" and s["sib_idx"] > r["sib_idx"] for s in siblings(forest, r)))
    assert keys(tree.follows(n, is_b)) == expect(forest, lambda r: any(s["kind"] == "B" and s["sib_idx"] < r["sib_idx"] for s in siblings(forest, r)))
    assert keys(tree.precedes(n, is_b, True)) == expect(forest, lambda r: any(s["kind"] == "B" and s["sib_idx"] == r["sib_idx"] + 1 for s in siblings(forest, r)))
    assert keys(tree.follows(n, is_b, True)) == expect(forest, lambda r: any(s["kind"] == "B" and s["sib_idx"] == r["sib_idx"] - 1 for s in siblings(forest, r)))


def test_intervals_and_ancestors(spark, forest):
    n = frame(spark, forest)
    got = {(r["file_id"], r["node_id"]): r["last_id"] for r in tree.with_intervals(n.drop("last_id")).select("file_id", "node_id", "last_id").collect()}
    assert got == {(r["file_id"], r["node_id"]): r["last_id"] for r in forest}
    near = {(r["file_id"], r["node_id"]): r["ancestor_id"] for r in tree.nearest_ancestor(n, F.col("kind") == "C").collect()}
    want = {}
    for r in forest:
        a = next((a["node_id"] for a in ancestors(forest, r) if a["kind"] == "C"), None)
        if a is not None:
            want[r["file_id"], r["node_id"]] = a
    assert near == want
    pairs = sorted((r["file_id"], r["above_id"], r["node_id"]) for r in tree.descendants(n, n.where("kind = 'D'")).collect())
    assert pairs == sorted((r["file_id"], a["node_id"], r["node_id"]) for r in forest for a in ancestors(forest, r) if a["kind"] == "D")


def test_blocks(spark, forest, monkeypatch):
    n = frame(spark, forest)
    got = {(r["file_id"], r["node_id"]): r["s"] for r in tree.running(n, F.when(F.col("kind") == "A", 1).otherwise(0), "sum", "s").collect()}
    for r in forest:
        assert got[r["file_id"], r["node_id"]] == sum(x["kind"] == "A" for x in forest if x["file_id"] == r["file_id"] and x["node_id"] <= r["node_id"])


def test_digest(spark):
    same = ("A", "x", [("B", "y", []), ("C", None, [])])
    rows = rows_of(("D", None, [same, same, ("A", "x", [("C", None, []), ("B", "y", [])])]))
    d = {r["node_id"]: r["digest"] for r in tree.subtree_digest(frame(spark, rows)).collect()}
    assert d[1] == d[4] and d[1] != d[7] and len(d) == len(rows)


def brute(rows, d, r):
    """A plain evaluator of conditions without metavariables."""
    target = lambda x: lambda y: brute(rows, {k: v for k, v in x.items() if k not in ("stopBy", "immediate")}, y)
    ok = True
    if "kind" in d:
        ok &= (r["kind"] or "").lower() == d["kind"].lower()
    if "regex" in d:
        import re

        ok &= bool(re.search(d["regex"], r["text"] or ""))
    if "any" in d:
        ok &= any(brute(rows, x, r) for x in d["any"])
    if "all" in d:
        ok &= all(brute(rows, x, r) for x in d["all"])
    if "not" in d:
        ok &= not brute(rows, d["not"], r)
    up = list(ancestors(rows, r))
    sib = siblings(rows, r)
    kids = [x for x in rows if x["file_id"] == r["file_id"] and x["parent_id"] == r["node_id"]]
    low = [x for x in rows if x["file_id"] == r["file_id"] and r["node_id"] < x["node_id"] <= r["last_id"]]
    for k, pool in (("inside", up), ("has", low)):
        for key, want in ((k, True), ("not" + k.capitalize(), False)):
            if key in d:
                p = (up[:1] if k == "inside" else kids) if d[key].get("stopBy") == "neighbor" else pool
                ok &= any(map(target(d[key]), p)) == want
    for k, sign in (("precedes", 1), ("follows", -1)):
        if k in d:
            p = [x for x in sib if (x["sib_idx"] - r["sib_idx"]) * sign > 0 and (not d[k].get("immediate") or abs(x["sib_idx"] - r["sib_idx"]) == 1)]
            ok &= any(map(target(d[k]), p))
    return ok


CONDITIONS = [
    {"kind": "a"}, {"kind": "B", "regex": "x"}, {"any": [{"kind": "A"}, {"kind": "C", "regex": "^y$"}]}, {"not": {"kind": "D"}},
    {"kind": "A", "inside": {"kind": "B"}, "notHas": {"kind": "C"}}, {"kind": "B", "has": {"kind": "A", "stopBy": "neighbor"}}, {"notInside": {"kind": "B"}, "precedes": {"kind": "A"}},
    {"all": [{"inside": {"kind": "C"}}, {"not": {"has": {"kind": "B"}}}]}, {"any": [{"follows": {"kind": "A", "immediate": True}}, {"kind": "D", "inside": {"kind": "D", "stopBy": "neighbor"}}]},
]


@pytest.mark.parametrize("d", CONDITIONS, ids=str)
def test_rule_conditions(spark, forest, d):
    n = frame(spark, forest)
    want = expect(forest, lambda r: brute(forest, d, r))
    assert keys(rl.matching(n, d, "*")) == want
    assert keys(rl.scan(n, [Rule("r", "*", "m", d)])) == want


def test_scan_options(spark):
    n = frame(spark, rows_of(("A", None, [("B", "x", []), ("B", "y", [])])))
    text = """
id: one
language: universal
severity: error
message: found $V and $VV
fix: f($V)
rule: {pattern: $V, kind: B}
constraints: {V: {regex: x}}
---
- {id: two, language: go, message: m, rule: {kind: B}}
- {id: three, language: python, severity: hint, message: m, rule: {kind: A}}
"""
    rules = parse_rules(text)
    rows = {r["rule_id"]: r for r in rl.scan(n, rules).collect()}
    assert set(rows) == {"one", "three"}
    assert rows["one"]["message"] == "found x and $VV" and rows["one"]["fix"] == "f(x)" and rows["one"]["captures"] == {"V": "x"}
    assert {r["rule_id"] for r in rl.scan(n, rules, min_severity="warning").collect()} == {"one"}
    assert {r["rule_id"] for r in rl.scan(n, rules, min_severity="hint", exact=True).collect()} == {"three"}
    assert rl.scan(n, []).count() == 0 and rl.scan(n.limit(0), rules).count() == 0


def test_files_and_ignores(spark):
    n = frame(spark, rows_of(("A", None, []), 1) + rows_of(("A", None, []), 2))
    files = spark.createDataFrame([(1, "src/a.py"), (2, "src/gen/b.py")], "file_id bigint, path string")
    r = Rule("r", "*", "m", {"kind": "A"}, files=("src/**/*.py",), ignores=("**/gen/*",))
    assert keys(rl.scan(n, [r], files)) == [(1, 0)]


def test_bad_rules(spark):
    with pytest.raises(ValueError):
        parse_rules("id: x\nlanguage: go\nmessage: m")
    with pytest.raises(ValueError):
        rl.checked_regex("(?=x)")
    n = frame(spark, rows_of(("A", None, [])))
    with pytest.raises(ValueError):
        rl.matching(n, {"inside": {}}, "*")
