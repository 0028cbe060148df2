"""Hot keys, snapshots and nested records on small tables with every kind of dirt."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from thicket.operators import hot_keys, nested, snapshots
from thicket.plans import table_queries


def ranked(values, p):
    v = sorted(values)
    return v[max(1, -(-p * len(v) // 100)) - 1] if v else None


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [("hot", rng.choice([-(2**31), 2**31 - 1, 0, rng.randint(-9, 9), rng.randint(-(10**9), 10**9)]), "x") for _ in range(600)]
    rows += [(rng.choice(["a", "b", "", None]), rng.choice([None, 5, 5, 7]), None) for _ in range(100)] + [("null only", None, "y")] * 40
    return spark.createDataFrame(rows, "k string, v int, key_value string").select("k", "v", "key_value"), rows


def test_profile(skewed):
    df, rows = skewed
    got = {r["key_value"]: r for r in hot_keys.profile(df.select("k", "v"), ["k"], "v").collect()}
    assert set(got) == {r[0] for r in rows}
    for k in got:
        values = [v for q, v, _ in rows if q == k]
        real = [v for v in values if v is not None]
        assert (got[k]["n_rows"], got[k]["n_valued"]) == (len(values), len(real))
        assert [got[k][f"q{p}"] for p in (25, 50, 75)] == [ranked(real, p) for p in (25, 50, 75)]


def test_heavy(skewed):
    df, rows = skewed
    got = {r["key_value"]: r for r in hot_keys.heavy(df, ["k"], "v", 0.04).collect()}
    counts = Counter(r[0] for r in rows)
    assert set(got) == {k for k, n in counts.items() if k is not None and n >= 0.04 * len(rows)} and "null only" in got
    real = [v for k, v, _ in rows if k == "hot"]
    assert [got["hot"][f"q{p}"] for p in (25, 50, 75)] == [ranked(real, p) for p in (25, 50, 75)]
    assert got["null only"]["q50"] is None
    assert hot_keys.heavy(df.limit(0), ["k"], "v", 0.04).count() == 0 and hot_keys.profile(df.limit(0), ["k"], "v").count() == 0


def test_distinct_and_categories(skewed):
    df, rows = skewed
    got = {r["key_value"]: (r["n_rows"], r["n_distinct"]) for r in hot_keys.distinct_per_key(df, ["k"], {"v": F.col("v")}).collect()}
    for k in {r[0] for r in rows}:
        assert got[k] == (sum(r[0] == k for r in rows), len({v for q, v, _ in rows if q == k}))
    assert sum(r["n_rows"] for r in hot_keys.category_counts(df, ["k"], F.col("key_value")).collect()) == len(rows)


def test_plain_path(spark):
    want = {"a/b": "a/b", "./a//b/": "a/b", "a\\.\\b": "a/b", "": "", "./.": "", None: None, "a/../b": "a/../b", ".a/b.": ".a/b."}
    df = spark.createDataFrame([(k,) for k in want], "p string")
    assert {r["p"]: r["q"] for r in df.select("p", snapshots.plain_path(F.col("p")).alias("q")).collect()} == want


def test_snapshot_differences(spark):
    rows = [(1, "a", 1), (1, "b", 1), (1, "c", 1), (2, "a", 1), (2, "b", 2), (2, "d", 1), (4, "a", 1), (5, "z", 1)]
    df = spark.createDataFrame([(n, k, str(v)) for n, k, v in rows], "no int, k string, digest string")
    got = sorted((r["from_no"], r["to_no"], r["k"], r["change"]) for r in snapshots.diff_snapshots(df, "no", ["k"]).collect())
    assert got == [(1, 2, "b", "changed"), (1, 2, "c", "removed"), (1, 2, "d", "added"), (4, 5, "a", "removed"), (4, 5, "z", "added")]
    assert snapshots.diff_snapshots(df.limit(0), "no", ["k"]).count() == 0


def test_latest_rows_and_hashes(spark):
    rows = [("k", 1, "old", None), ("k", 3, "new", "x"), ("k", 3, "new", "x"), ("k", None, "null time", None), ("t", 1, "a", None), ("t", 1, "b", None)]
    df = spark.createDataFrame(rows, "k string, at int, v string, w string")
    h = snapshots.canonical_hash([F.col("v"), F.col("w")])
    got = {r["k"]: r["digest"] for r in snapshots.latest_rows(df, {"k": F.col("k")}, F.col("at"), h).collect()}
    by = {(r["v"], r["w"]): r["h"] for r in df.select("v", "w", h.alias("h")).collect()}
    assert got["k"] == by["new", "x"] and got["t"] == max(by["a", None], by["b", None])
    # borders and nulls count
    pairs = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "x"), ("n", "x"), ("", None)], "a string, b string")
    assert pairs.select(snapshots.canonical_hash([F.col("a"), F.col("b")]).alias("h")).distinct().count() == 5


def test_finding_changes(spark, tmp_path):
    base = dict(taken_at=None, message="m", end_line=1, end_column=2, start_offset=0, end_offset=3, fix=None, captures={}, severity="error", rule_id="r", file_path="a/b.py", start_line=1, start_column=0)
    at = lambda n, hour, **kw: {**base, "snapshot_no": n, "ingested_at": f"2025-01-0{n} 0{hour}:00:00", **kw}
    rows = [at(1, 1), at(2, 1, severity="ERROR", message="m \t", fix=""), at(1, 1, start_line=2), at(2, 1, start_line=2, severity=None), at(1, 1, start_line=3, file_path="./a//b.py"), at(2, 1, start_line=3, file_path="a\\b.py", end_line=9), at(2, 2, start_line=3, file_path="a/b.py"), at(1, 1, rule_id=None), at(2, 1, file_path=None), at(2, 1, start_line=4)]
    cols = ["snapshot_no", "taken_at", "ingested_at", "rule_id", "severity", "message", "file_path", "start_line", "start_column", "end_line", "end_column", "start_offset", "end_offset", "fix"]
    df = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], "snapshot_no int, taken_at string, ingested_at string, rule_id string, severity string, message string, file_path string, start_line int, start_column int, end_line int, end_column int, start_offset int, end_offset int, fix string")
    df.withColumn("ingested_at", F.to_timestamp("ingested_at")).withColumn("digest", F.lit("clash")).write.parquet(str(tmp_path / "findings.parquet"))
    got = sorted((r["start_line"], r["change"]) for r in table_queries.p6_found(spark, str(tmp_path)).collect())
    assert got == [(2, "changed"), (4, "added")]


def label(tree):
    """Plain recursion over children: (node_no, parent_no, last_no, kind)."""
    out = []

    def walk(n, parent):
        no = len(out)
        out.append([no, parent, no, n.get("kind") or "Unknown"])
        c = n.get("children")
        for k in [c] if isinstance(c, dict) else c or []:
            if isinstance(k, dict):
                walk(k, no)
        out[no][2] = len(out) - 1

    walk(tree, -1)
    return [tuple(x) for x in out]


def random_doc(rng, depth=0):
    n = {"kind": rng.choice(["A", "B", None])} if rng.random() < 0.9 else {}
    n["properties"] = rng.choice([None, {}, {"x": 1, "children": [{"kind": "not a node"}]}])
    kids = [random_doc(rng, depth + 1) for _ in range(rng.randint(0, 3))] if depth < 5 else []
    kids = [k if rng.random() < 0.9 else None for k in kids]
    n["children"] = kids[0] if len(kids) == 1 and rng.random() < 0.5 else kids if kids or rng.random() < 0.5 else None
    return n


def test_nested_documents(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for t in range(30):
        docs = [random_doc(rng) for _ in range(3)]
        texts = [json.dumps({"root": d}) for d in docs]
        texts[1] = json.dumps(texts[1])
        rows += [(t, 1, texts[0]), (t, 2, texts[1]), (t, 2, texts[1]), (t, 3, texts[2][: len(texts[2]) - 1 - rng.randint(0, 5)]), (t, None, None), (t, 4, "[]"), (t, 5, '{"root": 3}'), (t, 6, "")]
        want[t] = label(docs[1])
    deep = {"kind": "Z"}
    for _ in range(500):
        deep = {"children": deep}
    rows.append((99, 1, json.dumps({"root": deep}) if False else "{\"root\":" + '{"children":' * 500 + '{"kind":"Z"}' + "}" * 500 + "}"))
    want[99] = label(deep)
    rows.append((100, 1, "nothing readable"))
    df = spark.createDataFrame(rows, "tree_id bigint, delivered_at int, doc string").withColumn("node_no", F.lit("clash"))
    got = nested.flat_nodes(df, "tree_id", F.col("delivered_at"), "doc", ("node_no", "parent_no", "last_no", "kind"))
    by = {}
    for r in got.collect():
        by.setdefault(r["tree_id"], []).append((r["node_no"], r["parent_no"], r["last_no"], r["kind"]))
    assert {k: sorted(v) for k, v in by.items()} == want
    assert nested.flat_nodes(df.limit(0), "tree_id", F.col("delivered_at"), "doc").count() == 0


def test_nested_tables(spark):
    doc = {"root": {"kind": "F", "nativeType": "f", "span": {"startLine": 1, "end_line": 2}, "properties": {"a": 1, "b": {"c": [1]}}, "children": {"kind": "G", "is_named": True, "children": [{"kind": "H"}]}}}
    df = spark.createDataFrame([(1, 1, json.dumps(doc))], "tree_id bigint, at int, doc string")
    n = nested.flat_nodes(df, "tree_id", F.col("at"), "doc")
    root = n.where("node_no = 0").first()
    assert (root["native_type"], root["start_line"], root["end_line"], root["post_no"]) == ("f", 1, 2, 2)
    assert {(r["property"], r["value"]) for r in nested.property_table(n, "tree_id").collect()} == {("a", "1"), ("b", '{"c": [1]}')}
    pairs = nested.within(nested.kind_table(n, "H"), nested.kind_table(n, "F"), "tree_id").collect()
    assert [(r["outer_no"], r["inner_no"]) for r in pairs] == [(0, 2)]


def test_share_is_inclusive(spark):
    df = spark.createDataFrame([("a", 1)] * 7 + [(f"o{i}", i) for i in range(168)], "k string, v int")
    assert [r["key_value"] for r in hot_keys.heavy(df, ["k"], "v", 0.04).collect()] == ["a"]


def test_record_delivered_very_often(spark):
    rows = [(1, "hot", i % 7, "x") for i in range(3000)] + [(2, "hot", 1, "y"), (1, "cold", 1, "z")]
    df = spark.createDataFrame(rows, "no int, k string, at int, v string")
    state = snapshots.latest_by_snapshot(df, F.col("no"), [1, 2], {"k": F.col("k")}, F.col("at"), snapshots.canonical_hash([F.col("v")]))
    got = {(r["k"], r["change"]) for r in snapshots.diff_snapshots(state, "snapshot_no", ["k"]).collect()}
    assert got == {("hot", "changed"), ("cold", "removed")}
    assert snapshots.latest_by_snapshot(df.limit(0), F.col("no"), [], {"k": F.col("k")}, F.col("at"), F.lit(b"")).count() == 0


def test_deep_documents(spark):
    depth = 100_000
    doc = '{"root":' + '{"kind":"A","children":[' * depth + '{"kind":"B","properties":{"x":[1,{"y":"z"}]},"span":{"startLine":9999999999}}' + "]}" * depth + "}"
    wrapped = doc
    for _ in range(5):
        wrapped = json.dumps(wrapped)
    df = spark.createDataFrame([(1, 1, wrapped), (2, 1, doc), (2, 2, doc[:-1]), (3, 1, '{"root": {"children": [')], "t bigint, at int, doc string")
    n = nested.flat_nodes(df, "t", F.col("at"), "doc", ("node_no", "parent_no", "last_no", "post_no", "kind", "properties", "start_line"))
    last = {r["t"]: r for r in n.where(f"node_no = {depth}").collect()}
    assert set(last) == {1, 2} and n.count() == 2 * (depth + 1)
    assert all((r["parent_no"], r["post_no"], r["kind"], r["start_line"]) == (depth - 1, 0, "B", 9999999999) for r in last.values())
    assert last[1]["properties"] == {"x": '[1, {"y": "z"}]'}


def test_deep_reader_agrees():
    rng = random.Random(5)

    def value(d=0):
        x = rng.random()
        if d > 4 or x < 0.4:
            return rng.choice([None, True, False, 0, -1.5e10, 12345678901234567890, "", 'a"\\\né', "]{"])
        return [value(d + 1) for _ in range(rng.randint(0, 3))] if x < 0.7 else {rng.choice("abc\n\""): value(d + 1) for _ in range(rng.randint(0, 3))}

    for _ in range(300):
        v = value()
        for text in (json.dumps(v), json.dumps(v, indent=1)):
            assert nested.read_deep(text) == v
            assert nested.write_deep(v) == json.dumps(v, ensure_ascii=False, sort_keys=True)
            for bad in (text[:-1], text + "]", text.replace(",", "", 1), text.replace(":", ",", 1)):
                try:
                    want = json.loads(bad)
                except ValueError:
                    with pytest.raises(ValueError):
                        nested.read_deep(bad)
                else:
                    assert nested.read_deep(bad) == want


def test_within_agrees_with_all_pairs(spark):
    rng = random.Random(12)
    rows = []
    for t in range(12):
        rows += [(t, n, last, rng.choice("FGH")) for n, _, last, _ in label(random_doc(rng))]
    rows += rows[:20]
    n = spark.createDataFrame(rows, "t int, node_no int, last_no int, kind string")
    for o, i in (("F", "G"), ("F", "F")):
        got = sorted((r["t"], r["outer_no"], r["inner_no"]) for r in nested.within(nested.kind_table(n, i), nested.kind_table(n, o), "t").collect())
        want = sorted({(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[3] == o and b[3] == i and a[1] < b[1] <= a[2]})
        assert got == want and got
    assert nested.within(n.limit(0), n.limit(0), "t").count() == 0
