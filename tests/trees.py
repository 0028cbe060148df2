"""Small node tables for tests."""

from pyspark.sql import SparkSession

from thicket import schema


def rows_of(tree, file_id=1, language="python"):
    """Rows of a nested tuple (kind, text, [children]) in pre-order, as dicts."""
    out = []

    def walk(t, parent, sib, depth):
        kind, text, kids = t
        no = len(out)
        out.append({"file_id": file_id, "node_id": no, "parent_id": parent, "sib_idx": sib, "depth": depth, "last_id": no, "language": language, "kind": kind, "native_type": kind and kind.lower(), "is_named": True, "name": None, "text": text, "field": None, **{c: no for c in schema.SPAN}, "child_count": len(kids), "properties": {}})
        for i, k in enumerate(kids):
            walk(k, no, i, depth + 1)
        out[no]["last_id"] = len(out) - 1

    walk(tree, None, 0, 0)
    return out


def frame(spark: SparkSession, rows):
    return spark.createDataFrame([tuple(r[c] for c in schema.NODES.names) for r in rows], schema.NODES)


def keys(df):
    return sorted((r["file_id"], r["node_id"]) for r in df.select("file_id", "node_id").collect())


def random_tree(rng, size, kinds=("A", "B", "C", "D")):
    nodes = [[rng.choice(kinds), rng.choice(("x", "y", None)), []]]
    for _ in range(size - 1):
        at = rng.choice(nodes[-6:]) if rng.random() < 0.6 else rng.choice(nodes)
        kid = [rng.choice(kinds), rng.choice(("x", "y", None)), []]
        at[2].append(kid)
        nodes.append(kid)
    return nodes[0]
