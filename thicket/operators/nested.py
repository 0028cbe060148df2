"""Nested tree documents as flat tables.

Every node gets interval labels from one depth-first walk: `node_no` (pre-order, root 0) and
`last_no` (the last node below it); d lies below a exactly if a.node_no < d.node_no <= a.last_no in
the same tree. Tables of nodes, of one kind of node, and of properties are linked by these labels.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, ship

#: Output columns in order: name, Spark type.
FIELDS = {
    "node_no": T.IntegerType(),
    "parent_no": T.IntegerType(),
    "last_no": T.IntegerType(),
    "post_no": T.IntegerType(),
    "depth": T.IntegerType(),
    "sib_no": T.IntegerType(),
    "kind": T.StringType(),
    "language": T.StringType(),
    "native_type": T.StringType(),
    "is_named": T.BooleanType(),
    "name": T.StringType(),
    "text": T.StringType(),
    "start_line": T.LongType(),
    "start_column": T.LongType(),
    "end_line": T.LongType(),
    "end_column": T.LongType(),
    "properties": T.MapType(T.StringType(), T.StringType()),
}
SPELLINGS = {"native_type": ("nativeType", "native_type"), "is_named": ("isNamed", "is_named"), "start_line": ("startLine", "start_line"), "start_column": ("startColumn", "start_column"), "end_line": ("endLine", "end_line"), "end_column": ("endColumn", "end_column")}


_SCALAR = re.compile(r'[^\s,:\]}\["{]+')
_SPACE = re.compile(r"[ \t\n\r]*")


def read_json(text: str):
    """The value of a JSON text of any depth; ValueError if it isn't one.

    The standard reader is tried first; where nesting exceeds its recursion, the containers are kept
    on a list and only scalars are left to it.
    """
    try:
        return json.loads(text)
    except RecursionError:
        return read_deep(text)


def read_deep(text: str):
    """As read_json, without recursion."""
    top: list = []
    # (container, key that waits for its value)
    stack: list[list] = [[top, None]]
    at, want = 0, "value"
    n = len(text)

    def put(v) -> None:
        box, key = stack[-1]
        if isinstance(box, list):
            box.append(v)
        else:
            box[key] = v

    while True:
        at = _SPACE.match(text, at).end()
        if at >= n:
            break
        c = text[at]
        box = stack[-1][0]
        if want == "value" or want == "value or ]" and c != "]":
            if c in "{[":
                new: dict | list = {} if c == "{" else []
                put(new)
                stack.append([new, None])
                at, want = at + 1, "key or }" if c == "{" else "value or ]"
                continue
            if c == '"':
                v, at = json.decoder.scanstring(text, at + 1, True)
            else:
                m = _SCALAR.match(text, at)
                if m is None:
                    raise ValueError(f"no value at {at}")
                v, at = json.loads(m.group()), m.end()
            put(v)
            want = "comma"
        elif c == "]" and isinstance(box, list) and want in ("value or ]", "comma") and len(stack) > 1 or c == "}" and isinstance(box, dict) and want in ("key or }", "comma"):
            stack.pop()
            at, want = at + 1, "comma"
        elif want in ("key", "key or }") and c == '"':
            stack[-1][1], at = json.decoder.scanstring(text, at + 1, True)
            at = _SPACE.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            at, want = at + 1, "value"
        elif want == "comma" and c == "," and len(stack) > 1:
            at, want = at + 1, "key" if isinstance(box, dict) else "value"
        else:
            raise ValueError(f"unexpected {c!r} at {at}")
    if len(stack) > 1 or len(top) != 1:
        raise ValueError("the text ends early or late")
    return top[0]


def read_document(doc: str | None) -> dict | None:
    """The document as a dict with a `root` node, or None if it can't be read.

    A document wrapped as a JSON string, however often, is unwrapped.
    """
    value = doc
    while isinstance(value, str):
        try:
            value = read_json(value)
        except ValueError:
            return None
    return value if isinstance(value, dict) and isinstance(value.get("root"), dict) else None


def children_of(node: dict) -> list[dict]:
    """Child nodes in order: a list, or one node written without a list; nulls aren't nodes."""
    c = node.get("children")
    if isinstance(c, dict):
        return [c]
    return [x for x in c if isinstance(x, dict)] if isinstance(c, list) else []


def either(d: dict, name: str):
    for n in SPELLINGS.get(name, (name,)):
        if d.get(n) is not None:
            return d[n]
    return None


def as_text(v) -> str | None:
    if v is None or isinstance(v, str):
        return v
    try:
        return json.dumps(v, ensure_ascii=False, sort_keys=True)
    except RecursionError:
        return write_deep(v)


def write_deep(v) -> str:
    """As json.dumps with sorted keys, without recursion."""
    out: list[str] = []
    todo: list = [("value", v)]
    while todo:
        what, x = todo.pop()
        if what == "text":
            out.append(x)
        elif isinstance(x, dict):
            todo.append(("text", "}"))
            for i, k in reversed(list(enumerate(sorted(x)))):
                todo += [("value", x[k]), ("text", (", " if i else "") + json.dumps(k, ensure_ascii=False) + ": ")]
            out.append("{")
        elif isinstance(x, list):
            todo.append(("text", "]"))
            for i in range(len(x) - 1, -1, -1):
                todo += [("value", x[i]), ("text", ", " if i else "")]
            out.append("[")
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def as_int(v) -> int | None:
    """A whole number of up to 64 bits; anything else is null."""
    return v if isinstance(v, int) and not isinstance(v, bool) and -(2**63) <= v < 2**63 else None


def label(root: dict) -> list[tuple]:
    """(node, node_no, parent_no, last_no, post_no, depth, sib_no) in pre-order, without recursion."""
    out: list[list] = []
    post = 0
    stack: list[tuple] = [(root, -1, 0, 0)]
    while stack:
        node, parent, depth, sib = stack.pop()
        if node is None:  # the end of node `parent`
            out[parent][3], out[parent][4] = len(out) - 1, post
            post += 1
            continue
        no = len(out)
        out.append([node, no, parent, no, 0, depth, sib])
        stack.append((None, no, 0, 0))
        kids = children_of(node)
        stack.extend((k, no, depth + 1, i) for i, k in reversed(list(enumerate(kids))))
    return out


def node_values(entry: list, wanted: Sequence[str]) -> list:
    node, no, parent, last, post, depth, sib = entry
    fixed = {"node_no": no, "parent_no": parent, "last_no": last, "post_no": post, "depth": depth, "sib_no": sib}
    span = node.get("span") if isinstance(node.get("span"), dict) else {}
    row = []
    for w in wanted:
        if w in fixed:
            row.append(fixed[w])
        elif w == "kind":
            k = node.get("kind")
            row.append("Unknown" if k is None else as_text(k))
        elif w == "properties":
            p = node.get("properties")
            row.append([(str(k), as_text(v)) for k, v in p.items()] if isinstance(p, dict) else None)
        elif w == "is_named":
            v = either(node, w)
            row.append(v if isinstance(v, bool) else None)
        elif w in ("start_line", "start_column", "end_line", "end_column"):
            row.append(as_int(either(span, w)))
        else:
            row.append(as_text(either(node, w)))
    return row


ARROW = {"IntegerType": pa.int32(), "LongType": pa.int64(), "StringType": pa.string(), "BooleanType": pa.bool_(), "MapType": pa.map_(pa.string(), pa.string())}
BATCH = 5_000


def latest_readable(trees: DataFrame, key: str, order: Column, doc: str) -> DataFrame:
    """Per key the latest document that can be read: columns key and doc.

    Ties on `order` go to the greatest text, a null order comes first; null keys form one tree. The
    maximum is merged map-side, so a tree delivered very often sends one document per task.
    """
    ship(trees.sparkSession)
    readable = F.pandas_udf(lambda s: s.map(lambda d: read_document(d) is not None).astype(bool), T.BooleanType())
    rows = trees.select(F.col(key).alias("_key"), order.alias("_order"), F.col(doc).alias("_doc"))
    good = rows.where(readable("_doc"))
    best = good.groupBy("_key").agg(F.max(F.struct("_order", "_doc")).alias("_best"))
    return best.select(F.col("_key").alias(key), F.col("_best._doc").alias(doc))


def explode_nodes(docs: DataFrame, key: str, doc: str, columns: Sequence[str] = tuple(FIELDS)) -> DataFrame:
    """One row per node of every document: `key` and the wanted `columns` (any of FIELDS).

    Rows leave in batches, so a huge document doesn't hold all its rows at once. An unreadable
    document has no row; a missing or null kind is `Unknown`.
    """
    ship(docs.sparkSession)
    wanted = list(columns)
    schema = T.StructType([docs.schema[key], *(T.StructField(c, FIELDS[c]) for c in wanted)])
    kinds = [ARROW[type(FIELDS[c]).__name__] for c in wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, kind = b.column(0), b.column(1), b.schema.field(0).type
            keys: list = []
            cells: list[list] = [[] for _ in wanted]

            def flush() -> pa.RecordBatch:
                arrays = [pa.array(keys, kind), *(pa.array(c, k) for c, k in zip(cells, kinds))]
                out = pa.RecordBatch.from_arrays(arrays, names=[key, *wanted])
                keys.clear()
                for c in cells:
                    c.clear()
                return out

            for i in range(b.num_rows):
                d = read_document(texts[i].as_py())
                if d is None:
                    continue
                k = ids[i].as_py()
                for entry in label(d["root"]):
                    keys.append(k)
                    for c, v in zip(cells, node_values(entry, wanted)):
                        c.append(v)
                    if len(keys) >= BATCH:
                        yield flush()
            if keys:
                yield flush()

    return docs.select(key, doc).mapInArrow(run, schema)


def flat_nodes(trees: DataFrame, key: str, order: Column, doc: str, columns: Sequence[str] = tuple(FIELDS)) -> DataFrame:
    """Nodes of the latest readable delivery of each tree."""
    return explode_nodes(latest_readable(trees, key, order, doc), key, doc, columns)


def kind_table(nodes: DataFrame, kind: str) -> DataFrame:
    """The flat table of one kind of node."""
    return nodes.where(F.col("kind") == kind)


def property_table(nodes: DataFrame, key: str) -> DataFrame:
    """One row per node and property: key, node_no, property, value (JSON text for nested values)."""
    return nodes.select(key, "node_no", F.explode("properties").alias("property", "value"))


#: Numbers of one block of a running aggregate are 2**BLOCK_BITS.
BLOCK_BITS = 16


def nearest_around(outer: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """key, node_no, outer_no: the innermost interval (outer_no, _last) that properly holds each node.

    The intervals of a tree are nested or apart. Their beginnings and ends are summed up along the
    numbers, which gives every node the count of intervals open at it and every interval its depth;
    the innermost open interval is the latest one of just that depth. Both running aggregates work in
    blocks of numbers with a prefix over the blocks, so no tree is gathered in one task.
    """
    rows = outer.select(key, F.col("outer_no").alias("_at"), F.lit(2).alias("_rank"), F.lit(1).alias("_step"), F.col("outer_no").alias("_own"))
    rows = rows.unionByName(outer.select(key, (F.col("_last") + 1).alias("_at"), F.lit(0).alias("_rank"), F.lit(-1).alias("_step"), F.lit(None).cast("int").alias("_own")))
    rows = rows.unionByName(nodes.select(key, F.col("node_no").alias("_at"), F.lit(1).alias("_rank"), F.lit(0).alias("_step"), F.lit(None).cast("int").alias("_own")))
    rows = rows.withColumn("_block", F.shiftright("_at", BLOCK_BITS))
    so_far = (Window.unboundedPreceding, Window.currentRow)

    def prefix(of: DataFrame, by: list[str], fn, value: str, name: str) -> DataFrame:
        blocks = of.groupBy(*by, "_block").agg(fn(value).alias("_all"))
        before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.select(*by, "_block", fn("_all").over(before).alias("_before"))
        inside = Window.partitionBy(*by, "_block").orderBy("_at", "_rank").rowsBetween(*so_far)
        return of.withColumn(name, fn(value).over(inside)).join(blocks, [*by, "_block"])

    deep = prefix(rows, [key], F.sum, "_step", "_in").withColumn("_open", F.col("_in") + F.coalesce("_before", F.lit(0)))
    deep = deep.where("_rank > 0 and _open > 0").select(key, "_at", "_rank", "_own", "_block", "_open")
    got = prefix(deep, [key, "_open"], F.max, "_own", "_top")
    return got.where("_rank = 1").select(key, F.col("_at").alias("node_no"), F.greatest("_top", "_before").alias("outer_no"))


def within(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """Pairs (outer_no, inner_no) of nodes of the same tree in which inner lies below outer.

    Every inner and outer node finds the innermost outer interval around it (`nearest_around`). The
    links between outer nodes are closed by doubling (log2 of their depth joins), and each inner node
    takes its nearest outer node and those above it. The work is that of the inputs and the result.
    Repeated rows count once; null keys and empty tables give no row.
    """
    o = outer.select(F.col(key), F.col("node_no").alias("outer_no"), F.col("last_no").alias("_last")).where(F.col(key).isNotNull()).distinct()
    i = inner.select(F.col(key), "node_no").where(F.col(key).isNotNull()).distinct()
    # links of exactly 2**k steps, and all of at most that many
    exact = cut(nearest_around(o, o.select(key, F.col("outer_no").alias("node_no")), key).select(key, F.col("node_no").alias("low"), F.col("outer_no").alias("high")))
    above = exact
    while True:
        step = exact.select(key, F.col("high").alias("_mid"), F.col("low"))
        further = step.join(above.select(key, F.col("low").alias("_mid"), "high"), [key, "_mid"]).select(key, "low", "high")
        exact = cut(step.join(exact.select(key, F.col("low").alias("_mid"), "high"), [key, "_mid"]).select(key, "low", "high"))
        above = cut(above.unionByName(further))
        if exact.isEmpty():
            break
    first = nearest_around(o, i, key)
    more = first.join(above.select(key, F.col("low").alias("outer_no"), "high"), [key, "outer_no"]).select(key, F.col("high").alias("outer_no"), F.col("node_no").alias("inner_no"))
    return first.select(key, "outer_no", F.col("node_no").alias("inner_no")).unionByName(more)
