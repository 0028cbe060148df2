"""Trees as tables: accessors, navigation and structural lookups over node rows.

Every lookup is an equi-join on (file_id, node) keys or a running aggregate in blocks of node numbers,
so the work is linear in the number of nodes and no file, however large, ends in one task. `file_id`
and `node_id` identify a node; node numbers are in pre-order, the root is 0. Joins of nodes with nodes
are merged: sizes told from the texts that nodes came from are far too small, and a broadcast that
grows with the nodes would have to fit the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

KEY = ["file_id", "node_id"]
#: Node numbers of one block of a running aggregate.
BLOCK = 1 << 16


def once(nodes: DataFrame) -> DataFrame:
    """One row per node; of repeated rows any may stay (they are equal in delivered tables)."""
    return nodes.dropDuplicates(KEY)


def resolve_up(nodes: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """file_id, node_id, `name`: the value of the node or else of its nearest ancestor that has one.

    Pointer doubling: every open node asks the node its pointer shows; that answers with its value
    or its own pointer, so a chain of n ancestors takes log2 n equi-joins. Null where none has one.
    """
    state = nodes.select(*KEY, value.alias("v"), F.col("parent_id").alias("up"))
    done = None
    while True:
        state = cut(state)
        closed = state.where("v is not null or up is null").select(*KEY, "v")
        done = closed if done is None else done.unionByName(closed)
        open_ = state.where("v is null and up is not null")
        if open_.isEmpty():
            return done.select(*KEY, F.col("v").alias(name))
        # answers come from all rows of this round, not only the open ones
        asked = done.select("file_id", F.col("node_id").alias("up"), F.col("v").alias("v2"), F.lit(None).cast("int").alias("up2"))
        asked = asked.unionByName(open_.select("file_id", F.col("node_id").alias("up"), F.col("v").alias("v2"), F.col("up").alias("up2")))
        state = open_.join(asked, ["file_id", "up"], "left").select(*KEY, F.col("v2").alias("v"), F.col("up2").alias("up"))


def with_intervals(nodes: DataFrame) -> DataFrame:
    """Adds `last_id`, the last node below each node: a lies above d if a.node_id < d.node_id <= a.last_id.

    A node with a next sibling ends before it; others end where their parent ends, the root at the
    last node of its file.
    """
    nxt = nodes.select("file_id", "parent_id", (F.col("sib_idx") - 1).alias("sib_idx"), (F.col("node_id") - 1).alias("_end")).where("parent_id is not null and sib_idx >= 0")
    size = nodes.groupBy("file_id").agg(F.max("node_id").alias("_size"))
    with_next = nodes.join(nxt, ["file_id", "parent_id", "sib_idx"], "left")
    roots = with_next.where("parent_id is null").join(size, "file_id").withColumn("_end", F.col("_size")).drop("_size")
    both = with_next.where("parent_id is not null").unionByName(roots)
    ends = resolve_up(both, F.col("_end"), "last_id")
    return nodes.join(ends, KEY)


def children(nodes: DataFrame, parents: DataFrame, named: bool = False) -> DataFrame:
    """Child rows of the nodes in `parents` (file_id, node_id), with parent_id; named ones only if asked."""
    keys = parents.select("file_id", F.col("node_id").alias("parent_id"))
    return (nodes.where("is_named") if named else nodes).join(keys, ["file_id", "parent_id"], "left_semi")


def child_by_field(nodes: DataFrame, parents: DataFrame, field: str) -> DataFrame:
    return children(nodes, parents).where(F.col("field") == field)


def parents(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """Distinct parents of the nodes in `of` (which must have parent_id)."""
    keys = of.select("file_id", F.col("parent_id").alias("node_id")).where("node_id is not null").distinct()
    return nodes.join(keys, KEY, "left_semi")


def siblings(nodes: DataFrame, step: int = 1) -> DataFrame:
    """file_id, node_id, sibling_id: the sibling `step` places after (before, if negative)."""
    other = nodes.select("file_id", "parent_id", (F.col("sib_idx") - step).alias("sib_idx"), F.col("node_id").alias("sibling_id"))
    return nodes.select(*KEY, "parent_id", "sib_idx").join(other, ["file_id", "parent_id", "sib_idx"]).select(*KEY, "sibling_id")


def walk(nodes: DataFrame, named: bool = False) -> DataFrame:
    """All nodes in pre-order."""
    return (nodes.where("is_named") if named else nodes).orderBy(*KEY)


def find_native(nodes: DataFrame, native_type: str) -> DataFrame:
    return nodes.where(F.col("native_type") == native_type)


def find_kinds(nodes: DataFrame, *kinds: str) -> DataFrame:
    """Nodes of any of the kinds, case ignored."""
    return nodes.where(F.lower("kind").isin(*(k.lower() for k in kinds)))


def nearest_ancestor(nodes: DataFrame, test: Column, proper: bool = True) -> DataFrame:
    """file_id, node_id, ancestor_id: the nearest ancestor that passes the test; nodes without one have no row."""
    hit = resolve_up(nodes, F.when(F.coalesce(test, F.lit(False)), F.col("node_id")), "ancestor_id")
    if proper:
        up = nodes.select("file_id", "node_id", "parent_id").where("parent_id is not null")
        hit = up.join(hit.withColumnRenamed("node_id", "parent_id"), ["file_id", "parent_id"]).select(*KEY, "ancestor_id")
    return hit.where("ancestor_id is not null")


def running(nodes: DataFrame, value: Column, how: str, name: str) -> DataFrame:
    """file_id, node_id, `name`: max or sum of `value` over the nodes before and including each in its file.

    Blocks of node numbers are aggregated first; a prefix over the blocks and a running aggregate
    inside each block are put together, so a window has BLOCK rows at most.
    """
    fn = {"max": F.max, "sum": F.sum}[how]
    rows = nodes.select(*KEY, value.alias("v"), F.shiftright("node_id", 16).alias("_block"))
    blocks = rows.groupBy("file_id", "_block").agg(fn("v").alias("_all"))
    before = Window.partitionBy("file_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file_id", "_block", fn("_all").over(before).alias("_before"))
    inside = Window.partitionBy("file_id", "_block").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.withColumn("_in", fn("v").over(inside)).join(blocks.hint("merge"), ["file_id", "_block"])
    total = F.greatest("_in", "_before") if how == "max" else F.coalesce("_in", F.lit(0)) + F.coalesce("_before", F.lit(0))
    return both.select(*KEY, total.alias(name))


def inside(nodes: DataFrame, test: Column) -> DataFrame:
    """file_id, node_id of the nodes that have a proper ancestor passing the test (`nodes` with last_id).

    A node lies in an earlier node exactly if that one's interval reaches it, so the furthest reach of
    the passing nodes before it decides.
    """
    reach = running(nodes, F.when(F.coalesce(test, F.lit(False)), F.col("last_id")), "max", "_reach")
    # the reach before the node: that of the node numbered one less
    prev = reach.select("file_id", (F.col("node_id") + 1).alias("node_id"), "_reach")
    return nodes.select(*KEY).join(prev.hint("merge"), KEY).where("_reach >= node_id").select(*KEY)


def inside_parent(nodes: DataFrame, test: Column) -> DataFrame:
    """file_id, node_id of the nodes whose parent passes the test."""
    hit = nodes.where(test).select("file_id", F.col("node_id").alias("parent_id"))
    return nodes.join(hit, ["file_id", "parent_id"], "left_semi").select(*KEY)


def count_below(nodes: DataFrame, test: Column, name: str = "n_below") -> DataFrame:
    """file_id, node_id, `name`: proper descendants that pass the test, by prefix counts at both ends of the interval."""
    cum = running(nodes, F.when(F.coalesce(test, F.lit(False)), 1).otherwise(0), "sum", "_c")
    at_end = cum.select("file_id", F.col("node_id").alias("last_id"), F.col("_c").alias("_end"))
    both = nodes.select(*KEY, "last_id").join(cum.hint("merge"), KEY).join(at_end.hint("merge"), ["file_id", "last_id"])
    return both.select(*KEY, (F.col("_end") - F.col("_c")).alias(name))


def has(nodes: DataFrame, test: Column) -> DataFrame:
    """file_id, node_id of the nodes with a proper descendant passing the test (`nodes` with last_id)."""
    return count_below(nodes, test).where("n_below > 0").select(*KEY)


def has_child(nodes: DataFrame, test: Column) -> DataFrame:
    """file_id, node_id of the nodes with a child passing the test."""
    return nodes.where(test).where("parent_id is not null").select("file_id", F.col("parent_id").alias("node_id")).distinct()


def precedes(nodes: DataFrame, test: Column, immediate: bool = False) -> DataFrame:
    """file_id, node_id of the nodes with a later (the next) sibling passing the test."""
    return beside(nodes, test, immediate, 1)


def follows(nodes: DataFrame, test: Column, immediate: bool = False) -> DataFrame:
    """file_id, node_id of the nodes with an earlier (the previous) sibling passing the test."""
    return beside(nodes, test, immediate, -1)


def beside(nodes: DataFrame, test: Column, immediate: bool, step: int) -> DataFrame:
    hit = nodes.where(test).where("parent_id is not null")
    if immediate:
        keys = hit.select("file_id", "parent_id", (F.col("sib_idx") - step).alias("sib_idx"))
        return nodes.join(keys, ["file_id", "parent_id", "sib_idx"], "left_semi").select(*KEY)
    edge = (F.max if step > 0 else F.min)("sib_idx").alias("_edge")
    edges = hit.groupBy("file_id", "parent_id").agg(edge)
    later = F.col("sib_idx") < F.col("_edge") if step > 0 else F.col("sib_idx") > F.col("_edge")
    return nodes.select(*KEY, "parent_id", "sib_idx").join(edges, ["file_id", "parent_id"]).where(later).select(*KEY)


def descendants(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """above_id, file_id, node_id: proper descendants of the nodes in `above` (file_id, node_id).

    Follows the child links level by level from the given nodes, so only their own subtrees are read.
    """
    links = nodes.where("parent_id is not null").select("file_id", F.col("parent_id").alias("_up"), "node_id")
    level = above.select("file_id", F.col("node_id").alias("above_id"), F.col("node_id").alias("_up"))
    out = None
    while True:
        level = cut(level.join(links, ["file_id", "_up"]).select("file_id", "above_id", F.col("node_id").alias("_up")))
        if level.isEmpty():
            return out if out is not None else level.select("file_id", "above_id", F.col("_up").alias("node_id"))
        found = level.select("file_id", "above_id", F.col("_up").alias("node_id"))
        out = found if out is None else out.unionByName(found)


def node_at(nodes: DataFrame, start: Column, end: Column) -> DataFrame:
    """First node in pre-order of each file with exactly this byte range."""
    return nodes.where((F.col("start_offset") == start) & (F.col("end_offset") == end)).groupBy("file_id").agg(F.min("node_id").alias("node_id"))


def has_error(files: DataFrame, errors: DataFrame) -> DataFrame:
    """file_id, has_error: whether a file has a parse error."""
    bad = errors.select("file_id").distinct().withColumn("_e", F.lit(True))
    return files.select("file_id").distinct().join(bad, "file_id", "left").select("file_id", F.coalesce("_e", F.lit(False)).alias("has_error"))


def is_error(native_type: Column) -> Column:
    return native_type.isin("ERROR", "MISSING") | F.coalesce(native_type.startswith("MISSING"), F.lit(False))


def is_comment(native_type: Column) -> Column:
    return native_type.isin("comment", "line_comment", "block_comment", "doc_comment") | native_type.endswith("_comment")


def is_string(native_type: Column) -> Column:
    return native_type.isin("string", "string_literal", "template_string", "raw_string_literal") | native_type.endswith("_string") | native_type.endswith("_string_literal")


def node_text(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, node_id, source: the bytes of each node cut from its file's text (null out of range)."""
    raw = files.select("file_id", F.encode("content", "utf-8").alias("_raw"))
    both = nodes.select(*KEY, "start_offset", "end_offset").join(raw, "file_id")
    piece = F.substring(F.col("_raw"), F.col("start_offset") + 1, F.greatest(F.col("end_offset") - F.col("start_offset"), F.lit(0)))
    return both.select(*KEY, F.decode(piece, "utf-8").alias("source"))


def subtree_digest(nodes: DataFrame) -> DataFrame:
    """file_id, node_id, digest: equal digests mean structurally equal subtrees (kind, text, name, order of children).

    Levels are folded from the deepest up. The children of a node are merged by two exclusive-or sums of
    hashes of (place, digest) and their number, map-side, so that a node with very many children is no
    hot group.
    """
    own = F.concat_ws("|", F.coalesce("kind", F.lit("")), *(F.coalesce(F.concat(F.lit("v"), F.length(c), F.lit(":"), F.col(c)), F.lit("n")) for c in ("text", "name")))
    rows = nodes.select(*KEY, "parent_id", "sib_idx", "depth", own.alias("_own"))
    deepest = rows.agg(F.max("depth")).first()[0]
    done, below = None, None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        at = rows.where(F.col("depth") == level)
        if below is not None:
            sums = [F.bit_xor(F.xxhash64(F.lit(salt), "sib_idx", "digest")) for salt in ("a", "b")]
            folded = below.groupBy("file_id", "parent_id").agg(F.concat_ws(",", F.count(F.lit(1)), *sums).alias("_kids"))
            at = at.join(folded.withColumnRenamed("parent_id", "node_id"), KEY, "left")
        else:
            at = at.withColumn("_kids", F.lit(None).cast("string"))
        below = cut(at.select(*KEY, "parent_id", "sib_idx", F.sha2(F.concat_ws("/", "_own", F.coalesce("_kids", F.lit(""))), 256).alias("digest")))
        part = below.select(*KEY, "digest")
        done = part if done is None else done.unionByName(part)
    return done if done is not None else rows.select(*KEY, F.lit("").alias("digest"))
