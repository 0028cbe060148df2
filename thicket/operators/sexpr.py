"""S-expression queries over node tables: nested node patterns, fields, captures, predicates.

A query is parsed to a small tree and compiled to parent-child joins, one per pattern node; the
children of a pattern match children in the order written, others may stand between.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from . import patterns as pt


class QueryError(ValueError):
    """A query that can't be read; says what, in which row and column (0-based)."""

    def __init__(self, what: str, text: str, at: int):
        row = text.count("\n", 0, at)
        super().__init__(f"{what} at row {row}, column {at - (text.rfind(chr(10), 0, at) + 1)}")
        self.what, self.row, self.column = what, row, at - (text.rfind("\n", 0, at) + 1)


@dataclass
class Node:
    """One pattern node: types (None: any), named only, field in the parent, captures, children, quantifier."""

    types: list[str] | None = None
    named: bool = False
    text: str | None = None
    role: str | None = None
    captures: list[str] = field(default_factory=list)
    children: list["Node"] = field(default_factory=list)
    quantifier: str = ""
    anchor_before: bool = False
    anchor_last: bool = False
    without: list[str] = field(default_factory=list)


@dataclass
class Query:
    patterns: list[tuple[Node, list[tuple[str, list[str]]]]]

    def capture_names(self) -> list[str]:
        out: list[str] = []

        def walk(n: Node) -> None:
            out.extend(n.captures)
            for c in n.children:
                walk(c)

        for n, _ in self.patterns:
            walk(n)
        return list(dict.fromkeys(out))


TOKEN = re.compile(r"\s+|;[^\n]*|(?P<open>[(\[])|(?P<close>[)\]])|(?P<capture>@[\w.-]+)|(?P<predicate>#[\w.-]+[?!])|(?P<string>\"(?:\\.|[^\"\\])*\")|(?P<field>[A-Za-z_]\w*:)|(?P<without>![A-Za-z_]\w*)|(?P<name>[A-Za-z_][\w./-]*)|(?P<quantifier>[*+?])|(?P<anchor>\.)|(?P<bad>.)", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


def unquote(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m.group(1), m.group(1)), s[1:-1])


def quote(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def parse(text: str) -> Query:
    toks = [(m.lastgroup, m.group(), m.start()) for m in TOKEN.finditer(text) if m.lastgroup]
    pos = 0

    def peek():
        return toks[pos] if pos < len(toks) else (None, "", len(text))

    def take(kind: str | None = None):
        nonlocal pos
        t = peek()
        if t[0] is None or t[0] == "bad" or (kind and t[0] != kind):
            raise QueryError("unexpected end" if t[0] is None else f"unexpected {t[1]!r}", text, t[2])
        pos += 1
        return t

    def suffix(n: Node) -> Node:
        while peek()[0] in ("quantifier", "capture"):
            k, v, _ = take()
            if k == "quantifier":
                n.quantifier = v
            else:
                n.captures.append(v[1:])
        return n

    def one(preds: list) -> Node:
        kind, value, at = peek()
        name = None
        if kind == "field":
            take()
            name = value[:-1]
            kind, value, at = peek()
        if kind == "open" and value == "[":
            take()
            types: list[str] = []
            while peek()[1] != "]":
                alt = one(preds)
                if alt.children or alt.types is None or alt.role:
                    raise QueryError("only plain types may stand in brackets", text, at)
                types.extend(alt.types)
            take("close")
            n = Node(types)
        elif kind == "open":
            take()
            n = group(preds)
        elif kind == "string":
            take()
            n = Node([unquote(value)])
        elif kind == "name" and value == "_":
            take()
            n = Node(None)
        else:
            raise QueryError(f"unexpected {value!r}" if kind else "unexpected end", text, at)
        n.role = name
        return suffix(n)

    def group(preds: list) -> Node:
        kind, value, at = take()
        if kind != "name":
            raise QueryError(f"unexpected {value!r}", text, at)
        n = Node(None, named=True) if value == "_" else Node([value], named=True)
        anchor = False
        while True:
            k, v, _ = peek()
            if k == "close" and v == ")":
                take()
                n.anchor_last = anchor
                return n
            if k == "anchor":
                take()
                anchor = True
            elif k == "without":
                take()
                n.without.append(v[1:])
            elif k == "open" and v == "(" and pos + 1 < len(toks) and toks[pos + 1][0] == "predicate":
                predicate(preds)
            else:
                c = one(preds)
                c.anchor_before, anchor = anchor, False
                n.children.append(c)

    def predicate(preds: list) -> None:
        take("open")
        name = take("predicate")[1]
        args = []
        while peek()[1] != ")":
            k, v, at = take()
            if k not in ("capture", "string", "name"):
                raise QueryError(f"unexpected {v!r}", text, at)
            args.append(unquote(v) if k == "string" else v)
        take("close")
        preds.append((name, args))

    out = []
    while pos < len(toks):
        preds: list[tuple[str, list[str]]] = []
        if peek()[1] == "(" and pos + 1 < len(toks) and toks[pos + 1][0] == "open":
            take("open")  # a group around a pattern and its predicates
            n = one(preds)
            while peek()[1] != ")":
                predicate(preds)
            take("close")
            suffix(n)
        elif peek()[1] == "(" and pos + 1 < len(toks) and toks[pos + 1][0] == "predicate":
            if not out:
                raise QueryError("a predicate needs a pattern", text, peek()[2])
            predicate(out[-1][1])
            continue
        else:
            n = one(preds)
        out.append((n, preds))
    if not out:
        raise QueryError("empty query", text, 0)
    return Query(out)


def type_test(n: Node) -> Column:
    out = F.lit(True) if n.types is None else F.col("native_type").isin(*n.types)
    return out & F.coalesce(F.col("is_named"), F.lit(True)) if n.named and n.types is None else out


FIELDS = ("node_id", "native_type", "name", "text", *schema.SPAN)


def part_of(name: str):
    return lambda v: v[name]


def entry_of(name: str):
    return lambda v: F.struct(F.lit(name).alias("capture"), *(v[f].alias(f) for f in FIELDS))


def later_than(place: Column):
    return lambda v: F.coalesce(v["s"] > place, F.lit(True))


def earlier_than(place: Column):
    return lambda v: v["s"] < place


def match_rows(nodes: DataFrame, q: Node) -> tuple[DataFrame, list[str]]:
    """Rows of matches of one pattern: file_id, _n0 (root), capture columns (structs, or arrays for * and +)."""
    has_field = "field" in nodes.columns
    counter = [0]

    def build(n: Node) -> tuple[DataFrame, str, list[str]]:
        at = f"_n{counter[0]}"
        counter[0] += 1
        row = F.struct(*FIELDS)
        rows = nodes.where(type_test(n))
        rows = rows.select("file_id", F.col("node_id").alias(at), F.col("parent_id").alias(f"{at}_up"), F.col("sib_idx").alias(f"{at}_sib"), (F.col("field") if has_field else F.lit(None).cast("string")).alias(f"{at}_field"), F.col("child_count").alias(f"{at}_size"), *(row.alias(f"@{c}") for c in n.captures))
        names = [f"@{c}" for c in n.captures]
        for name in n.without:
            there = nodes.where(F.col("field") == name).select("file_id", F.col("parent_id").alias(at)) if has_field else None
            rows = rows if there is None else rows.join(there, ["file_id", at], "left_anti")
        # place of the item before (a single child, or the first of a repeated one), and the arrays that still lack an upper bound
        before, last, waiting = None, None, []
        arrays: dict[str, str] = {}
        for c in n.children:
            kid, k, kid_names = build(c)
            kid = kid.withColumnRenamed(f"{k}_up", at)
            if c.role:
                kid = kid.where(F.col(f"{k}_field") == c.role)
            if c.quantifier in ("*", "+"):
                # the children of the type after the item before, as one array in order
                item = F.struct(F.col(f"{k}_sib").alias("s"), *(F.col(x) for x in kid_names))
                grouped = kid.groupBy("file_id", at).agg(F.array_sort(F.collect_list(item)).alias(f"{k}_all"))
                rows = rows.join(grouped, ["file_id", at], "left")
                if before is not None:
                    rows = rows.withColumn(f"{k}_all", F.filter(f"{k}_all", later_than(before)))
                first = F.try_element_at(f"{k}_all", F.lit(1))["s"]
                if c.anchor_before:
                    start = F.coalesce(last, F.lit(-1)) + 1 if last is not None else F.lit(0)
                    rows = rows.withColumn(f"{k}_all", F.when(first == start, F.col(f"{k}_all")))
                if c.quantifier == "+":
                    rows = rows.where(F.coalesce(F.size(f"{k}_all"), F.lit(0)) > 0)
                    before = first  # an item that may be absent bounds nothing
                end = F.try_element_at(f"{k}_all", F.lit(-1))["s"]
                last = end if last is None else F.coalesce(end, last)
                waiting.append(f"{k}_all")
                arrays |= {x: f"{k}_all" for x in kid_names}
            else:
                rows = rows.join(kid, ["file_id", at], "left" if c.quantifier == "?" else "inner")
                here = F.col(f"{k}_sib")
                if before is not None:
                    rows = rows.where(here.isNull() | (here > before) | before.isNull())
                for w in waiting:
                    rows = rows.withColumn(w, F.when(here.isNull(), F.col(w)).otherwise(F.filter(w, earlier_than(here))))
                if c.anchor_before:
                    rows = rows.where(here.isNull() | (here == (F.lit(0) if last is None else F.coalesce(last, F.lit(-1)) + 1)))
                before = here if before is None else F.coalesce(here, before)
                last = here if last is None else F.coalesce(here, last)
                waiting = []
            names += kid_names
        if n.anchor_last and last is not None:
            rows = rows.where(last == F.col(f"{at}_size") - 1)
        for x, w in arrays.items():
            rows = rows.withColumn(x, F.transform(w, part_of(x)))
        return rows, at, names

    rows, _, names = build(q)
    return rows.select("file_id", "_n0", *dict.fromkeys(names)), list(dict.fromkeys(names))


def predicate_test(name: str, args: list[str]) -> Column:
    value = lambda a: F.coalesce(F.col(a)["text"], F.col(a)["name"], F.lit("")) if a.startswith("@") else F.lit(a)
    left, rest = value(args[0]), args[1:]
    if name in ("#eq?", "#not-eq?"):
        out = left == value(rest[0])
    elif name in ("#match?", "#not-match?"):
        out = left.rlike(rest[0])
    elif name in ("#any-of?", "#not-any-of?"):
        out = left.isin(*rest)
    elif name.endswith("!"):
        return F.lit(True)  # a directive; it takes no row away
    else:
        raise QueryError(f"unknown predicate {name}", "", 0)
    return ~out if "not-" in name else out


def run(nodes: DataFrame, text: str | Query) -> DataFrame:
    """file_id, node_id, pattern_index, captures (capture, node_id, name, text, span): one row per match.

    Captures are in the order of the query; a repeated capture has an entry for each node. Matches
    without any capture are left out.
    """
    q = parse(text) if isinstance(text, str) else text
    out = None
    for i, (n, preds) in enumerate(q.patterns):
        rows, names = match_rows(nodes, n)
        if not names:
            continue
        for name, args in preds:
            rows = rows.where(predicate_test(name, args))
        kinds = dict(rows.dtypes)
        parts = []
        for c in names:
            make = entry_of(c[1:])
            parts.append(F.coalesce(F.transform(c, make), F.array()) if kinds[c].startswith("array") else F.when(F.col(c).isNull(), F.array()).otherwise(F.array(make(F.col(c)))))
        one = rows.select("file_id", F.col("_n0").alias("node_id"), F.lit(i).alias("pattern_index"), F.concat(*parts).alias("captures")).where(F.size("captures") > 0)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise QueryError("no pattern has a capture", text if isinstance(text, str) else "", 0)
    return out


def root_nodes(nodes: DataFrame, text: str) -> DataFrame:
    """file_id, node_id of the roots of a query's matches, with or without captures."""
    out = None
    for n, preds in parse(text).patterns:
        rows, _ = match_rows(nodes, n)
        for name, args in preds:
            rows = rows.where(predicate_test(name, args))
        one = rows.select("file_id", F.col("_n0").alias("node_id"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def from_pattern(p: pt.Pattern, language: str = "*", capture: str = "match") -> str:
    """Query text of a pattern: kinds become brackets of all their native types; `not` can't be said."""
    if isinstance(p, pt.Kind):
        types = schema.natives_of(p.kind, language)
        return (f"({types[0]})" if len(types) == 1 else "[" + " ".join(f"({t})" for t in types) + "]") + f" @{capture}"
    if isinstance(p, pt.Native):
        return f"({p.native_type}) @{capture}"
    if isinstance(p, pt.Meta):
        return f"(_){('*' if p.least == 0 else '+') if p.many else ''} @{(p.name or capture).lower()}"
    if isinstance(p, (pt.Wild, pt.Literal)):
        return f"(_) @{capture}" + (f" (#eq? @{capture} {quote(str(p.value))})" if isinstance(p, pt.Literal) else "")
    if isinstance(p, pt.Query):
        return p.text
    if isinstance(p, pt.AnyOf):
        return "\n".join(from_pattern(x, language, capture) for x in p.parts)
    if isinstance(p, pt.Structure):
        kind = schema.natives_of(p.kind, language)[0] if p.kind else "_"
        kids = " ".join(from_pattern(c, language, f"c{i}") for i, c in enumerate(p.children or ()))
        return f"({kind}{' ' + kids if kids else ''}) @{capture}"
    raise pt.PatternError("this pattern has no query")
