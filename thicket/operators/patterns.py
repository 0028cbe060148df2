"""The pattern language: one-token patterns, structural patterns and child sequences.

A pattern is parsed on the driver into a small tree of dataclasses. What only looks at the node itself
becomes a Column; sequences of children and back-references work on arrays of the children's rows,
collected per candidate parent after the node's own tests.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..session import ship
from .tree import KEY

#: Characters that begin a metavariable.
PREFIXES = "$§∀"


class PatternError(ValueError):
    """A pattern that can't be read."""


@dataclass(frozen=True)
class Pattern:
    pass


@dataclass(frozen=True)
class Kind(Pattern):
    kind: str


@dataclass(frozen=True)
class Native(Pattern):
    native_type: str
    language: str = "*"


@dataclass(frozen=True)
class Meta(Pattern):
    """A metavariable; least is 1 for one node or one and more, 0 for any number; many for sequences."""

    name: str | None
    many: bool = False
    least: int = 1
    kind: str | None = None


@dataclass(frozen=True)
class Wild(Pattern):
    pass


@dataclass(frozen=True)
class Literal(Pattern):
    value: object


@dataclass(frozen=True)
class Query(Pattern):
    text: str


@dataclass(frozen=True)
class Structure(Pattern):
    """Kind, properties and child sequence; not `exact` allows further children at the end."""

    kind: str | None = None
    properties: dict = field(default_factory=dict)
    children: tuple[Pattern, ...] | None = None
    exact: bool = True

    def __hash__(self) -> int:
        return hash((self.kind, tuple(sorted(self.properties.items())), self.children))


@dataclass(frozen=True)
class AnyOf(Pattern):
    parts: tuple[Pattern, ...]


@dataclass(frozen=True)
class AllOf(Pattern):
    parts: tuple[Pattern, ...]


@dataclass(frozen=True)
class Not(Pattern):
    part: Pattern


META = re.compile(rf"([{PREFIXES}]+)([A-Za-z_][A-Za-z0-9_]*)?")


def parse(text: str, language: str = "*") -> Pattern:
    """Read a one-token pattern; the first form that fits counts.

    A metavariable with anything behind it, or text with blanks or brackets, is code: it is read by the
    language's front end (see `code_pattern`), and refused where there is none rather than matched to
    everything.
    """
    s = text.strip()
    if not s:
        raise PatternError("empty pattern")
    if s[0] in PREFIXES:
        m = META.match(s)
        if not m.group(2):
            raise PatternError(f"metavariable without a name: {s}")
        if m.end() != len(s):
            return code_pattern(s, language)
        n, name = len(m.group(1)), m.group(2)
        return Meta(None if name == "_" else name, n > 1, 0 if n > 2 else 1)
    if s in ("*", "..."):
        return Wild()
    if s[0] == "(":
        return Query(s)
    if len(s) > 1 and s[0] in "\"'" and s[-1] == s[0]:
        return Literal(s[1:-1])
    if re.fullmatch(r"[+-]?\d+", s) and -(2**63) <= int(s) < 2**63:
        return Literal(int(s))
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?", s):
        return Literal(float(s))
    if s in ("true", "false"):
        return Literal(s == "true")
    if s in ("null", "nil", "None"):
        return Literal(None)
    if schema.is_kind_pattern(s):
        return Kind(s) if s in schema.KINDS else Native(s, language)
    if not re.fullmatch(r"[\w.:+*/<>=!&|^~%-]+", s):
        return code_pattern(s, language)
    return Native(s, language)


def code_pattern(code: str, language: str) -> Pattern:
    """A pattern written as code: parsed with identifiers in the place of metavariables.

    The tree of the code becomes nested structures: inner nodes by kind, operator and children, leaves
    by kind and text. A statement or expression that fills the whole code is the pattern.
    """
    from ..sources import frontends

    lang = schema.ALIASES.get(language.lower(), language.lower())
    if lang not in frontends.REGISTRY:
        raise PatternError(f"code pattern needs a parser for {language}: {code}")
    plain, names = placeholders(code)
    try:
        root = frontends.REGISTRY[lang](plain)
    except frontends.ParseFailure as e:
        raise PatternError(f"code pattern can't be read: {code}: {e}") from e
    while len(root["kids"]) == 1 and root["type"] in ("module", "document", "expression_statement", "program", "source_file"):
        root = root["kids"][0]

    def convert(n: dict) -> Pattern:
        text = plain[n["start"] : n["end"]]
        if text in names and not n["kids"]:
            return parse(names[text])
        if len(n["kids"]) == 1 and n["type"] == "expression_statement" and text in names:
            return parse(names[text])
        kind = schema.kind_of(n["type"], lang)
        props = dict(n.get("props") or {})
        if not n["kids"]:
            return Structure(kind, {**props, "text": text}, ())
        return Structure(kind, props, tuple(map(convert, n["kids"])))

    return convert(root)


def metavariables(p: Pattern) -> list[str]:
    """Names of a pattern's metavariables in order of appearance, each once."""
    if isinstance(p, Meta):
        return [p.name] if p.name else []
    parts = p.parts if isinstance(p, (AnyOf, AllOf)) else (p.part,) if isinstance(p, Not) else (p.children or ()) if isinstance(p, Structure) else ()
    return list(dict.fromkeys(n for x in parts for n in metavariables(x)))


def placeholders(code: str) -> tuple[str, dict[str, str]]:
    """Code with metavariables turned into plain identifiers, and identifier -> metavariable."""
    names: dict[str, str] = {}

    def one(m: re.Match) -> str:
        if not m.group(2):
            return m.group()
        word = f"__METAVAR_{'MULTI_' if len(m.group(1)) > 1 else ''}{m.group(2)}__"
        names[word] = m.group()
        return word

    return META.sub(one, code), names


INTEGER, FLOATING = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
EPSILON = 2.220446049250313e-16


def literal_test(value: object, text: Column, name: Column) -> Column:
    """Whether a node is the literal: by number for numbers, by word for null and truth values, else by text or name."""
    if value is None:
        return F.lower(text).isin("null", "nil", "none")
    if isinstance(value, bool):
        return F.lower(text) == str(value).lower()
    if isinstance(value, int):
        return F.when(text.rlike(INTEGER), text.try_cast("bigint") == value)
    if isinstance(value, float):
        return F.when(text.rlike(FLOATING), F.abs(text.try_cast("double") - value) < EPSILON)
    return (text == value) | (name == value)


def test(p: Pattern) -> Column:
    """The part of a pattern that the node's own columns decide; null counts as no.

    For a structure with children this is a necessary condition, for everything else the whole test.
    """
    c = {n: F.col(n) for n in ("kind", "native_type", "text", "name")}
    if isinstance(p, (Wild, Meta)):
        out = F.lit(True) if not isinstance(p, Meta) or not p.kind else F.lower(c["kind"]) == p.kind.lower()
    elif isinstance(p, Kind):
        out = c["kind"] == p.kind
    elif isinstance(p, Native):
        kind = schema.kind_of(p.native_type, p.language)
        out = c["native_type"] == p.native_type
        if kind != "Unknown" and p.native_type in schema.natives_of(kind, p.language):
            out = out | (c["native_type"].isNull() & (c["kind"] == kind))
    elif isinstance(p, Literal):
        out = literal_test(p.value, c["text"], c["name"])
    elif isinstance(p, AnyOf):
        out = F.lit(False)
        for x in p.parts:
            out = out | test(x)
    elif isinstance(p, AllOf):
        out = F.lit(True)
        for x in p.parts:
            out = out & test(x)
    elif isinstance(p, Not):
        return ~test(p.part)
    elif isinstance(p, Structure):
        out = F.lit(True) if p.kind is None else F.lower(c["kind"]) == p.kind.lower()
        for k, v in p.properties.items():
            have = c[k] if k in c else F.col("properties")[k]
            out = out & (have.isNotNull() if v is None else have == str(v))
    else:
        raise PatternError(f"no test for {p}")
    return F.coalesce(out, F.lit(False))


def relational(p: Pattern) -> bool:
    """Whether the node's own columns decide the pattern."""
    if isinstance(p, (AnyOf, AllOf)):
        return all(map(relational, p.parts))
    if isinstance(p, Not):
        return relational(p.part)
    return not isinstance(p, Query) and not (isinstance(p, Structure) and p.children is not None)


# ---------------------------------------------------------------- rows as Python values, for sequences
def row_matches(p: Pattern, row: dict, env: dict) -> dict | None:
    """Environment after matching one row (with its child rows in `kids`, if there), or None."""
    if isinstance(p, Wild):
        return env
    if isinstance(p, Meta):
        if p.kind and (row["kind"] or "").lower() != p.kind.lower():
            return None
        if not p.name:
            return env
        if p.name in env:
            return env if same(env[p.name][0], row) else None
        return env | {p.name: [row]}
    if isinstance(p, Kind):
        return env if row["kind"] == p.kind else None
    if isinstance(p, Native):
        kind = schema.kind_of(p.native_type, p.language)
        return env if row["native_type"] == p.native_type or (row["native_type"] is None and row["kind"] == kind and kind != "Unknown") else None
    if isinstance(p, Literal):
        return env if literal_matches(p.value, row["text"], row["name"]) else None
    if isinstance(p, AnyOf):
        return next((e for e in (row_matches(x, row, env) for x in p.parts) if e is not None), None)
    if isinstance(p, AllOf):
        for x in p.parts:
            env = row_matches(x, row, env)
            if env is None:
                return None
        return env
    if isinstance(p, Not):
        return None if row_matches(p.part, row, {}) is not None else env
    if isinstance(p, Structure):
        if p.kind is not None and (row["kind"] or "").lower() != p.kind.lower():
            return None
        for k, v in p.properties.items():
            have = row.get(k) if k in ("name", "text", "native_type") else (row.get("properties") or {}).get(k)
            if have is None or (v is not None and have != str(v)):
                return None
        if p.children is None:
            return env
        rest = [] if p.exact else [Meta(None, True, 0)]
        return sequence([*p.children, *rest], row.get("kids") or [], env)
    return None


def literal_matches(value: object, text: str | None, name: str | None) -> bool:
    t = text or ""
    if value is None:
        return t.lower() in ("null", "nil", "none")
    if isinstance(value, bool):
        return t.lower() == str(value).lower()
    if isinstance(value, int):
        return bool(re.match(INTEGER, t)) and int(t) == value
    if isinstance(value, float):
        return bool(re.match(FLOATING, t)) and abs(float(t) - value) < EPSILON
    return value in (text, name)


def same(a: dict, b: dict) -> bool:
    """Structural equality: kind, text and name where both have one, and the children in order."""
    if a["kind"] != b["kind"]:
        return False
    if any(a[k] is not None and b[k] is not None and a[k] != b[k] for k in ("text", "name")):
        return False
    ka, kb = a.get("kids"), b.get("kids")
    if ka is None or kb is None:
        return a.get("digest") is None or a.get("digest") == b.get("digest")
    return len(ka) == len(kb) and all(map(same, ka, kb))


def sequence(patterns: list[Pattern], rows: list[dict], env: dict) -> dict | None:
    """Match patterns to the rows in order; multiple metavariables take as many as they can.

    All rows must be used, unless the last pattern is a multiple metavariable or there are no patterns.
    """
    if not patterns:
        return env if not rows else None
    p, rest = patterns[0], patterns[1:]
    if isinstance(p, Meta) and p.many:
        for n in range(len(rows), p.least - 1, -1):
            got = env
            if p.name:
                if p.name in env:
                    if len(env[p.name]) != n or not all(map(same, env[p.name], rows[:n])):
                        continue
                else:
                    got = env | {p.name: rows[:n]}
            end = sequence(rest, rows[n:], got)
            if end is not None:
                return end
        return None
    if not rows:
        return None
    got = row_matches(p, rows[0], env)
    return None if got is None else sequence(rest, rows[1:], got)


# ---------------------------------------------------------------- matching
CAPTURE = T.StructType([T.StructField("name", T.StringType()), T.StructField("node_ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())])
MATCHES = T.StructType([T.StructField("file_id", T.LongType()), T.StructField("node_id", T.IntegerType()), T.StructField("captures", T.ArrayType(CAPTURE))])
ROW = ("node_id", "kind", "native_type", "name", "text", "properties")


def capture_text(row: dict) -> str:
    return row["text"] if row["text"] is not None else row["name"] if row["name"] is not None else ""


def own_captures(p: Pattern) -> Column:
    """Captures of a pattern that the node decides alone: every named metavariable is the node itself."""
    value = F.coalesce(F.col("text"), F.col("name"), F.lit(""))

    def of(x: Pattern) -> Column:
        if isinstance(x, AnyOf):
            out = F.array().cast(T.ArrayType(CAPTURE))
            for part in reversed(x.parts):
                out = F.when(test(part), of(part)).otherwise(out)
            return out
        names = metavariables(x) if not isinstance(x, Not) else []
        items = [F.struct(F.lit(n).alias("name"), F.array("node_id").alias("node_ids"), value.alias("text")) for n in names]
        return F.array(*items).cast(T.ArrayType(CAPTURE))

    return of(p)


def depth_of(p: Pattern) -> int:
    """Levels of children that a pattern looks at."""
    if isinstance(p, Structure):
        return 0 if p.children is None else 1 + max((depth_of(c) for c in p.children), default=0)
    parts = p.parts if isinstance(p, (AnyOf, AllOf)) else (p.part,) if isinstance(p, Not) else ()
    return max(map(depth_of, parts), default=0)


def find(nodes: DataFrame, p: Pattern) -> DataFrame:
    """file_id, node_id, captures (name, node_ids, text) of every match, one per node.

    Patterns on the node itself are a filter. Others collect the children of the nodes that pass the
    own test, level by level, and match them in Arrow batches; a parent's children are one row.
    """
    if relational(p):
        return nodes.where(test(p)).select(*KEY, own_captures(p).alias("captures"))
    ship(nodes.sparkSession)
    levels = depth_of(p)
    # maps can't be ordered, so properties travel as text
    item = F.struct("sib_idx", *ROW[:-1], F.to_json("properties").alias("properties"))
    rows = nodes.select(*KEY, "parent_id", item.alias("row"))
    kids = None
    for _ in range(levels):
        at = nodes.where("parent_id is not null").select("file_id", F.col("parent_id").alias("_up"), "node_id", item.alias("row"))
        if kids is not None:
            at = at.join(kids, KEY, "left").select("file_id", "_up", F.col("row").withField("kids", F.col("kids")).alias("row"))
        kids = at.groupBy("file_id", F.col("_up").alias("node_id")).agg(F.array_sort(F.collect_list("row")).alias("kids") if kids is None else F.sort_array(F.collect_list(F.struct(F.col("row.sib_idx").alias("_s"), F.to_json("row").alias("_j")))).alias("kids"))
        if _ > 0 or levels > 1:
            kids = kids.select(*KEY, F.to_json("kids").alias("kids"))
    candidates = rows.join(nodes.where(test_any(p)).select(*KEY), KEY, "left_semi").join(kids, KEY, "left")
    candidates = candidates.select(*KEY, F.to_json("row").alias("row"), (F.col("kids") if levels > 1 else F.to_json("kids")).alias("kids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        def own(k):
            return {c: k.get(c) for c in ROW[:-1]} | {"properties": json.loads(k.get("properties") or "{}")}

        def read(text):
            out = []
            for k in json.loads(text) if isinstance(text, str) else text or []:
                k = json.loads(k["_j"]) if "_j" in k else k
                out.append(own(k) | {"kids": read(k["kids"]) if k.get("kids") else []})
            return out

        for b in batches:
            got = []
            for f, n, row, ks in b.itertuples(index=False, name=None):
                r = json.loads(row)
                env = row_matches(p, own(r) | {"kids": read(ks) if ks else []}, {})
                if env is not None:
                    caps = [{"name": k, "node_ids": [x["node_id"] for x in v], "text": ", ".join(map(capture_text, v))} for k, v in env.items()]
                    got.append((f, n, caps))
            yield pd.DataFrame(got, columns=["file_id", "node_id", "captures"])

    return candidates.mapInPandas(run, MATCHES)


def test_any(p: Pattern) -> Column:
    """A necessary condition on the node itself."""
    if isinstance(p, AnyOf):
        out = F.lit(False)
        for x in p.parts:
            out = out | test_any(x)
        return out
    if isinstance(p, AllOf):
        out = F.lit(True)
        for x in p.parts:
            out = out & test_any(x)
        return out
    return F.lit(True) if isinstance(p, (Not, Query)) and not relational(p) else test(p)
