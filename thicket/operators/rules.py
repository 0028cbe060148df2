"""Compiling rules to DataFrames, and scanning node tables with many rules at once."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions import text as tx
from ..session import cut
from ..sources.frontends import Aim, Look
from ..sources.rules import Rule, RuleError
from . import patterns as pt
from . import sexpr, tree
from .patterns import CAPTURE
from .tree import KEY

RELATIONS = ("inside", "notInside", "has", "notHas", "precedes", "follows")
#: Constructs of other dialects that a rule's regular expression must not use.
REFUSED = re.compile(r"\(\?[=!<]|\\[1-9]")


def checked_regex(r: str) -> str:
    """The regular expression with Unicode classes, or an error for look-around and back-references."""
    if REFUSED.search(r):
        raise RuleError(f"regular expression uses look-around or a back-reference: {r}")
    try:
        re.compile(r)
    except re.error as e:
        raise RuleError(f"regular expression can't be read: {r}") from e
    return r if r.isascii() and not re.search(r"\\[wdsbWDSB]", r) else f"(?U){r}"


def kind_test(kind: str) -> Column:
    """Kind, case ignored, or a native type of that name."""
    return F.coalesce((F.lower("kind") == kind.lower()) | (F.col("native_type") == kind), F.lit(False))


def regex_test(regex: str) -> Column:
    return F.coalesce(F.coalesce("text", "name").rlike(checked_regex(regex)), F.lit(False))


def own_test(d: dict, language: str) -> Column:
    """The conditions of a rule or condition that look at the node itself: pattern, kind, regex."""
    out = F.lit(True)
    if "pattern" in d:
        out = out & pt.test(pt.parse(d["pattern"], language))
    if "kind" in d:
        out = out & kind_test(d["kind"])
    if "regex" in d:
        out = out & regex_test(d["regex"])
    return out


def looked_up(d: dict, language: str) -> pt.Pattern | None:
    """The pattern of a condition if the node's own columns don't decide it: an S-expression, or code with children."""
    if "pattern" not in d:
        return None
    p = pt.parse(d["pattern"], language)
    return None if pt.relational(p) else p


def simple(d: dict, language: str = "*") -> bool:
    """Whether a condition is decided by the node's own columns at every level."""
    if any(k in d for k in RELATIONS) or looked_up(d, language) is not None:
        return False
    return all(simple(x, language) for k in ("any", "all") for x in d.get(k, ())) and ("not" not in d or simple(d["not"], language))


def simple_test(d: dict, language: str) -> Column:
    out = own_test(d, language)
    if "any" in d:
        some = F.lit(False)
        for x in d["any"]:
            some = some | simple_test(x, language)
        out = out & some
    for x in d.get("all", ()):
        out = out & simple_test(x, language)
    if "not" in d:
        out = out & ~simple_test(d["not"], language)
    return out


def target_test(d: dict, language: str) -> Column:
    if not any(k in d for k in ("pattern", "kind", "regex", "any", "all", "not")):
        raise RuleError("a relation needs a pattern or a kind")
    if not simple(d, language):
        raise RuleError("the target of a relation can't have relations or children of its own")
    return simple_test(d, language)


def related(nodes: DataFrame, relation: str, d: dict, language: str) -> DataFrame:
    """file_id, node_id of the nodes for which a positive relation holds."""
    test = target_test(d, language)
    neighbor = d.get("stopBy") == "neighbor"
    immediate = bool(d.get("immediate"))
    name = relation[3:].lower() if relation.startswith("not") else relation
    if name == "inside":
        return tree.inside_parent(nodes, test) if neighbor else tree.inside(nodes, test)
    if name == "has":
        return tree.has_child(nodes, test) if neighbor else tree.has(nodes, test)
    return (tree.precedes if name == "precedes" else tree.follows)(nodes, test, immediate)


def matching(nodes: DataFrame, d: dict, language: str) -> DataFrame:
    """file_id, node_id of the nodes that satisfy a condition: filters, semi- and anti-joins, unions.

    `any` unites its alternatives, `all` follows one after the other, `not` is an anti-join, and all
    parts of a condition that are there apply together.
    """
    if simple(d, language):
        return nodes.where(simple_test(d, language)).select(*KEY)
    deep = looked_up(d, language)
    own = {k: v for k, v in d.items() if k in ("pattern", "kind", "regex") and not (k == "pattern" and deep is not None)}
    out = nodes.where(own_test(own, language)).select(*KEY)
    if deep is not None:
        out = out.join(found_by(nodes, deep), KEY, "left_semi")
    if "any" in d:
        some = None
        for x in d["any"]:
            one = matching(nodes, x, language)
            some = one if some is None else some.unionByName(one)
        out = out.join(some.distinct(), KEY, "left_semi")
    for x in d.get("all", ()):
        out = out.join(matching(nodes, x, language), KEY, "left_semi")
    if "not" in d:
        out = out.join(matching(nodes, d["not"], language), KEY, "left_anti")
    for relation in RELATIONS:
        if relation in d:
            how = "left_anti" if relation.startswith("not") else "left_semi"
            out = out.join(related(nodes, relation, d[relation], language), KEY, how)
    return out


def found_by(nodes: DataFrame, p: pt.Pattern) -> DataFrame:
    """file_id, node_id (and captures) of a pattern that isn't decided by the node alone."""
    return sexpr.root_nodes(nodes, p.text) if isinstance(p, pt.Query) else pt.find(nodes, p)


def capture_name(d: dict, language: str) -> list[str]:
    """Metavariables that the matched node itself binds."""
    names = []
    if "pattern" in d and looked_up(d, language) is None:
        names += pt.metavariables(pt.parse(d["pattern"], language))
    for k in ("any", "all"):
        for x in d.get(k, ()):
            names += capture_name(x, language)
    return list(dict.fromkeys(names))


def constraint_test(c: dict, size: Column | int = 1) -> Column:
    """Constraint on a captured node: kind, regex, pattern, their negations, length, and all, any, not."""
    size = F.lit(size) if isinstance(size, int) else size
    out = F.lit(True)
    text = F.coalesce("text", "name")
    if "kind" in c:
        out = out & (F.lower("kind") == c["kind"].lower())
    if "notKind" in c:
        out = out & ~F.coalesce(F.lower("kind") == c["notKind"].lower(), F.lit(False))
    if "regex" in c:
        out = out & F.coalesce(text.rlike(checked_regex(c["regex"])), F.lit(False))
    if "notRegex" in c:
        out = out & ~F.coalesce(text.rlike(checked_regex(c["notRegex"])), F.lit(False))
    if "pattern" in c:
        out = out & pt.test(pt.parse(c["pattern"]))
    if "length" in c:
        n = c["length"]
        lo, hi = (n, n) if isinstance(n, int) else (n.get("min", 0), n.get("max", 2**31 - 1))
        out = out & (size >= lo) & (size <= hi)
    for x in c.get("all", ()):
        out = out & constraint_test(x, size)
    if "any" in c:
        some = F.lit(False)
        for x in c["any"]:
            some = some | constraint_test(x, size)
        out = out & some
    if "not" in c:
        out = out & ~constraint_test(c["not"], size)
    return F.coalesce(out, F.lit(False))


def bindings(d: dict, language: str) -> list[tuple[Column | None, str]]:
    """(condition, name): which metavariables the node is bound to; None is always.

    In `any` only the first alternative that fits binds; an alternative with relations counts as fitting.
    """
    out: list[tuple[Column | None, str]] = []
    if "pattern" in d and looked_up(d, language) is None:
        p = pt.parse(d["pattern"], language)
        free = isinstance(p, (pt.Meta, pt.Wild)) and not getattr(p, "kind", None)
        out += [(None if free else pt.test(p), n) for n in pt.metavariables(p)]
    taken: Column | None = F.lit(False)
    for x in d.get("any", ()):
        if taken is None:
            break
        free = set(x) == {"pattern"} and isinstance(pt.parse(x["pattern"], language), (pt.Meta, pt.Wild))
        here = None if free or not simple(x, language) else simple_test(x, language)
        for c, n in bindings(x, language):
            parts = [y for y in (here, ~taken, c) if y is not None]
            cond = parts[0]
            for y in parts[1:]:
                cond = cond & y
            out.append((None if x is d["any"][0] and here is None and c is None else cond, n))
        taken = None if here is None else taken | here
    for x in d.get("all", ()):
        out += bindings(x, language)
    return out


def bound_names(rule: Rule) -> Column:
    """Names of the metavariables that are bound to the node, as an array."""
    entries = bindings(rule.rule, rule.language)
    if all(c is None for c, _ in entries):
        return F.array(*(F.lit(n) for n in dict.fromkeys(n for _, n in entries))).cast("array<string>")
    return F.array_distinct(F.array_compact(F.array(*(F.lit(n) if c is None else F.when(c, F.lit(n)) for c, n in entries))))


def deep_captures(rule: Rule) -> Column:
    """Captures of the rule's own code pattern, from the column of its fact; else none."""
    if looked_up(rule.rule, rule.language) is None:
        return F.create_map().cast("map<string,string>")
    return F.coalesce(F.col(flag("query", rule.rule["pattern"], rule.language) + "_c"), F.create_map().cast("map<string,string>"))


def applies(rule: Rule) -> Column:
    """Whether a rule is for the language of a node (in the column _lang, plainly spelled)."""
    lang = rule.language.strip().lower()
    lang = schema.ALIASES.get(lang, lang)
    return F.lit(True) if lang in schema.UNIVERSAL else F.col("_lang") == lang


def path_test(rule: Rule) -> Column:
    """Whether a path is among a rule's files and not among its ignores."""
    out = F.lit(True)
    if rule.files:
        out = out & F.col("path").rlike("|".join(f"(?:{tx.glob_regex(g)})" for g in rule.files))
    if rule.ignores:
        out = out & ~F.col("path").rlike("|".join(f"(?:{tx.glob_regex(g)})" for g in rule.ignores))
    return F.coalesce(out, F.lit(False))


#: Columns of nodes that only queries read, or nothing.
UNREAD = ("is_named", "field", "child_count", "depth", "front_end")
FINDING = ("rule_id", "severity", "severity_level", "message", *schema.SPAN, "fix", "captures")
TEMPLATES = "_rule int, rule_id string, severity string, severity_level int, _message string, _fix string"


def constrained(rule: Rule) -> Column:
    names = set(capture_name(rule.rule, rule.language))
    out = F.lit(True)
    for n, c in rule.constraints.items():
        if n.lstrip(tx.PREFIXES) in names:
            out = out & constraint_test(c)
    return out


def flag(what: str, condition: object, language: str) -> str:
    """Column name of a fact; the language only counts where a pattern's native types depend on it."""
    text = json.dumps([what, condition, language if "pattern" in json.dumps(condition) else "*"], sort_keys=True)
    return "_f_" + hashlib.md5(text.encode()).hexdigest()


def facts_of(d: dict, language: str) -> dict[str, tuple[str, dict, str]]:
    """Relations and S-expressions in a condition, at every level: flag -> (what, condition, language).

    Equal conditions of different rules have equal flags.
    """
    out: dict[str, tuple[str, dict, str]] = {}

    def walk(x: dict) -> None:
        for r in RELATIONS:
            if r in x:
                name = r[3:].lower() if r.startswith("not") else r
                out[flag(name, x[r], language)] = (name, x[r], language)
        if looked_up(x, language) is not None:
            out[flag("query", x["pattern"], language)] = ("query", x, language)
        for y in (*x.get("any", ()), *x.get("all", ()), *([x["not"]] if "not" in x else ())):
            walk(y)

    walk(d)
    return out


def full_test(d: dict, language: str) -> Column:
    """A whole condition as a Column over nodes that carry the flags of `with_facts`."""
    has_query = looked_up(d, language) is not None
    out = own_test({k: v for k, v in d.items() if not (k == "pattern" and has_query)}, language)
    if has_query:
        out = out & F.col(flag("query", d["pattern"], language))
    if "any" in d:
        some = F.lit(False)
        for x in d["any"]:
            some = some | full_test(x, language)
        out = out & some
    for x in d.get("all", ()):
        out = out & full_test(x, language)
    if "not" in d:
        out = out & ~full_test(d["not"], language)
    for r in RELATIONS:
        if r in d:
            negative = r.startswith("not")
            c = F.col(flag(r[3:].lower() if negative else r, d[r], language))
            out = out & (~c if negative else c)
    return out


def required_words(regex: str) -> frozenset[str] | None:
    """Words of which every text that the regular expression finds has one; None if it names none."""
    if re.search(r"\\[0v]", regex):  # not the same in Java
        return None
    try:
        parts = _parser.parse(checked_regex(regex).removeprefix("(?U)"))
    except (re.error, OverflowError):
        return None
    if parts.state.flags & ~re.UNICODE:
        return None

    def of(seq) -> frozenset[str] | None:
        found, run = [], ""
        for op, arg in [*((str(o), a) for o, a in seq), ("END", None)]:
            if op == "LITERAL":
                run += chr(arg)
                continue
            if run:
                found.append(frozenset((run,)))
            run = ""
            if op == "SUBPATTERN":
                found.append(None if arg[1] or arg[2] else of(arg[3]))
            elif op == "BRANCH":
                some = [of(x) for x in arg[1]]
                found.append(None if None in some else frozenset().union(*some))
            elif op in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
                found.append(of(arg[2]))
        return max((x for x in found if x), key=lambda x: (min(map(len, x)), -len(x)), default=None)

    return of(parts)


def pattern_looks(p: pt.Pattern) -> tuple[Look, ...]:
    """Looks of which one falls on every node that passes a pattern's test."""
    if isinstance(p, pt.AnyOf):
        return tuple(x for y in p.parts for x in pattern_looks(y))
    if isinstance(p, pt.AllOf):
        out: tuple[Look, ...] = (Look(),)
        for y in p.parts:
            out = both(out, pattern_looks(y))
        return out
    if isinstance(p, pt.Literal) and isinstance(p.value, str):
        return (Look(values=frozenset((p.value,))),)
    kind = p.native_type if isinstance(p, pt.Native) else getattr(p, "kind", None)
    plain = isinstance(p, (pt.Kind, pt.Native, pt.Meta, pt.Wild))
    return (Look(None if kind is None else frozenset((kind.lower(),)), text=not plain),)


def both(a: tuple[Look, ...], b: tuple[Look, ...]) -> tuple[Look, ...]:
    """Looks at what meets one of each; where both name kinds, values or words, those of the first."""
    first = lambda x, y: y if x is None else x
    return tuple(Look(first(x.kinds, y.kinds), first(x.values, y.values), first(x.words, y.words), x.text or y.text) for x in a for y in b)


def looks_of(d: dict, language: str) -> tuple[Look, ...]:
    """Looks of which one falls on every node that meets a condition, its relations left aside."""
    out: tuple[Look, ...] = (Look(text="not" in d),)
    if "pattern" in d:
        out = both(out, pattern_looks(pt.parse(d["pattern"], language)))
    if "kind" in d:
        out = both(out, (Look(frozenset((d["kind"].lower(),))),))
    if "regex" in d:
        out = both(out, (Look(words=required_words(d["regex"]), text=True),))
    if "any" in d:
        out = both(out, tuple(x for y in d["any"] for x in looks_of(y, language)))
    for x in d.get("all", ()):
        out = both(out, looks_of(x, language))
    return out


def aims_of(rules: Iterable[Rule]) -> tuple[Aim, ...] | None:
    """What the enabled rules look at, for `frontends.parse`: the findings in the nodes that it leaves are all there are.

    Only `inside` and `has` at any depth hold among chosen nodes as they do among all; with other
    relations, or patterns with children, None: all nodes are needed.
    """
    out = []
    for r in rules:
        if not r.enabled:
            continue
        facts = facts_of(r.rule, r.language)
        if any(what not in ("inside", "has") or d.get("stopBy") == "neighbor" for what, d, _ in facts.values()):
            return None
        lang = schema.ALIASES.get(r.language.strip().lower(), r.language.strip().lower())
        reads = bool(r.fix or r.constraints or capture_name(r.rule, r.language))
        own = both((Look(text=reads),), looks_of(r.rule, r.language))
        needs = tuple(looks_of(r.rule[k], r.language) for k in ("inside", "has") if k in r.rule)
        others = tuple(x for _, d, language in facts.values() for x in looks_of(d, language))
        out.append(Aim("*" if lang in schema.UNIVERSAL else lang, own, needs, others))
    return tuple(out)


def with_facts(nodes: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Nodes with one truth column per distinct relation or S-expression of all rules, each computed once."""
    facts: dict[str, tuple[str, dict, str]] = {}
    for r in rules:
        facts |= facts_of(r.rule, r.language)
    base = nodes
    for name, (what, d, language) in facts.items():
        if what == "query":
            keys = found_by(base, looked_up(d, language))
            if "captures" in keys.columns:
                entries = F.transform("captures", lambda c: F.struct(c["name"].alias("key"), c["text"].alias("value")))
                keys = keys.select(*KEY, F.map_from_entries(entries).alias(name + "_c"))
            else:
                keys = keys.distinct().withColumn(name + "_c", F.create_map().cast("map<string,string>"))
        else:
            keys = related(base, what, d, language).distinct()
        nodes = nodes.join(keys.withColumn(name, F.lit(True)).hint("merge"), KEY, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return nodes


def scan(nodes: DataFrame, rules: Iterable[Rule], files: DataFrame | None = None, min_severity: str | None = None, exact: bool = False, rule_id: str | None = None) -> DataFrame:
    """Findings of all enabled rules: file_id, node_id, rule_id, severity, severity_level, message, span, fix, captures.

    All rules share one pass: relations and S-expressions are computed once per distinct condition and
    become truth columns; then each node carries an array of the rules that hold, exploded once. With
    inside or has relations `nodes` needs last_id (tree.with_intervals, or a front end's nodes).
    `files` (file_id, path) is needed for rules with files or ignores. Severity is a minimum, or the
    very one if `exact`; `rule_id` keeps ids that contain it. Repeated node rows give repeated
    findings, see tree.once; no rules or no nodes give no findings.
    """
    rules = [r for r in rules if r.enabled and (rule_id is None or rule_id in r.id)]
    if min_severity is not None:
        n = tx.SEVERITIES[min_severity.lower()]
        rules = [r for r in rules if (tx.SEVERITIES[r.severity] == n if exact else tx.SEVERITIES[r.severity] >= n)]
    if any(not simple(r.rule, r.language) for r in rules):
        queries = any(what == "query" for r in rules for what, _, _ in facts_of(r.rule, r.language).values())
        nodes = with_facts(cut(nodes if queries else nodes.drop(*UNREAD)), rules)
    if any(r.files or r.ignores for r in rules):
        nodes = nodes.join(files.select("file_id", "path"), "file_id", "left")
    nodes = nodes.withColumn("_lang", schema.plain_language(F.col("language")))
    # one number and the bound names per hit; the templates of the rules come by a broadcast of the rules
    hits = [F.when(applies(r) & path_test(r) & full_test(r.rule, r.language) & constrained(r), F.struct(F.lit(i).alias("_rule"), bound_names(r).alias("_bound"), deep_captures(r).alias("_deep"))) for i, r in enumerate(rules)]
    none = F.array().cast("array<struct<_rule:int,_bound:array<string>,_deep:map<string,string>>>")
    value = F.coalesce("text", "name", F.lit(""))
    found = nodes.select(*KEY, *schema.SPAN, value.alias("_value"), F.explode(F.array_compact(F.array(*hits)) if hits else none).alias("_h"))
    found = found.select(*KEY, *schema.SPAN, "_value", "_h.*")
    rows = [(i, r.id, r.severity, tx.SEVERITIES[r.severity], r.message, r.fix) for i, r in enumerate(rules)]
    found = found.join(F.broadcast(nodes.sparkSession.createDataFrame(rows, TEMPLATES)), "_rule")
    captures = F.map_concat(F.map_from_arrays("_bound", F.array_repeat(F.col("_value"), F.size("_bound"))), "_deep")
    found = found.withColumn("captures", captures)
    has_names = lambda c: F.col(c).rlike(f"[{tx.PREFIXES}]")
    message = F.when(has_names("_message"), tx.interpolate(F.col("_message"), F.col("captures"))).otherwise(F.col("_message"))
    fix = F.when(has_names("_fix"), tx.interpolate_first(F.col("_fix"), F.col("captures"), F.col("_value"))).otherwise(F.col("_fix"))
    return found.withColumn("message", message).withColumn("fix", fix).select(*KEY, *FINDING)


def span_dedupe(nodes: DataFrame, alternatives: list[Column]) -> DataFrame:
    """file_id, node_id, alternative: union of alternatives in order, one node for each byte range of a file."""
    hits = [F.when(F.coalesce(a, F.lit(False)), F.lit(i)) for i, a in enumerate(alternatives)]
    rows = nodes.select(*KEY, "start_offset", "end_offset", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("alternative"))
    best = rows.groupBy("file_id", "start_offset", "end_offset").agg(F.min(F.struct("alternative", "node_id")).alias("b"))
    return best.select("file_id", "b.node_id", "b.alternative")


def run_examples(rule: Rule, match: dict[str, DataFrame]) -> dict[str, bool]:
    """For each named example node table of a rule whether the rule finds something in it."""
    return {name: not scan(nodes, [rule]).isEmpty() for name, nodes in match.items()}
