"""Syntax of source files: lexing, token pairs, nesting and productions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship
from .grammars import GRAMMARS, Grammar, permissible_pairs

INNER = re.compile(r"\(([^()\[\]{}]*)\)|\[([^()\[\]{}]*)\]|\{([^()\[\]{}]*)\}")
SUITE = re.compile(r"«([^«»]*)»")
ILLEGAL = "\x00"
KINDS = ("paren", "square", "brace")
#: Entries of the per-worker memory of inner texts and their symbols.
MEMORY = 50_000
_known: dict[tuple[str, str, str], str | None] = {}

# what can end a statement at a line's end, and what can't begin the next one
ASI_END, ASI_GO_ON = frozenset("insp)]}KRj"), frozenset(".,?:o=a&|*<>)]};xXr-EHQy")
GO_END = frozenset("insp)]}RK")
BRACKET = {"(": "", "[": "", "{": "", ")": "(", "]": "[", "}": "{"}
RUBY_GO_ON = frozenset(",([{o-*&|=a.<>?:!rwN")


def classify(token: str) -> str:
    """Class of a token that is no keyword or operator; "" for what is dropped."""
    f = token[0]
    if f.isalpha() or f in "_$@":
        if token[-1] in "\"'" or f in "$@" and '"' in token or token.startswith(("r#\"", "br#\"")):
            return "s"
        return "l" if token[-1] == ":" and len(token) > 1 else "i"
    if f.isdigit() or f == "." and len(token) > 1 and token[1].isdigit():
        return "n"
    if f in "\"'`":
        if len(token) > 1 and token[-1] == f:
            return "s"
        return "l" if f == "'" and len(token) > 1 else ILLEGAL
    if len(token) > 1:
        if f == "/":
            return "" if token[1] in "/*" else "s"
        if f in ":%":
            return "s"
        if f in "#=\\":
            return ""
    return ILLEGAL


def free_class(token: str) -> str:
    """As classify, for languages in which line ends don't count."""
    return "" if token[0] == "\n" else classify(token)


def width(space: str) -> int:
    n = 0
    for c in space:
        n = n + 8 - n % 8 if c == "\t" else 0 if c == "\f" else n + 1
    return n


def lex(g: Grammar, text: str) -> str:
    """One class per token; ILLEGAL for what is no token of the language."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿")
    if text.startswith("#!") and not text.startswith("#!["):
        text = "\n" + text.partition("\n")[2]
    table = g.ready.setdefault("table", {**g.operators, **g.keywords})
    directive, lines = g.ready["directive"], g.lines
    tokens = g.ready["tokens"].findall(text if lines != "layout" else "\n" + text)
    if lines == "none" and directive is None:
        return "".join([table.get(t) or free_class(t) for t in tokens])
    out: list[str] = []
    stack: list[str] = []
    indents = [0]
    prev, newline, space, loops, dotted = "", False, "", 0, g.name in ("ruby", "csharp")
    for token in tokens:
        c = table.get(token)
        if c is None:
            if token[0] == "\n":
                newline, space = True, token[1:]
                continue
            if directive is not None and token.lstrip()[:1] == "#":
                if not directive.match(token):
                    return ILLEGAL
                continue
            if token[0] == "#" and lines in ("layout", "line"):
                continue
            c = classify(token)
            if c == "":
                continue
            if c == ILLEGAL:
                return ILLEGAL
        if prev == "." and dotted and c.isalpha() and c not in "ins":
            c = "i"
        if newline:
            newline = False
            if lines == "layout":
                if not stack:
                    if prev:
                        out.append("N")
                    w = width(space)
                    if w > indents[-1]:
                        indents.append(w)
                        out.append("«")
                    while w < indents[-1]:
                        indents.pop()
                        out.append("»")
                    if w != indents[-1]:
                        return ILLEGAL
            elif lines == "asi":
                if prev in ASI_END and (not stack or stack[-1] == "{") and c not in ASI_GO_ON and not (c in "([" and prev != "}") and not (c == "{" and prev == ")"):
                    out.append("N")
                    prev = "N"
            elif lines == "semicolon":
                if prev in GO_END:
                    out.append(";")
                    prev = ";"
            elif lines == "line":
                loops = 0
                if prev and prev not in RUBY_GO_ON and (not stack or stack[-1] == "{") and c not in ".)]}":
                    out.append("N")
                    prev = "N"
        if lines == "line":
            if c in "IW":
                if prev in ("", "N", ";", "=", "(", "t", "E", "{", "|", "r", ",", "a", "O", "o"):
                    out.append("«")
                    loops += c == "W"
                else:
                    c = "m"
            elif c in "dkCYF":
                out.append("«")
                loops += c == "F"
            elif c == "O":
                if loops:
                    loops -= 1
                else:
                    out.append("«")
        if c in BRACKET:
            if c in "([{":
                stack.append(c)
            elif stack:
                # only where lines count; whether brackets match is found by the reductions
                stack.pop()
        out.append(c)
        prev = c
    if lines == "layout":
        if prev:
            out.append("N")
        out.append("»" * (len(indents) - 1))
    elif lines == "semicolon" and prev in GO_END:
        out.append(";")
    return "".join(out)


def known(g: Grammar, kind: str, inside: str) -> str | None:
    key = (g.name, kind, inside)
    if key not in _known:
        if len(_known) > MEMORY:
            _known.clear()
        _known[key] = g.reduce(kind, inside)
    return _known[key]


def reduces(g: Grammar, classes: str) -> str:
    """"" if the classes reduce to a file, else what went wrong: token, nesting or production.

    Innermost windows of brackets are reduced all at once, round by round. A window without a
    production leaves a mark, so that brackets that don't match are still told from it.
    """
    if ILLEGAL in classes:
        return "token"
    bad = False

    def bracket(m: re.Match) -> str:
        nonlocal bad
        symbol = known(g, KINDS[m.lastindex - 1], m.group(m.lastindex))
        bad = bad or symbol is None
        return symbol or "i"

    def suite(m: re.Match) -> str:
        nonlocal bad
        symbol = known(g, "suite", m.group(1))
        bad = bad or symbol is None
        return symbol or "β"

    n = 1
    while n:
        classes, n = INNER.subn(bracket, classes)
    if re.search(r"[()\[\]{}]", classes):
        return "nesting"
    if bad:
        return "production"
    if "«" in classes or "»" in classes:
        if g.lines == "layout":
            classes = classes.replace("N«", "«")
        n = 1
        while n and not bad:
            classes, n = SUITE.subn(suite, classes)
        if bad:
            return "production"
        if "«" in classes or "»" in classes:
            return "nesting"
    return "" if known(g, "top", classes) is not None else "production"


def pair_string(classes: str) -> str:
    """The distinct adjacent pairs of a class string, sorted, one after the other."""
    return "".join(sorted(a + b for a, b in set(zip(classes, classes[1:]))))


_pairs: dict[str, set[str]] = {}


def pair_table(spark) -> DataFrame:
    """ext, pair: the permissible pairs of every grammar; its size is that of the grammars."""
    rows = []
    for e, g in GRAMMARS.items():
        if e not in _pairs:
            _pairs[e] = permissible_pairs(g)
        rows.extend((e, p) for p in _pairs[e])
    return spark.createDataFrame(rows, "ext string, pair string")


def lexed(files: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """key, ext, pairs, fault: token pairs of each file, and "", token, nesting or production.

    Files whose extension has no grammar and null texts have no row; an empty text is a valid file.
    """
    ship(files.sparkSession)
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    rows = files.select(key, ext.alias("ext"), text).where(F.col("ext").isin(*GRAMMARS) & F.col(text).isNotNull())
    schema = f"{key} {files.schema[key].dataType.simpleString()}, ext string, pairs string, fault string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, e, t in b.itertuples(index=False, name=None):
                g = GRAMMARS[e]
                classes = lex(g, t)
                out.append((k, e, "" if ILLEGAL in classes else pair_string(classes), reduces(g, classes)))
            yield pd.DataFrame(out, columns=[key, "ext", "pairs", "fault"])

    return rows.mapInPandas(run, schema)


def faults(files: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """key, ext, fault (token, pair, nesting, production; "" for a valid file) of every file with text.

    Equal sets of pairs are looked up once: the distinct sets are split into pairs and anti-joined
    against the permissible pairs of the grammar, which are few and broadcast.
    """
    # kept, as both the sets and the verdicts read it: lexing is the expensive part
    rows = cut(lexed(files, key, path, text))
    sets = rows.select("ext", "pairs").where("pairs <> ''").distinct()
    split = sets.select("ext", "pairs", F.explode(F.regexp_extract_all("pairs", F.lit("(?s).."), F.lit(0))).alias("pair"))
    wrong = split.join(F.broadcast(pair_table(files.sparkSession)), ["ext", "pair"], "left_anti").select("ext", "pairs").distinct().withColumn("_wrong", F.lit(True))
    both = rows.join(wrong, ["ext", "pairs"], "left")
    return both.select(key, "ext", F.when(F.col("fault") == "token", "token").when(F.col("_wrong"), "pair").otherwise(F.col("fault")).alias("fault"))
