"""Front ends: source text to node rows.

A front end is a function from text to nested nodes (dicts). Registered per language; languages
without one get a lexical tree (lines and tokens). `parse` runs them in Arrow batches and numbers the
nodes. Native types are named as common tree grammars name them.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..session import ship

#: A node: type, start, end (character offsets), and perhaps name, text, field, named, props, kids.
FrontEnd = Callable[[str], dict]
REGISTRY: dict[str, FrontEnd] = {}


class ParseFailure(ValueError):
    """A text that can't be read; carries the message and the character offset."""

    def __init__(self, message: str, at: int = 0):
        super().__init__(message)
        self.at = at


def register(language: str, front_end: FrontEnd) -> None:
    REGISTRY[schema.ALIASES.get(language, language)] = front_end


def node(kind: str, start: int, end: int, kids: list | None = None, **more) -> dict:
    return {"type": kind, "start": start, "end": end, "kids": kids or [], **more}


# Names of Python's syntax nodes.
PYTHON_TYPES = {
    "Module": "module", "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition", "Return": "return_statement", "Delete": "delete_statement", "Assign": "assignment", "AugAssign": "augmented_assignment", "AnnAssign": "assignment", "For": "for_statement", "AsyncFor": "for_statement", "While": "while_statement", "If": "if_statement", "With": "with_statement", "AsyncWith": "with_statement", "Raise": "raise_statement", "Try": "try_statement", "Assert": "assert_statement", "Import": "import_statement", "ImportFrom": "import_from_statement", "Global": "global_statement", "Nonlocal": "nonlocal_statement", "Expr": "expression_statement", "Pass": "pass_statement", "Break": "break_statement", "Continue": "continue_statement", "BoolOp": "boolean_operator", "NamedExpr": "named_expression", "BinOp": "binary_operator", "UnaryOp": "unary_operator", "Lambda": "lambda", "IfExp": "conditional_expression", "Dict": "dictionary", "Set": "set", "ListComp": "list_comprehension", "SetComp": "set_comprehension", "DictComp": "dictionary_comprehension", "GeneratorExp": "generator_expression", "Await": "await", "Yield": "yield", "YieldFrom": "yield", "Compare": "comparison_operator", "Call": "call", "JoinedStr": "string", "Attribute": "attribute", "Subscript": "subscript", "Starred": "list_splat", "Name": "identifier", "List": "list", "Tuple": "tuple", "Slice": "slice", "arg": "identifier", "keyword": "keyword_argument", "alias": "aliased_import", "ExceptHandler": "except_clause", "arguments": "parameters", "Match": "match_statement", "match_case": "case_clause",
}
OPERATORS = {"Add": "+", "Sub": "-", "Mult": "*", "Div": "/", "Mod": "%", "Pow": "**", "FloorDiv": "//", "LShift": "<<", "RShift": ">>", "BitOr": "|", "BitXor": "^", "BitAnd": "&", "MatMult": "@", "And": "and", "Or": "or", "Not": "not", "Invert": "~", "UAdd": "+", "USub": "-", "Eq": "==", "NotEq": "!=", "Lt": "<", "LtE": "<=", "Gt": ">", "GtE": ">=", "Is": "is", "IsNot": "is not", "In": "in", "NotIn": "not in"}


def python(text: str, comments: bool = True) -> dict:
    """Python by the standard parser; comments are added as nodes of the module, unless nobody asks for them."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        line = getattr(e, "lineno", None) or 1
        at = sum(len(x) for x in text.splitlines(keepends=True)[: line - 1]) + max((getattr(e, "offset", None) or 1) - 1, 0)
        raise ParseFailure(getattr(e, "msg", None) or str(e), min(at, len(text))) from e
    lines = text.splitlines(keepends=True)
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x))
    raw = [x if text.isascii() else x.encode("utf-8") for x in lines]

    def offset(line: int, column: int) -> int:
        if not 0 < line <= len(raw):
            return len(text)
        x = raw[line - 1]
        return starts[line - 1] + (min(column, len(x)) if isinstance(x, str) else len(x[:column].decode("utf-8", "ignore")))

    def convert(n: ast.AST, role: str | None, outer: tuple[int, int]) -> dict | None:
        name = type(n).__name__
        if isinstance(n, ast.Constant):
            v = n.value
            kind = "true" if v is True else "false" if v is False else "none" if v is None else "string" if isinstance(v, (str, bytes)) else "ellipsis" if v is ... else "float" if isinstance(v, (float, complex)) else "integer"
        elif name in PYTHON_TYPES:
            kind = PYTHON_TYPES[name]
        else:
            return None
        line = getattr(n, "lineno", None)
        span = outer if line is None else (offset(line, n.col_offset), offset(n.end_lineno, n.end_col_offset))
        props = {}
        op = getattr(n, "op", None) or (n.ops[0] if isinstance(n, ast.Compare) else None)
        if op is not None:
            props["operator"] = OPERATORS[type(op).__name__]
        if name.startswith("Async"):
            props["isAsync"] = "true"
        kids = []
        for field in n._fields:
            # operators and contexts have no nodes
            if field in ("ctx", "op", "ops"):
                continue
            value = getattr(n, field, None)
            for v in value if isinstance(value, list) else (value,):
                if isinstance(v, ast.AST):
                    k = convert(v, FIELDS.get(field, field), span)
                    if k is None:
                        kids.extend(x for x in (convert(w, FIELDS.get(field, field), span) for w in ast.iter_child_nodes(v)) if x)
                    else:
                        kids.append(k)
        # the order of the text, not of the tree's fields
        if len(kids) > 1:
            kids.sort(key=PLACE)
        if kind == "parameters" and kids:
            span = kids[0]["start"], kids[-1]["end"]
        label = n.id if isinstance(n, ast.Name) else n.arg if isinstance(n, (ast.arg, ast.keyword)) else getattr(n, "name", None) if not isinstance(n, ast.alias) else n.name
        return node(kind, *span, kids, name=label if isinstance(label, str) else None, field=role, props=props)

    root = convert(tree, None, (0, len(text)))
    root["start"], root["end"] = 0, len(text)
    if not comments:
        return root
    import io
    import tokenize

    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                s = starts[t.start[0] - 1] + t.start[1]
                root["kids"].append(node("comment", s, s + len(t.string)))
    except (tokenize.TokenError, SyntaxError):
        pass
    root["kids"].sort(key=PLACE)
    return root


PLACE = itemgetter("start", "end")
FIELDS = {"func": "function", "args": "arguments", "value": "right", "targets": "left", "target": "left", "test": "condition", "orelse": "alternative", "attr": "attribute"}


def json_tree(text: str) -> dict:
    """JSON with positions, by a small recursive-descent reader over tokens."""
    token = re.compile(r"\s*(?:(?P<s>\"(?:\\.|[^\"\\])*\")|(?P<n>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<w>true|false|null)|(?P<p>[{}\[\]:,]))")
    at = 0

    def take() -> tuple[str, str, int, int]:
        nonlocal at
        m = token.match(text, at)
        if not m:
            raise ParseFailure("unexpected text", at)
        at = m.end()
        return m.lastgroup, m.group(m.lastgroup), m.start(m.lastgroup), m.end()

    stack: list[dict] = []
    root = node("document", 0, len(text))
    holder = root
    expect_key = False
    while at < len(text) and text[at:].strip():
        kind, value, s, e = take()
        if value in ("{", "["):
            n = node("object" if value == "{" else "array", s, e)
            holder["kids"].append(n)
            stack.append(holder)
            holder = n
        elif value in ("}", "]"):
            if holder["type"] == "pair":
                holder["end"] = holder["kids"][-1]["end"]
                holder = stack.pop()
            if not stack or holder["type"] != ("object" if value == "}" else "array"):
                raise ParseFailure(f"unexpected '{value}'", s)
            holder["end"] = e
            holder = stack.pop()
        elif value == ",":
            if holder["type"] == "pair":
                holder["end"] = holder["kids"][-1]["end"]
                holder = stack.pop()
        elif value == ":":
            if holder["type"] != "object" or not holder["kids"]:
                raise ParseFailure("unexpected ':'", s)
            key = holder["kids"].pop()
            p = node("pair", key["start"], e, [key], name=json.loads(text[key["start"] : key["end"]]) if key["type"] == "string" else None)
            key["field"] = "key"
            holder["kids"].append(p)
            stack.append(holder)
            holder = p
        else:
            holder["kids"].append(node({"s": "string", "n": "number"}.get(kind, value), s, e))
    if stack:
        raise ParseFailure("unexpected end", len(text))
    return root


MARKUP = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</?[A-Za-z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>|[^<]+|<", re.S)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def markup(text: str) -> dict:
    """HTML and XML: elements, attributes, text and comments; unclosed elements end with their parent."""
    root = node("document", 0, len(text))
    stack = [root]
    for m in MARKUP.finditer(text):
        t, s, e = m.group(), m.start(), m.end()
        if t.startswith("<!--"):
            stack[-1]["kids"].append(node("comment", s, e))
        elif t.startswith("</"):
            name = t[2:-1].strip().lower()
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i]["name"] == name), None)
            if at is None:
                stack[-1]["kids"].append(node("ERROR", s, e))
                continue
            for n in stack[at + 1 :]:
                n["end"] = s
            stack[at]["end"] = e
            del stack[at:]
        elif t.startswith(("<!", "<?")):
            stack[-1]["kids"].append(node("doctype", s, e))
        elif t.startswith("<") and len(t) > 1:
            name = re.match(r"<([^\s/>]+)", t).group(1).lower()
            n = node("element", s, e, name=name)
            for a in re.finditer(r"([\w:.-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", t[1 + len(name) : -1]):
                n["kids"].append(node("attribute", s + 1 + len(name) + a.start(), s + 1 + len(name) + a.end(), name=a.group(1)))
            stack[-1]["kids"].append(n)
            if not t.endswith("/>") and name not in VOID:
                stack.append(n)
        elif t.strip():
            stack[-1]["kids"].append(node("text", s, e))
    for n in stack[1:]:
        n["end"] = len(text)
    return root


WORDS = re.compile(r"(?P<comment>//[^\n]*|/\*.*?\*/|#[^\n]*)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`)|(?P<number>\d+(?:\.\d+)?)|(?P<identifier>[^\W\d]\w*)|(?P<punctuation>[^\w\s])", re.S)


def lexical(text: str, types: frozenset[str] | None = None, words: frozenset[str] | None = None) -> dict:
    """Lines and their tokens, for languages without a front end.

    If lines aren't among the `types` asked for, only tokens of these; with `words` those in which one begins.
    """
    root = node("source_file", 0, len(text))
    if types is not None and "line" not in types:
        spots = iter((0,)) if words is None else (m.start() for m in re.finditer(f"(?={'|'.join(map(re.escape, words))})", text))
        spot = next(spots, None)
        for m in WORDS.finditer(text) if spot is not None else ():
            end = m.end()
            if spot >= end:
                continue
            if (words is None or spot >= m.start()) and m.lastgroup in types:
                root["kids"].append(node(m.lastgroup, m.start(), end, named=m.lastgroup != "punctuation"))
            while words is not None and spot < end:
                spot = next(spots, len(text))
            if spot == len(text):
                break
        return root
    line = None
    ends = [m.start() for m in re.finditer("\n", text)] + [len(text)]
    i, start = 0, 0
    for m in WORDS.finditer(text):
        while m.start() > ends[i]:
            start = ends[i] + 1
            i += 1
            line = None
        if line is None:
            line = node("line", start, ends[i])
            root["kids"].append(line)
        line["kids"].append(node(m.lastgroup, m.start(), m.end(), named=m.lastgroup != "punctuation"))
        line["end"] = max(line["end"], m.end())
    return root


for _languages, _fn in ((("python",), python), (("json",), json_tree), (("html", "xml", "vue"), markup)):
    for _l in _languages:
        register(_l, _fn)


def front_end_of(language: str | None) -> tuple[str, FrontEnd]:
    lang = schema.ALIASES.get((language or "").lower(), (language or "").lower())
    return ("own", REGISTRY[lang]) if lang in REGISTRY else ("lexical", lexical)


# ---------------------------------------------------------------- which nodes are looked at
#: Native types of the front ends that make no others and cut the texts of their nodes from the source.
TYPES: dict[FrontEnd, frozenset[str]] = {
    python: frozenset((*PYTHON_TYPES.values(), *"comment true false none string ellipsis float integer".split())),
    json_tree: frozenset("document object array pair string number true false null".split()),
    markup: frozenset("document comment ERROR doctype element attribute text".split()),
    lexical: frozenset(("source_file", "line", *WORDS.groupindex)),
}


@dataclass(frozen=True)
class Look:
    """What a node has to be: of one of the kinds or native types (in small letters), with one of the values
    as its text or name, with one of the words in its text (its name, if it has no text). None is anything.

    With `text` its text is read for more than that.
    """

    kinds: frozenset[str] | None = None
    values: frozenset[str] | None = None
    words: frozenset[str] | None = None
    text: bool = False

    def has_kind(self, native: str, language: str) -> bool:
        return self.kinds is None or native.lower() in self.kinds or cached_kind(native, language).lower() in self.kinds


@dataclass(frozen=True)
class Aim:
    """What one rule looks at in texts of a language: the nodes it is about, and those they relate to.

    Where nothing in a file can meet `own`, or one of `needs`, the rule finds nothing in it.
    """

    language: str
    own: tuple[Look, ...]
    needs: tuple[tuple[Look, ...], ...] = ()
    others: tuple[Look, ...] = ()


class Chooser:
    """Tells of a node whether any of the looks falls on it, and whether its text is read."""

    def __init__(self, looks: tuple[Look, ...], language: str):
        self.looks, self.language = looks, language
        self.comments = any(x.has_kind("comment", language) for x in looks)
        self.tokens = frozenset(t for t in TYPES[lexical] if any(x.has_kind(t, language) for x in looks))
        marks = [x.words or x.values for x in looks if any(x.has_kind(t, language) for t in self.tokens)]
        self.words = None if None in marks else frozenset().union(*marks)
        self.types: dict[str, tuple[bool, bool, list[Look]]] = {}

    def options(self, fn: FrontEnd) -> tuple:
        """What a front end is told of the nodes that it may leave out."""
        return (self.comments,) if fn is python else (self.tokens, self.words) if fn is lexical else ()

    def of_type(self, native: str) -> tuple[bool, bool, list[Look]]:
        """Whether all nodes of a type are looked at, whether their texts are read, and the looks that depend on the text."""
        if native not in self.types:
            here = [x for x in self.looks if x.has_kind(native, self.language)]
            some = [x for x in here if x.values is not None or x.words is not None]
            self.types[native] = len(some) < len(here), any(x.text for x in here), some
        return self.types[native]

    def __call__(self, n: dict, text: str) -> tuple[bool, bool]:
        every, reads, some = self.of_type(n["type"])
        if some:
            own, name = n.get("text") or text[n["start"] : n["end"]], n.get("name")
            for x in some:
                if (x.values is None or own in x.values or name in x.values) and (x.words is None or any(w in (own or name or "") for w in x.words)):
                    return True, True
        return every, reads


class Choosers:
    """The choosers of the aims, for one text after the other."""

    def __init__(self, aims: tuple[Aim, ...]):
        self.aims = aims
        self.plans: dict[tuple[FrontEnd, str], list[tuple[int, list[list[Look]]]]] = {}
        self.made: dict[tuple[str, tuple[int, ...]], Chooser] = {}

    def plan(self, fn: FrontEnd, language: str) -> list[tuple[int, list[list[Look]]]]:
        """The aims that some type of the front end can meet: number, and looks of which each list needs one."""
        lang = schema.ALIASES.get(language.strip().lower(), language.strip().lower())
        out = []
        for i, a in enumerate(self.aims):
            lists = [[x for x in some if fn not in TYPES or any(x.has_kind(t, language) for t in TYPES[fn])] for some in (a.own, *a.needs)]
            if a.language in ("*", lang) and all(lists):
                out.append((i, lists))
        return out

    def of(self, fn: FrontEnd, text: str, language: str) -> Chooser | None:
        """The chooser of a text, None if no rule can find anything in what the front end makes of it."""
        if (fn, language) not in self.plans:
            self.plans[fn, language] = self.plan(fn, language)
        hits = tuple(i for i, lists in self.plans[fn, language] if all(any(possible(x, fn, text) for x in some) for some in lists))
        if not hits:
            return None
        if (language, hits) not in self.made:
            looks = [x for i in hits for some in (self.aims[i].own, *self.aims[i].needs, self.aims[i].others) for x in some]
            self.made[language, hits] = Chooser(tuple(dict.fromkeys(looks)), language)
        return self.made[language, hits]


def possible(look: Look, fn: FrontEnd, text: str) -> bool:
    """Whether the words and values of a look can be in the nodes of a text; of an unknown front end nothing is assumed.

    Names can differ from the source: escapes, case, composed letters, blanks within dotted names.
    """
    if look.words is not None and fn in TYPES and not any(w in text for w in look.words):
        return False
    if look.values is None or not (fn is lexical or fn is python and text.isascii()):
        return True
    return any(v in text or fn is python and not v.isidentifier() for v in look.values)


_kinds: dict[tuple[str, str], str] = {}


def cached_kind(native: str, language: str) -> str:
    key = (native, language)
    if key not in _kinds:
        _kinds[key] = schema.kind_of(native, language)
    return _kinds[key]


def byte_offsets(text: str):
    """Byte offset of every character, and of the end."""
    if text.isascii():
        return range(len(text) + 1)
    import numpy as np

    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    size = 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
    return [0, *np.cumsum(size).tolist()]


def flatten(root: dict, text: str, language: str, out: dict[str, list], anonymous: bool = False, all_text: bool = True, max_depth: int = 0, choose: Chooser | None = None) -> int:
    """Appends the nodes of a nested tree in pre-order to the columns in `out`; returns how many.

    Numbers, spans in bytes, kinds, texts and properties. A node at the depth limit is Unknown and
    says that it is cut. With `choose` only the chosen nodes get rows and numbers, and texts only
    where they are read; their places (parent_id, sib_idx, depth) are null.
    """
    import bisect

    offsets = byte_offsets(text)
    breaks = [-1, *(m.start() for m in re.finditer("\n", text))]
    starts = [offsets[b + 1] for b in breaks]
    put = {c: out[c].append for c in COLUMNS}
    first = len(out["node_id"])
    stack = [(root, None, 0, 0)]
    n_rows = 0
    while stack:
        n, parent, sib, depth = stack.pop()
        if n is None:
            out["last_id"][first + parent] = n_rows - 1
            continue
        no = n_rows
        kids = n["kids"] if anonymous else [k for k in n["kids"] if k.get("named", True)]
        reads = True
        if choose is not None:
            hit, reads = choose(n, text)
            if not hit:
                stack.extend((k, None, None, None) for k in reversed(kids))
                continue
            parent, sib, depth = None, None, None
        n_rows += 1
        props = n.get("props")
        kind = cached_kind(n["type"], language)
        if max_depth and depth >= max_depth:
            kind, props, kids = "Unknown", {**(props or {}), "truncated": "true", "childCount": str(len(kids))}, []
        s, e = n["start"], n["end"]
        i, j = bisect.bisect_left(breaks, s) - 1, bisect.bisect_left(breaks, e) - 1
        own = n.get("text")
        if not reads:
            own = None
        elif own is None and (all_text or not kids):
            own = text[s:e] or None
        put["node_id"](no)
        put["parent_id"](parent)
        put["sib_idx"](sib)
        put["depth"](depth)
        put["last_id"](no)
        put["kind"](kind)
        put["native_type"](n["type"])
        put["is_named"](n.get("named", True))
        put["name"](n.get("name"))
        put["text"](own)
        put["field"](n.get("field"))
        put["start_line"](i + 1)
        put["start_column"](offsets[s] - starts[i])
        put["end_line"](j + 1)
        put["end_column"](offsets[e] - starts[j])
        put["start_offset"](offsets[s])
        put["end_offset"](offsets[e])
        put["child_count"](len(kids))
        put["properties"](list(props.items()) if props else [])
        if kids:
            stack.append((None, no, 0, 0))
            stack.extend((kids[k], no, k, None if depth is None else depth + 1) for k in range(len(kids) - 1, -1, -1))
    return n_rows


COLUMNS = [c for c in schema.NODES.names if c not in ("file_id", "language")]
ARROW = {"LongType": pa.int64(), "IntegerType": pa.int32(), "StringType": pa.string(), "BooleanType": pa.bool_(), "MapType": pa.map_(pa.string(), pa.string())}
BATCH = 20_000


def parse(files: DataFrame, anonymous: bool = False, all_text: bool = True, max_depth: int = 0, aims: tuple[Aim, ...] | None = None) -> DataFrame:
    """Node rows (schema.NODES and front_end) of files with file_id, language, content.

    A text that its front end can't read gets the lexical tree and has a row in `parse_errors`. Null
    and empty texts have no nodes. Rows leave in batches, not by file. With `aims` only the nodes that
    rules look at have rows, numbered among themselves (see flatten); which texts that leaves without
    a row is told from the text itself where the front end is known.
    """
    if aims is not None and (max_depth or not all_text):
        raise ValueError("nodes are chosen from whole trees only")
    ship(files.sparkSession)
    out_schema = T.StructType([*schema.NODES.fields, T.StructField("front_end", T.StringType())])
    arrow = pa.schema([(f.name, ARROW[type(f.dataType).__name__]) for f in out_schema.fields])
    registry = dict(REGISTRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        REGISTRY.update(registry)
        choosers = None if aims is None else Choosers(aims)
        cols: dict[str, list] = {c: [] for c in arrow.names}

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in arrow], schema=arrow)
            for c in cols.values():
                c.clear()
            return b

        for b in batches:
            for f, lang, text in zip(*(c.to_pylist() for c in b.columns)):
                how, fn = front_end_of(lang)
                choose = plain = None
                if choosers is not None:
                    choose, plain = choosers.of(fn, text, lang or ""), choosers.of(lexical, text, lang or "")
                    if choose is None and plain is None:
                        continue
                try:
                    root = fn(text, *(choose.options(fn) if choose else ()))
                except (ParseFailure, RecursionError):
                    how, choose = "lexical", plain
                    root = lexical(text, *(choose.options(lexical) if choose else ()))
                if choosers is not None and choose is None:
                    continue
                n = flatten(root, text, lang or "", cols, anonymous, all_text, max_depth, choose)
                cols["file_id"].extend([f] * n)
                cols["language"].extend([lang] * n)
                cols["front_end"].extend([how] * n)
                if len(cols["file_id"]) >= BATCH:
                    yield flush()
        if cols["file_id"]:
            yield flush()

    return files.where("content <> ''").select("file_id", "language", "content").mapInArrow(run, out_schema)


def parse_texts(nodes: DataFrame, language: str | None = None) -> DataFrame:
    """Nodes of the texts of nodes, each parsed as a file of its own; file_id is a hash of the node's key.

    With `language` all texts are read as that language, say queries inside strings.
    """
    lang = F.lit(language) if language else F.col("language")
    texts = nodes.select(F.xxhash64("file_id", "node_id").alias("file_id"), lang.alias("language"), F.col("text").alias("content"))
    return parse(texts)


def parse_errors(files: DataFrame) -> DataFrame:
    """file_id, message, severity, start_offset (bytes) of the texts that their front end can't read."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for f, lang, text in b.itertuples(index=False, name=None):
                try:
                    front_end_of(lang)[1](text)
                except (ParseFailure, RecursionError) as e:
                    out.append((f, str(e), "error", len(text[: getattr(e, "at", 0)].encode("utf-8", "replace"))))
            yield pd.DataFrame(out, columns=["file_id", "message", "severity", "start_offset"])

    return files.where("content <> ''").select("file_id", "language", "content").mapInPandas(run, "file_id bigint, message string, severity string, start_offset int")


def self_check() -> list[tuple[str, str]]:
    """(language, status) of every known language: OK, or Lexical where only tokens are read."""
    return [(lang, "OK" if lang in REGISTRY else "Lexical") for lang in schema.LANGUAGES]
