"""Comments and strings of source files, lexed in chunks.

A lexer is a finite automaton, so what a chunk of text does to it is a function from the state
before to the state after. The functions of all chunks are found independently, composed by a
parallel prefix (log2 of the number of chunks steps, each a window function over the chunks of a
file), and give the state in which each chunk starts; then all chunks are lexed at once. A huge file
thus needs no single task that reads it from its beginning.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Lexer states. A state other than CODE is left by the end pattern below.
STATES = range(9)
CODE, LINE, BLOCK, DOUBLE, SINGLE, TEMPLATE, DOUBLE3, SINGLE3, MARKUP = STATES
ENDS = {
    LINE: re.compile(r"\n"),
    BLOCK: re.compile(r"\*/"),
    MARKUP: re.compile(r"-->"),
    DOUBLE: re.compile(r'(?:\\.|[^"\\\n])*+("|\n|\\?\Z)', re.S),
    SINGLE: re.compile(r"(?:\\.|[^'\\\n])*+('|\n|\\?\Z)", re.S),
    TEMPLATE: re.compile(r"(?:\\.|[^`\\])*+(`|\\?\Z)", re.S),
    DOUBLE3: re.compile(r'(?:\\.|"(?!"")|[^"\\])*+("""|"{0,2}\\?\Z)', re.S),
    SINGLE3: re.compile(r"(?:\\.|'(?!'')|[^'\\])*+('''|'{0,2}\\?\Z)", re.S),
}
OPENERS = {
    "c": (re.compile(r'//|/\*|"|`|\''), {"//": LINE, "/*": BLOCK, '"': DOUBLE, "`": TEMPLATE, "'": SINGLE}),
    "hash": (re.compile(r'#|"""|\'\'\'|"|\'|`'), {"#": LINE, '"""': DOUBLE3, "'''": SINGLE3, '"': DOUBLE, "'": SINGLE, "`": TEMPLATE}),
    "dash": (re.compile(r'--|/\*|"|\''), {"--": LINE, "/*": BLOCK, '"': DOUBLE, "'": SINGLE}),
    "markup": (re.compile(r"<!--"), {"<!--": MARKUP}),
    "semicolon": (re.compile(r';|"'), {";": LINE, '"': DOUBLE}),
    "percent": (re.compile(r"%"), {"%": LINE}),
}
# Languages whose comments aren't those of C.
FAMILIES = {
    "hash": ("python", "ruby", "py", "rb", "bash", "shell", "sh", "zsh", "yaml", "yml", "toml", "r", "perl", "powershell", "make", "makefile", "cmake", "dockerfile", "elixir", "julia", "nix", "hcl", "terraform", "ini", "properties"),
    "dash": ("sql", "lua", "haskell", "elm", "ada"),
    "markup": ("html", "xml", "markdown", "md", "vue", "svg", "xhtml"),
    "semicolon": ("clojure", "lisp", "scheme", "asm", "edn"),
    "percent": ("latex", "tex", "erlang", "prolog", "matlab"),
}
#: Characters that are no part of any delimiter, so a chunk may end between two of them.
SAFE = re.compile(r"[\w \t.,:()\[\]{}=+]{2}")
#: Characters of a chunk. Whatever it is, the rows are the same.
CHUNK = 256


def family(language: str | None) -> str:
    """The group of languages with the same comments and strings."""
    name = (language or "").strip().lower()
    return next((f for f, names in FAMILIES.items() if name in names), "c")


def scan(text: str, state: int, fam: str) -> tuple[int, list[tuple[int, int, int]]]:
    """State after the text, and (state, start, end) of the insides of comments and strings."""
    opener, kinds = OPENERS[fam]
    at, spans = 0, []
    while True:
        if state == CODE:
            m = opener.search(text, at)
            if m is None:
                return CODE, spans
            at = m.end()
            state = kinds[m.group()]
        if state in (LINE, BLOCK, MARKUP):
            m = ENDS[state].search(text, at)
            if m is None:
                spans.append((state, at, len(text)))
                return state, spans
            spans.append((state, at, m.start()))
        else:
            m = ENDS[state].match(text, at)
            if m is None or m.group(1) in ("", "\\") or m.group(1).startswith(('"', "'")) and m.end() == len(text) and state in (DOUBLE3, SINGLE3) and len(m.group(1)) < 3:
                spans.append((state, at, len(text)))
                return state, spans
            spans.append((state, at, m.start(1)))
        at, state = m.end(), CODE


def transitions(text: str, fam: str) -> list[int]:
    """The function of a chunk: state after it for each state before it."""
    return [scan(text, s, fam)[0] for s in STATES]


def split_text(text: str, size: int = CHUNK) -> list[tuple[int, str]]:
    """(offset, chunk) pieces of about `size` characters that end where no delimiter can be cut."""
    out, at = [], 0
    while len(text) - at > size:
        m = SAFE.search(text, at + size)
        if m is None:
            break
        out.append((at, text[at : m.start() + 1]))
        at = m.start() + 1
    return [*out, (at, text[at:])]


def chunks_of(df: DataFrame, keys: list[str], text: str, language: str, size: int = CHUNK) -> DataFrame:
    """keys, fam, chunk_no, at (offset), chunk, last (whether it is the last): the pieces of each text; null texts have none."""
    names = [*keys, "fam", "chunk_no", "at", "chunk", "last"]
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", fam string, chunk_no int, at int, chunk string, last boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for *ids, t, lang in b.itertuples(index=False):
                if t is None:
                    continue
                pieces = split_text(t, size)
                rows.extend((*ids, family(lang), i, at, piece, i == len(pieces) - 1) for i, (at, piece) in enumerate(pieces))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return df.select(*keys, text, language).mapInPandas(run, schema)


def start_states(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `state`, in which each chunk starts, by a parallel prefix over transition functions.

    After step k a row holds the composition of its own function with those of the 2**k - 1 chunks
    before it; the window function `lag` fetches the neighbour's. The function of a text's last chunk
    is needed by none, so a text of one chunk costs nothing here. A window has the short function
    arrays of one file, never its text.
    """
    fn = F.pandas_udf(lambda t, f: pd.Series([transitions(a, b) for a, b in zip(t, f)]), "array<int>")
    table = chunks.where("not last").select(*keys, "chunk_no", fn("chunk", "fam").alias("fn"))
    longest = chunks.agg(F.max("chunk_no")).first()[0] or 0
    order = Window.partitionBy(*keys).orderBy("chunk_no")
    step = 1
    while step < longest:
        before = F.lag("fn", step).over(order)
        table = table.withColumn("_b", before).withColumn("fn", F.when(F.col("_b").isNull(), F.col("fn")).otherwise(F.transform("_b", lambda s: F.element_at("fn", s + 1)))).drop("_b")
        step *= 2
    after = table.select(*keys, (F.col("chunk_no") + 1).alias("chunk_no"), F.element_at("fn", CODE + 1).alias("state"))
    first = chunks.where("chunk_no = 0").withColumn("state", F.lit(CODE))
    return first.unionByName(chunks.where("chunk_no > 0").join(after, [*keys, "chunk_no"]))


def inner_texts(df: DataFrame, keys: list[str], text: str, language: str, size: int = CHUNK) -> DataFrame:
    """keys, start, state, inner: the insides of comments and strings; a text without any comes whole (state CODE).

    Every text is cut into chunks and goes through the parallel prefix; the pieces of a span over
    chunk borders are joined, so the rows don't depend on `size`. Null and empty texts have no row;
    rows must be distinct.
    """
    head = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    # texts of several rows with the same keys are told apart
    ids = [*keys, "_text_no"]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for *names, fam, no, at, chunk, last, state in b[[*ids, "fam", "chunk_no", "at", "chunk", "last", "state"]].itertuples(index=False, name=None):
                after, spans = scan(chunk, state, fam)
                lone = last and no == 0
                # a chunk without a span stands by for a text without any
                for s, i, j in spans or [(CODE, 0, len(chunk))]:
                    goes_on = no > 0 and i == 0
                    rows.append((*names, at + i, s, chunk[i:j], goes_on, goes_on or not last and j == len(chunk) and after == s, lone))
            yield pd.DataFrame(rows, columns=[*ids, "start", "state", "inner", "goes_on", "open", "lone"])

    rows = df.select(*keys, text, language).where(F.length(text) > 0).withColumn("_text_no", F.xxhash64(text, language))
    chunks = cut(chunks_of(rows, ids, text, language, size))
    found = cut(start_states(chunks, ids).mapInPandas(pieces, f"{head}, _text_no bigint, start int, state int, inner string, goes_on boolean, open boolean, lone boolean"))
    spans = found.where((F.col("state") != CODE) & ~F.col("lone"))
    bare = found.where((F.col("state") == CODE) & ~F.col("lone")).join(spans.select(*ids).distinct(), ids, "left_anti")
    parts = spans.where("open").unionByName(bare)
    # the window has a row per chunk border, without its text
    first = F.max(F.when(~F.col("goes_on"), F.col("start"))).over(Window.partitionBy(*ids).orderBy("start"))
    owner = parts.select(*ids, "start", "goes_on").withColumn("first", first).drop("goes_on")
    joined = parts.join(owner, [*ids, "start"]).groupBy(*ids, "first").agg(F.first("state").alias("state"), F.array_sort(F.collect_list(F.struct("start", "inner"))).alias("_p"))
    joined = joined.select(*keys, F.col("first").alias("start"), "state", F.array_join(F.col("_p.inner"), "").alias("inner"))
    whole = found.where("lone").unionByName(spans.where("not open"))
    return whole.select(*keys, "start", "state", "inner").unionByName(joined)
