"""Which source files were not written by hand for their project.

A file counts as generated, packed (minified or bundled), third-party or data by what is found first
of four kinds of evidence: its word shingles against those of known public libraries; layout
statistics of its text against thresholds tuned per language (longest and mean line, shares of white
space, letters, letters and digits together, density of numeric literals, long encoded runs, lines
that repeat but for numbers); the notice in the comments that open or close it; and its path.
A layout verdict comes from the text alone. Copies and files with a notice look like any other code,
so that layout can't tell them; there the other evidence decides, and `evidence` says which did.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

# Where third-party, generated and packed files lie, and what they are called.
THIRD_PARTY = r"(?i)(^|/)(node_modules|bower_components|jspm_packages|vendor|vendored|third[_-]?party|3rd[_-]?party|external|externals|extern|deps|Godeps|Carthage/Checkouts|Pods|site-packages|dist-packages|elm-stuff|web/static/libs|static/vendor|contrib/upstream|upstream)/"
GENERATED = r"(?i)(^|/)(generated|__generated__|autogenerated|gen-src|generated-sources|generated_sources)/|(_pb2(_grpc)?\.pyi?|\.pb\.(go|cc|h|c)|\.g\.(cs|dart)|\.designer\.cs|\.generated\.\w+|\.g\.i\.cs|_generated\.\w+|[.-]gen\.\w+|_gen\.go|zz_generated\.\w+\.go|\.tab\.[ch]|\.yy\.c|_string\.go)$"
GENERATED_CASE = r"[a-z0-9]Grpc\.java$|OuterClass\.java$"
PACKED = r"(?i)([.-]min\.(js|css|mjs)|\.(bundle|chunk|packed|pack)\.(js|mjs|css)|[.-](?=[0-9a-f]*[0-9])[0-9a-f]{8,20}\.(js|mjs|css)|\.(js|css)\.map)$"

# Notices of generated files, in ten languages.
NOTICE = re.compile(
    r"""code\ generated\b.*|@generated\b|<auto-?generated|\bauto-generated\b|\bautogenerated\b
    |automatically\ (?:created|generated|produced|written)|machine-?\ ?(?:written|generated|made)
    |(?:this|file|code|source|header|class)\b.{0,40}\b(?:was|is|were|has\ been)\ (?:auto\S*\ )?generated
    |^\W*generated\ (?:by|from|with|using|at|on)\b|\bproduced\ by\b.*\b(?:do\ not|don't)\b|(?:do\ not|don't|never)\ (?:edit|modify|change|touch)\b.{0,20}(?:by\ hand|manually|this\ file|directly|\bfile\b)
    |changes\b.*\bwill\ be\ (?:lost|overwritten)|edit\ the\ template\ instead
    |generad[oa]\ (?:por|automáticamente|automaticamente)|no\ (?:editar|modificar)\b
    |généré[es]*\ (?:automatiquement|par)|ne\ pas\ (?:modifier|éditer)
    |automatisch\ (?:erzeugt|generiert|erstellt)|nicht\ (?:von\ hand\ )?(?:bearbeiten|ändern)|änderungen\ gehen\ verloren
    |gerad[oa]\ (?:automaticamente|por)|não\ (?:edite|editar|modificar|modifique)
    |generat[oa]\ (?:automaticamente|da)|non\ (?:modificare|editare)
    |wygenerowan|nie\ (?:edytować|edytuj|modyfikować|modyfikuj)
    |создан[ао]?\ (?:генератором|автоматически)|сгенерирован|не\ (?:редактировать|изменять|править)
    |自动生成|(?:请勿|不要)(?:手动)?(?:修改|编辑)|自動生成|自動的に生成|編集しないで|変更しないで""",
    re.I | re.X,
)
COMMENT_LINE = re.compile(r"\s*(?://|/\*|\*|#(?!include|define|if|pragma|\[)|--|;|<!--|'''|\"\"\")")

#: Thresholds per language: longest code line and mean line of packed text, its greatest share of
#: white space; greatest share of letters outside literals in data, least density of numeric literals in data, greatest
#: share of letters and digits together in a table of signs; shortest encoded run.
DEFAULTS = {"max_line": 400, "mean_line": 110, "white": 0.12, "letters": 0.12, "numbers": 0.35, "alnum": 0.15, "run": 200}
TUNED = {"js": {"max_line": 300}, "ts": {"max_line": 300}, "css": {"max_line": 300}, "c": {"letters": 0.15}, "java": {"letters": 0.15}, "cs": {"letters": 0.15}, "go": {"letters": 0.14}, "rs": {"letters": 0.14}}
LEAST_SIZE = 120
#: Share of lines that repeat others but for numbers, from which a file of so many lines was made by a tool.
REPEATED, LEAST_LINES = 0.75, 12
NUMBERS = r"(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|[0-9][0-9_.]*(?:[eE][+-]?[0-9]+)?)[a-zA-Z]?\b"
LITERALS = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`|\b0[xX][0-9a-fA-F]+\b|-?\b[0-9][0-9_.eE+]*[a-zA-Z]?\b"
#: Word shingles: words of a shingle, least similarity, least number of shingles of a file that can be compared.
SHINGLE, SIMILAR, LEAST_SHINGLES = 5, 0.8, 8
#: Largest library table that is broadcast, in shingles; a larger one is joined instead (`similar_by_join`).
LIBRARY_BOUND = 2_000_000


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def threshold(name: str, ext: Column) -> Column:
    c = F.lit(DEFAULTS[name])
    for e, t in TUNED.items():
        if name in t:
            c = F.when(ext == e, t[name]).otherwise(c)
    return c


def path_origin(path: Column) -> Column:
    """third_party, generated, packed, or null."""
    return F.when(path.rlike(THIRD_PARTY), "third_party").when(path.rlike(GENERATED) | path.rlike(GENERATED_CASE), "generated").when(path.rlike(PACKED), "packed")


#: Statistics that `layout` adds.
STATISTICS = ("n_chars", "max_line", "mean_line", "white", "letters", "numbers", "alnum", "n_lines", "repeated", "run")


def layout(files: DataFrame, text: str) -> DataFrame:
    """Adds the layout statistics of a text, all by built-in functions; what several need is computed once."""
    t = F.col(text)
    size = F.greatest(F.length(t), F.lit(1))
    # lines that differ in numbers only are alike; brackets alone don't count as lines
    alike = F.filter(F.split(F.regexp_replace(t, "[0-9]+", "0"), r"\s*[\r\n]\s*"), lambda x: F.length(x) > 4)
    runs = F.regexp_extract_all(t, F.lit(r"([A-Za-z0-9+/=]{100,}|(?:\\x[0-9a-fA-F]{2}){30,})"), F.lit(1))
    base = files.withColumns({"_bare": F.regexp_replace(t, LITERALS, ""), "_dense": F.length(F.regexp_replace(t, r"\s+", "")), "_alike": alike, "n_chars": F.length(t)})
    return base.withColumns(
        {
            "max_line": F.array_max(F.transform(F.split("_bare", r"[\r\n]"), F.length)),
            "mean_line": F.col("n_chars") / (F.length(F.regexp_replace(t, r"[^\n\r]+", "")) + 1),
            "white": 1 - F.col("_dense") / size,
            "letters": F.length(F.regexp_replace("_bare", r"[^\p{L}]+", "")) / F.greatest(F.col("_dense"), F.lit(1)),
            "numbers": (F.col("n_chars") - F.length(F.regexp_replace(t, NUMBERS, ""))) / F.greatest(F.col("_dense"), F.lit(1)),
            "alnum": F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]+", "")) / F.greatest(F.col("_dense"), F.lit(1)),
            "n_lines": F.size("_alike"),
            "repeated": 1 - F.size(F.array_distinct("_alike")) / F.greatest(F.size("_alike"), F.lit(1)),
            "run": F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)),
        }
    ).drop("_bare", "_dense", "_alike")


def layout_origin(ext: Column) -> Column:
    """packed, data or generated by the statistics in the columns that `layout` names."""
    t = {n: threshold(n, ext) for n in DEFAULTS}
    big = F.col("n_chars") >= LEAST_SIZE
    packed = big & (F.col("max_line") >= t["max_line"]) & (F.col("mean_line") >= t["mean_line"]) & (F.col("white") <= t["white"]) & ext.isin("js", "ts", "mjs", "css", "jsx", "tsx", "py", "java", "cs", "go", "rs", "c", "rb", "h", "cpp", "php") & (F.col("letters") > 0)
    data = big & ((F.col("letters") <= t["letters"]) | (F.col("numbers") >= t["numbers"]) | (F.col("alnum") <= t["alnum"]) | ((F.col("run") >= t["run"]) & (F.col("run") >= 0.5 * F.col("n_chars"))))
    stubs = (F.col("n_lines") >= LEAST_LINES) & (F.col("repeated") >= REPEATED)
    return F.when(data, "data").when(packed, "packed").when(stubs, "generated")


LINE = re.compile(r"[^\r\n]+")


def lines_backwards(text: str) -> Iterator[str]:
    """The lines of a text from its end, each cut off when it is asked for."""
    end = len(text)
    while end > 0:
        at = max(text.rfind("\n", 0, end), text.rfind("\r", 0, end))
        yield text[at + 1 : end]
        end = at


def notice(text: str) -> bool:
    """Whether the comments that open or close a file say that a tool wrote it."""
    for lines in ((m.group() for m in LINE.finditer(text)), lines_backwards(text)):
        for line in lines:
            if not line.strip():
                continue
            if not COMMENT_LINE.match(line):
                break
            if NOTICE.search(line):
                return True
    return False


WORD = re.compile(rb"[\w\x80-\xff]+")
MULTIPLIERS = (1_000_003, 998_244_353, 1_000_000_007, 19_260_817, 40_503)


def stable_shingles(text: str) -> list[int]:
    """Hashes of the distinct five-word shingles; case, spacing and punctuation don't matter."""
    w = np.array([zlib.crc32(x) for x in WORD.findall(text.lower().encode("utf-8", "replace"))], np.uint64)
    n = len(w) - SHINGLE + 1
    if n <= 0:
        return []
    mixed = sum(w[i : n + i] * np.uint64(m) for i, m in enumerate(MULTIPLIERS))
    return np.unique(mixed & np.uint64((1 << 61) - 1)).tolist()


def shingle_rows(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """The columns in `keep`, n_shingles, shingle: a row per distinct shingle of a text."""
    ship(df.sparkSession)
    fn = F.pandas_udf(lambda s: s.map(stable_shingles), "array<bigint>")
    rows = df.where(F.length(text) > 0).select(*keep, fn(text).alias("_s")).where(F.size("_s") >= LEAST_SHINGLES)
    return rows.select(*keep, F.size("_s").alias("n_shingles"), F.explode("_s").alias("shingle"))


def similar_by_join(files: DataFrame, key: str, text: str, libraries: DataFrame, library: Column, library_text: str) -> DataFrame:
    """key, library: the most similar library of each file (SIMILAR or more), for library tables of any size.

    Shingles meet in an equi-join; the common ones are counted map-side per file and library.
    """
    known = shingle_rows(libraries.select(library.alias("library"), F.col(library_text).alias("_t")), "_t", "library").withColumnRenamed("n_shingles", "n_library")
    seen = shingle_rows(files.select(F.col(key).alias("_key"), F.col(text).alias("_t")), "_t", "_key")
    common = seen.join(known, "shingle").groupBy("_key", "n_shingles", "library", "n_library").agg(F.count(F.lit(1)).alias("n"))
    score = F.col("n") / F.least("n_shingles", "n_library")
    best = common.where(score >= SIMILAR).groupBy("_key").agg(F.max(F.struct(score.alias("s"), "library"))["library"].alias("library"))
    return best.withColumnRenamed("_key", key)


def library_index(libraries: DataFrame, name: Column, text: str) -> tuple[dict[int, tuple[int, ...]], list[int], list[str]]:
    """Shingle -> libraries that hold it, shingles per library, names. The caller has checked LIBRARY_BOUND."""
    index: dict[int, list[int]] = {}
    sizes, names = [], []
    rows = libraries.where(F.col(text).isNotNull()).select(name.alias("n"), F.col(text).alias("t")).toLocalIterator()
    for i, r in enumerate(rows):
        s = stable_shingles(r["t"])
        sizes.append(len(s))
        names.append(r["n"])
        for x in s:
            index.setdefault(x, []).append(i)
    return {k: tuple(v) for k, v in index.items()}, sizes, names


def best_library(text: str, index: dict[int, tuple[int, ...]], sizes: list[int]) -> tuple[int, float]:
    """Most similar library and the similarity: common shingles over those of the smaller text."""
    s = stable_shingles(text)
    if len(s) < LEAST_SHINGLES:
        return -1, 0.0
    hits: dict[int, int] = {}
    for x in s:
        for i in index.get(x, ()):
            hits[i] = hits.get(i, 0) + 1
    if not hits:
        return -1, 0.0
    return max(((i, n / min(len(s), sizes[i])) for i, n in hits.items() if sizes[i] >= LEAST_SHINGLES), key=lambda x: (x[1], -x[0]), default=(-1, 0.0))


def origins(files: DataFrame, key: str, path: str, text: str, libraries: DataFrame, library: Column, library_text: str, bound: int = LIBRARY_BOUND) -> DataFrame:
    """key, origin (third_party, generated, packed, data), evidence of every file that isn't hand-written.

    `key` must be unique. A null or empty text is judged by its path alone, a null path by its text.
    Of several kinds of evidence a library counts first, then the layout, the notice and the path. A
    library table of at most `bound` shingles is broadcast, a larger one joined, with the same result
    but for ties between libraries.
    """
    ship(files.sparkSession)
    base = files.select(key, path, text)
    told = base.where(F.coalesce(F.length(text), F.lit(0)) == 0).select(key, path_origin(F.col(path)).alias("origin"), F.lit("path").alias("evidence")).where("origin is not null")
    stats = layout(base.where(F.length(text) > 0).select(key, F.col(text).alias("_text"), extension(F.col(path)).alias("_ext"), path_origin(F.col(path)).alias("_path")), "_text")
    stats = stats.select(key, "_text", layout_origin(F.col("_ext")).alias("_layout"), "_path")
    size = libraries.where(F.length(library_text) > 0).select(F.sum(F.length(library_text))).first()[0] or 0
    joined = size > bound and shingle_rows(libraries.select(F.col(library_text).alias("_t")), "_t").count() > bound
    # at most `bound` entries
    sent = files.sparkSession.sparkContext.broadcast(({}, [], []) if joined else library_index(libraries, library, library_text))
    if joined:
        hits = similar_by_join(files, key, text, libraries, library, library_text).withColumnRenamed("library", "_library")
        stats = stats.join(hits, key, "left")
    else:
        stats = stats.withColumn("_library", F.lit(None).cast("string"))
    head = f"{key} {files.schema[key].dataType.simpleString()}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, sizes, names = sent.value
        for b in batches:
            out = []
            for k, t, lay, by_path, lib in b.itertuples(index=False, name=None):
                if lib is None and index:
                    i, s = best_library(t, index, sizes)
                    lib = names[i] if s >= SIMILAR else None
                if lib is not None:
                    out.append((k, "third_party", f"library {lib}"))
                elif lay is not None:
                    out.append((k, lay, "layout"))
                elif notice(t):
                    out.append((k, "generated", "notice"))
                elif by_path is not None:
                    out.append((k, by_path, "path"))
            yield pd.DataFrame(out, columns=[key, "origin", "evidence"])

    seen = stats.mapInPandas(run, f"{head}, origin string, evidence string")
    return told.unionByName(seen)
