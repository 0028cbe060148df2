"""Source files as rows: directory scans with ignore rules, globs and languages."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import glob_regex

MAX_FILE_SIZE = 10 * 1024 * 1024


def ignore_patterns(root: str) -> list[tuple[str, bool]]:
    """(regular expression on the relative path, negated) of every ignore file below a local root, outer ones first."""
    out = []
    for folder, _dirs, names in os.walk(root):
        base = os.path.relpath(folder, root).replace(os.sep, "/")
        prefix = "" if base == "." else re.escape(base) + "/"
        for name in (".gitignore", ".ignore"):
            if name in names:
                for line in Path(folder, name).read_text(encoding="utf-8", errors="replace").splitlines():
                    line = line.rstrip()
                    if not line or line.startswith("#"):
                        continue
                    negated, line = line.startswith("!"), line.lstrip("!")
                    only_dir, line = line.endswith("/"), line.rstrip("/")
                    anchored = "/" in line
                    body = glob_regex(line.lstrip("/"))[1:-1]
                    out.append((f"^{prefix}{'' if anchored else '(?:.*/)?'}{body}{'/.*' if only_dir else '(?:/.*)?'}$", negated))
    return out


def ignored(path: Column, patterns: Iterable[tuple[str, bool]]) -> Column:
    """Whether the last pattern that fits a relative path is not a negated one."""
    out = F.lit(False)
    for regex, negated in patterns:
        out = F.when(path.rlike(regex), F.lit(not negated)).otherwise(out)
    return out


def local_files(spark: SparkSession, root: str, max_size: int) -> DataFrame:
    """path (relative), length, content of all files below a folder that driver and executors see."""
    base = os.path.abspath(root)
    found = []
    for folder, dirs, names in os.walk(base):
        dirs[:] = [d for d in dirs if d != ".git"]
        for n in names:
            full = os.path.join(folder, n)
            if os.path.isfile(full):
                found.append((os.path.relpath(full, base).replace(os.sep, "/"), os.path.getsize(full)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for p, n in zip(b["path"], b["length"]):
                try:
                    texts.append(Path(base, p).read_bytes().decode("utf-8", "replace") if n <= max_size else None)
                except OSError:
                    texts.append(None)
            yield b.assign(content=texts)

    listed = spark.createDataFrame(found, "path string, length bigint")
    parts = max(1, min(len(found), sum(n for _, n in found) // (8 << 20) + spark.sparkContext.defaultParallelism))
    return listed.repartition(parts, "path").mapInPandas(read, "path string, length bigint, content string")


def read_files(spark: SparkSession, root: str, *, hidden: bool = False, no_ignore: bool = False, max_depth: int = 0, max_size: int = MAX_FILE_SIZE, languages: Iterable[str] | None = None, glob: str | None = None, hidden_name_only: bool = False) -> DataFrame:
    """file_id, path, language, content, n_bytes of the files below `root`.

    Hidden files and folders are left out unless asked for (the library form looks at the file's name
    only); ignore files are honoured; depth 0 means any; larger files than `max_size` have null
    content. `languages` keeps those of the given languages. A folder that the driver can open is
    listed there (names and sizes only) and read by the executors, which must see the same folder;
    any other root goes through Spark's own reader, which passes over names that begin with `_` or `.`
    and empty files. Texts that aren't UTF-8 are decoded with replacement characters.
    """
    if os.path.isdir(root):
        rows = local_files(spark, root, max_size)
        if glob and "/" not in glob:
            rows = rows.where(F.substring_index("path", "/", -1).rlike(glob_regex(glob)))
    else:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        if glob and "/" not in glob:
            reader = reader.option("pathGlobFilter", glob)
        base = root.rstrip("/") + "/"
        rel = F.when(F.col("path").contains(base), F.substring_index("path", base, -1)).otherwise(F.substring_index("path", "/", -1))
        rows = reader.load(root).select(rel.alias("path"), "length", F.when(F.col("length") <= max_size, F.decode("content", "utf-8")).alias("content"))
    if not hidden:
        rows = rows.where(~F.col("path").rlike(r"(^|/)\.[^/]+$" if hidden_name_only else r"(^|/)\."))
    if max_depth:
        rows = rows.where(F.size(F.split("path", "/")) <= max_depth)
    if glob and "/" in glob:
        rows = rows.where(F.col("path").rlike(glob_regex(glob)))
    if not no_ignore and os.path.isdir(root):
        patterns = ignore_patterns(root)
        if patterns:
            rows = rows.where(~ignored(F.col("path"), patterns))
    lang = schema.language_of_path(F.col("path"))
    if languages is not None:
        rows = rows.where(lang.isin(*(schema.ALIASES.get(x.lower(), x.lower()) for x in languages)))
    return rows.select(F.xxhash64("path").alias("file_id"), "path", lang.alias("language"), "content", F.col("length").alias("n_bytes"))


def expand(spec: str, extensions: Iterable[str] = ()) -> list[str]:
    """Local files of a file name, a folder (its files with the extensions), or a glob in the last step."""
    p = Path(spec)
    if p.is_file():
        return [str(p)]
    if p.is_dir():
        wanted = {e.lower().lstrip(".") for e in extensions}
        return sorted(str(f) for f in p.rglob("*") if f.is_file() and (not wanted or f.suffix.lower().lstrip(".") in wanted))
    return sorted(str(f) for f in p.parent.iterdir() if f.is_file() and fnmatch.fnmatch(f.name, p.name)) if p.parent.is_dir() else []
