"""Text functions of messages, previews, spans and paths, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIXES = "$§∀"
#: Severities with their levels.
SEVERITIES = {"hint": 0, "info": 1, "warning": 2, "error": 3}


def severity_level(c: Column) -> Column:
    """0 to 3; null counts as warning, an unknown word is null."""
    s = F.lower(F.trim(F.coalesce(c, F.lit("warning"))))
    out = F.lit(None).cast("int")
    for name, level in SEVERITIES.items():
        out = F.when(s == name, level).otherwise(out)
    return out


def severity_name(level: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, n in SEVERITIES.items():
        out = F.when(level == n, name).otherwise(out)
    return out


def variables(template: str) -> list[str]:
    """Names of the metavariables in a template, the longest first."""
    return sorted({m.group(1) for m in re.finditer(rf"[{PREFIXES}]+([A-Za-z_][A-Za-z0-9_]*)", template)}, key=lambda n: (-len(n), n))


def interpolate(template: Column, captures: Column) -> Column:
    """A template with $NAME, §NAME or ∀NAME (prefix once or more) replaced by the capture's text.

    `captures` is a map from name to text. Every name ends where its letters, digits and underscores
    end, so $A never touches $AB; names without a capture stay. Null template: null.
    """
    pattern = F.lit(rf"[{PREFIXES}]+[A-Za-z_][A-Za-z0-9_]*")
    found = F.regexp_extract_all(template, pattern, F.lit(0))
    between = F.split(template, rf"[{PREFIXES}]+[A-Za-z_][A-Za-z0-9_]*", -1)
    name = lambda v: F.regexp_replace(v, rf"^[{PREFIXES}]+", "")
    values = F.transform(found, lambda v: F.coalesce(captures[name(v)], v))
    # pieces and values in turn
    return F.concat(between[0], F.array_join(F.transform(values, lambda v, i: F.concat(v, F.element_at(between, (i + 2).cast("int")))), ""))


def interpolate_first(template: Column, captures: Column, matched: Column, many: str = " ") -> Column:
    """Rewrite template: as `interpolate`, and the name _ stands for the matched text."""
    return interpolate(template, F.map_concat(captures, F.create_map(F.lit("_"), matched)))


def preview(c: Column, limit: int = 100) -> Column:
    """First line, cut after `limit` characters with three dots."""
    line = F.substring_index(F.regexp_replace(c, "\r\n?", "\n"), "\n", 1)
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit), F.lit("..."))).otherwise(line)


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))


def snake_case(c: Column) -> Column:
    """PascalCase as snake_case: a small underscore before every capital but the first."""
    return F.lower(F.regexp_replace(c, r"(?<!^)([A-Z])", "_$1"))


def span_length(start: Column, end: Column) -> Column:
    """Bytes of a span, never negative."""
    return F.greatest(end - start, F.lit(0))


def span_valid(start_line: Column) -> Column:
    return F.coalesce(start_line > 0, F.lit(False))


def span_display() -> Column:
    """start:column-end:column of the columns of a span."""
    return F.concat(F.col("start_line"), F.lit(":"), F.col("start_column"), F.lit("-"), F.col("end_line"), F.lit(":"), F.col("end_column"))


def merge_spans(prefix: str = "") -> list[Column]:
    """Aggregates that give the smallest span over all of a group's."""
    first = F.min(F.struct("start_offset", "start_line", "start_column"))
    last = F.max(F.struct("end_offset", "end_line", "end_column"))
    return [first["start_line"].alias(f"{prefix}start_line"), first["start_column"].alias(f"{prefix}start_column"), last["end_line"].alias(f"{prefix}end_line"), last["end_column"].alias(f"{prefix}end_column"), first["start_offset"].alias(f"{prefix}start_offset"), last["end_offset"].alias(f"{prefix}end_offset")]


def offset_to_line(text: Column, offset: Column) -> Column:
    """1-based line of a character offset; null outside the text."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return F.when((offset >= 0) & (offset <= F.length(text)), line)


def offset_to_column(text: Column, offset: Column) -> Column:
    """0-based column, in characters, of a character offset; null outside the text."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    return F.when((offset >= 0) & (offset <= F.length(text)), F.length(F.substring_index(before, "\n", -1)))


def line_to_offset(text: Column, line: Column, column: Column) -> Column:
    """Character offset of a 1-based line and 0-based column; null past the line's or text's end."""
    lines = F.split(text, "\n", -1)
    ahead = F.aggregate(F.slice(lines, F.lit(1), F.greatest(line - 1, F.lit(0)).cast("int")), F.lit(0), lambda a, x: a + F.length(x) + 1)
    there = F.try_element_at(lines, line.cast("int"))
    return F.when((line >= 1) & (column >= 0) & (column <= F.length(there)), ahead + column)


def relative_path(path: Column, root: str) -> Column:
    """Path below `root` with forward slashes."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    base = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(plain.startswith(base), F.substring(plain, len(base) + 1, 1 << 20)).otherwise(plain)


def same_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression: ** any depth, * and ? within a step, {a,b}, [..]."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        end = glob.find("}" if c == "{" else "]", i)
        if c == "{" and end > 0:
            out += "(?:" + "|".join(glob_regex(x)[1:-1] for x in glob[i + 1 : end].split(",")) + ")"
            i = end + 1
            continue
        if c == "[" and end > 0:
            out += "[" + glob[i + 1 : end].replace("!", "^", 1) + "]"
            i = end + 1
            continue
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
        i += 1
    return f"^{out}$"
