"""The library in short: parse, find, query, scan, fix and report."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .operators import fixes, patterns, sexpr, stats, tree
from .operators import rules as compiled
from .sources import files as file_source
from .sources import frontends, rules as rule_source, sinks
from .sources.frontends import register as register_frontend
from .sources.rules import Rule

__all__ = ["Scanner", "extensions_of_language", "find", "fix", "language_for_extension", "parse", "query", "read", "register_frontend", "scan", "supported_languages"]


def supported_languages() -> list[str]:
    return sorted(schema.LANGUAGES)


def language_for_extension(extension: str) -> str | None:
    e = extension.lower().lstrip(".")
    return next((lang for lang, exts in schema.LANGUAGES.items() if e in exts.split()), None)


def extensions_of_language(language: str) -> list[str]:
    return schema.LANGUAGES.get(schema.ALIASES.get(language.lower(), language.lower()), "").split()


def read(spark: SparkSession, root: str, **options) -> DataFrame:
    return file_source.read_files(spark, root, **options)


def parse(files: DataFrame, **options) -> DataFrame:
    """Nodes of files; see sources.frontends.parse."""
    return frontends.parse(files, **options)


def find(nodes: DataFrame, pattern: str, language: str = "*") -> DataFrame:
    """Matches of a pattern text: file_id, node_id, captures."""
    p = patterns.parse(pattern, language)
    nodes = nodes if language == "*" else nodes.where(schema.plain_language(F.col("language")) == schema.ALIASES.get(language.lower(), language.lower()))
    return sexpr.root_nodes(nodes, p.text).withColumn("captures", F.array().cast(f"array<{patterns.CAPTURE.simpleString()}>")) if isinstance(p, patterns.Query) else patterns.find(nodes, p)


def query(nodes: DataFrame, text: str) -> DataFrame:
    return sexpr.run(nodes, text)


def scan(nodes: DataFrame, rules: Iterable[Rule], **options) -> DataFrame:
    return compiled.scan(nodes, rules, **options)


def fix(findings: DataFrame, files: DataFrame, overlapping: bool = False) -> DataFrame:
    return fixes.apply_fixes(findings, files, overlapping)


class Scanner:
    """Rules that are loaded once and scanned with many times."""

    def __init__(self) -> None:
        self.rules: list[Rule] = []

    def load_rules(self, path: str) -> "Scanner":
        self.rules = rule_source.merge(self.rules, rule_source.load_rules(path))
        return self

    def load_rules_from_string(self, text: str) -> "Scanner":
        self.rules = rule_source.merge(self.rules, rule_source.parse_rules(text))
        return self

    @property
    def rule_count(self) -> int:
        return len(self.rules)

    @property
    def rule_ids(self) -> list[str]:
        return [r.id for r in self.rules]

    def clear_rules(self) -> None:
        self.rules = []

    def scan(self, nodes: DataFrame, **options) -> DataFrame:
        return compiled.scan(nodes, self.rules, **options)

    def scan_files(self, files: DataFrame, **options) -> DataFrame:
        """Findings of files with their paths: parsed, scanned, joined."""
        found = self.scan(frontends.parse(files), files=files.select("file_id", "path"), **options)
        return found.join(files.select("file_id", F.col("path").alias("file_path")), "file_id")

    def summary(self, findings: DataFrame) -> DataFrame:
        return stats.severity_summary(findings)

    def scan_to_sarif(self, findings: DataFrame, folder: str) -> None:
        spark = findings.sparkSession
        sinks.write_sarif(findings, rule_source.to_frame(spark, self.rules), folder)


def ancestors_of(nodes: DataFrame, kind: str) -> DataFrame:
    """Nearest enclosing node of a kind for every node that has one."""
    return tree.nearest_ancestor(nodes, F.lower("kind") == kind.lower())
