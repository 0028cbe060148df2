"""Counts, summaries and orders of findings, nodes and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import severity_level


def match_count(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count(F.lit(1)).alias("n_matches"))


def per_file(findings: DataFrame, path: str = "file_path") -> DataFrame:
    """Files with at least one finding, and how many."""
    return findings.groupBy(path).agg(F.count(F.lit(1)).alias("n_findings"))


def any_match(matches: DataFrame) -> bool:
    """Whether there is a match; stops at the first."""
    return not matches.isEmpty()


def severity_summary(findings: DataFrame) -> DataFrame:
    """Findings per severity and over all (severity `total`); null counts as warning."""
    s = F.lower(F.trim(F.coalesce("severity", F.lit("warning"))))
    return findings.select(s.alias("severity")).rollup("severity").agg(F.count(F.lit(1)).alias("n_findings"), F.grouping("severity").alias("_all")).select(F.when(F.col("_all") == 1, "total").otherwise(F.col("severity")).alias("severity"), "n_findings")


def rule_severity_rollup(findings: DataFrame) -> DataFrame:
    """Findings per rule and severity with subtotals (null where summed over)."""
    s = F.lower(F.trim(F.coalesce("severity", F.lit("warning"))))
    rows = findings.select(F.coalesce("rule_id", F.lit("")).alias("rule_id"), s.alias("severity"))
    return rows.rollup("rule_id", "severity").agg(F.count(F.lit(1)).alias("n_findings"))


def histogram(nodes: DataFrame, column: str = "native_type", top: int | None = 50) -> DataFrame:
    """Count and share of each value, most frequent first (ties by value); the `top` ones, or all."""
    counts = nodes.groupBy(column).agg(F.count(F.lit(1)).alias("n_nodes"))
    total = counts.agg(F.sum("n_nodes").alias("t"))
    out = counts.withColumn("share", F.col("n_nodes") / total.scalar())
    return out.orderBy(F.desc("n_nodes"), F.col(column).asc_nulls_first()).limit(top) if top is not None else out


def filter_nodes(nodes: DataFrame, native_type: str | None = None, named: bool | None = None, max_depth: int | None = None) -> DataFrame:
    out = nodes
    if native_type is not None:
        out = out.where(F.col("native_type") == native_type)
    if named is not None:
        out = out.where(F.col("is_named") == named)
    return out if max_depth is None else out.where(F.col("depth") <= max_depth)


def scan_stats(files: DataFrame, findings: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: files scanned, with findings and skipped (no text), findings, files with errors."""
    f = files.agg(F.count(F.lit(1)).alias("files_scanned"), F.count_if(F.col("content").isNull()).alias("files_skipped"))
    m = findings.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("files_matched"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_matches"))
    e = errors.select("file_id").distinct().agg(F.count(F.lit(1)).alias("parse_errors"))
    # three rows of one: joined on a constant
    one = F.lit(1).alias("_k")
    return f.select("*", one).join(m.select("*", one), "_k").join(e.select("*", one), "_k").drop("_k")


def distinct_values(findings: DataFrame, column: str) -> DataFrame:
    return findings.select(column).where(F.col(column).isNotNull()).distinct()


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("file_path", "start_line", "start_column", "rule_id")


def first_severity(findings: DataFrame) -> DataFrame:
    """Severity of each rule's first finding (by path, line, column)."""
    place = F.struct("file_path", "start_line", "start_column", "ordinal")
    return findings.where("rule_id is not null").groupBy("rule_id").agg(F.min_by("severity", place).alias("severity"))


def at_least(findings: DataFrame, severity: str, exact: bool = False) -> DataFrame:
    """Findings of a severity or above it, or of just that one."""
    n = {"hint": 0, "info": 1, "warning": 2, "error": 3}[severity]
    level = severity_level(F.col("severity"))
    return findings.where(level == n if exact else level >= n)


def first_in_group(findings: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return findings.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
