"""Reports: text, JSON, SARIF, tree dumps, rewritten sources. All are DataFrames of lines or documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape, preview, severity_level

# Severities in SARIF.
SARIF_LEVELS = {"error": "error", "warning": "warning", "info": "note", "hint": "note"}


def sarif_level(severity: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(severity, F.lit("warning"))))
    return F.when(s == "error", "error").when(s == "warning", "warning").otherwise("note")


def text_lines(findings: DataFrame) -> DataFrame:
    """line: path:line:column: severity [rule]: message, and a fix line where there is one; columns from 1."""
    head = F.format_string("%s:%d:%d: %s [%s]: %s", F.coalesce("file_path", F.lit("<stdin>")), "start_line", F.col("start_column") + 1, "severity", F.coalesce("rule_id", F.lit("")), "message")
    fix = F.when(F.coalesce("fix", F.lit("")) != "", F.concat(F.lit("\n  fix: "), "fix")).otherwise("")
    return findings.select("file_path", "start_line", "start_column", F.concat(head, fix).alias("line"))


def grouped_text(findings: DataFrame) -> DataFrame:
    """file_path, section, start_line, start_column, line: a report by file, to be written in that order.

    Section 0 is the file's heading, 1 its findings with a tag and a snippet of at most 100 characters, 2
    its count. Lines stay rows, so that a file with very many findings is no hot group.
    """
    snippet = preview(F.coalesce("message", F.lit("")), 100)
    line = F.format_string("  %d:%d [%s] %s: %s", "start_line", F.col("start_column") + 1, F.upper(F.coalesce("severity", F.lit("warning"))), F.coalesce("rule_id", F.lit("")), snippet)
    body = findings.select("file_path", F.lit(1).alias("section"), "start_line", "start_column", line.alias("line"))
    none = F.lit(None).cast("int")
    counts = findings.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    head = counts.select("file_path", F.lit(0).alias("section"), none.alias("start_line"), none.alias("start_column"), F.coalesce("file_path", F.lit("<stdin>")).alias("line"))
    foot = counts.select("file_path", F.lit(2).alias("section"), none.alias("start_line"), none.alias("start_column"), F.format_string("%d finding(s)", "n").alias("line"))
    return head.unionByName(body).unionByName(foot)


def json_lines(findings: DataFrame, detailed: bool = False) -> DataFrame:
    """json: one object per finding; `detailed` has location and source parts, url and tags where given."""
    if not detailed:
        return findings.select(F.to_json(F.struct(*findings.columns)).alias("json"))
    location = F.struct(F.col("file_path").alias("file"), F.struct(F.col("start_line").alias("line"), F.col("start_column").alias("column")).alias("start"), F.struct(F.col("end_line").alias("line"), F.col("end_column").alias("column")).alias("end"))
    more = [c for c in ("fix", "url", "tags", "captures") if c in findings.columns]
    return findings.select(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "severity", "message", location.alias("location"), *more)).alias("json"))


def sarif_results(findings: DataFrame, *keys: str) -> DataFrame:
    """Results as rows: `keys` (of the log), rule_id, level, message, uri, region (columns from 1, bytes)."""
    uri = F.replace(F.coalesce("file_path", F.lit("stdin")), F.lit("\\"), F.lit("/"))
    return findings.select(*keys, "rule_id", sarif_level(F.col("severity")).alias("level"), "message", uri.alias("uri"), "start_line", (F.col("start_column") + 1).alias("start_column"), "end_line", (F.col("end_column") + 1).alias("end_column"), F.col("start_offset").alias("byte_offset"), F.greatest(F.col("end_offset") - F.col("start_offset"), F.lit(0)).alias("byte_length"), *[c for c in ("fix", "captures") if c in findings.columns])


def sarif_artifacts(findings: DataFrame) -> DataFrame:
    """uri, first: distinct artifacts with the place (line) of their first finding."""
    r = sarif_results(findings)
    return r.groupBy("uri").agg(F.min(F.struct("start_line", "start_column")).alias("_f"), F.count(F.lit(1)).alias("n_results")).select("uri", F.col("_f.start_line").alias("first_line"), "n_results")


def sarif_rules(rules: DataFrame) -> DataFrame:
    """id, name, level, text, help of the rules of a run."""
    return rules.select(F.col("rule_id").alias("id"), F.col("rule_id").alias("name"), sarif_level(F.col("severity")).alias("level"), F.col("message").alias("text"), F.col("note").alias("help"), F.col("url").alias("help_uri"), "tags")


def sarif_rules_of_results(findings: DataFrame) -> DataFrame:
    """Rules as far as the results tell: distinct ids with the level of each one's first result."""
    place = F.struct("file_path", "start_line", "start_column")
    return findings.where("rule_id is not null").groupBy("rule_id").agg(F.min_by("severity", place).alias("s")).select(F.col("rule_id").alias("id"), sarif_level(F.col("s")).alias("level"))


def write_sarif(findings: DataFrame, rules: DataFrame | None, folder: str, tool: str = "thicket", version: str = "0.1.0") -> None:
    """A SARIF log as a folder of one document per partition of results.

    A result is one JSON text; partitions become runs of their own file (`part-*.sarif`), so no task
    gathers all results. Rules, a small table, are repeated in each run.
    """
    import json

    r = sarif_results(findings)
    region = F.struct(F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn"), F.col("end_line").alias("endLine"), F.col("end_column").alias("endColumn"), F.col("byte_offset").alias("byteOffset"), F.col("byte_length").alias("byteLength"))
    place = F.struct(F.struct(F.struct(F.col("uri").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    props = [F.col("captures").alias("properties")] if "captures" in r.columns else []
    fixes = []
    if "fix" in r.columns:
        change = F.struct(F.struct(F.col("uri").alias("uri")).alias("artifactLocation"), F.array(F.struct(region.alias("deletedRegion"), F.struct(F.col("fix").alias("text")).alias("insertedContent"))).alias("replacements"))
        fixes = [F.when(F.coalesce("fix", F.lit("")) != "", F.array(F.struct(F.array(change).alias("artifactChanges")))).alias("fixes")]
    result = F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), *fixes, *props))
    meta = (sarif_rules(rules) if rules is not None else sarif_rules_of_results(findings)).toJSON().collect()
    described = []
    for x in map(json.loads, meta):
        described.append({"id": x["id"], "shortDescription": {"text": x.get("text") or x["id"]}, "defaultConfiguration": {"level": x["level"]}} | ({"helpUri": x["help_uri"]} if x.get("help_uri") else {}))
    head = json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json"})[:-1]
    driver = json.dumps({"driver": {"name": tool, "version": version, "rules": described}})

    def documents(batches):
        import pandas as pd

        rows = [x for b in batches for x in b["result"]]
        yield pd.DataFrame({"value": [f'{head}, "runs": [{{"tool": {driver}, "results": [' + ",\n".join(rows) + "]}]}"]})

    r.select(result.alias("result")).mapInPandas(documents, "value string").write.mode("overwrite").text(folder)


def tree_lines(nodes: DataFrame, indent: int = 2, spans: bool = False, texts: bool = True) -> DataFrame:
    """file_id, node_id, line: one line per node, indented by depth."""
    line = F.concat(F.repeat(F.lit(" "), F.col("depth") * indent), F.coalesce("kind", F.lit("Unknown")))
    if spans:
        line = F.concat(line, F.format_string(" [%d:%d-%d:%d]", "start_line", "start_column", "end_line", "end_column"))
    if texts:
        line = F.concat(line, F.when(F.col("child_count") == 0, F.concat(F.lit(' "'), escape(preview(F.coalesce("text", F.lit("")), 100)), F.lit('"'))).otherwise(""))
    return nodes.select("file_id", "node_id", line.alias("line"))


def match_lines(matches: DataFrame) -> DataFrame:
    """line: path:line:column and the first line of the match; columns from 1."""
    return matches.select(F.format_string("%s:%d:%d  %s", "path", "start_line", F.col("start_column") + 1, preview(F.coalesce("text", "name", F.lit("")), 100)).alias("line"))


def count_lines(matches: DataFrame) -> DataFrame:
    return matches.groupBy("path").agg(F.count(F.lit(1)).alias("n")).select(F.concat("path", F.lit(":"), "n").alias("line"))


def run_json(matches: DataFrame, files_scanned: int) -> DataFrame:
    """json of one row per file with matches: path, count and matches; the totals are in every row."""
    item = F.struct("start_line", "start_column", "end_line", "end_column", "kind", preview(F.coalesce("text", F.lit("")), 100).alias("text"))
    per = matches.groupBy("path").agg(F.array_sort(F.collect_list(item)).alias("matches"))
    totals = matches.agg(F.count(F.lit(1)).alias("total_matches"), F.countDistinct("path").alias("files_with_matches"))
    n, f = totals.select("total_matches").scalar(), totals.select("files_with_matches").scalar()
    return per.select(F.to_json(F.struct(F.lit(files_scanned).alias("files_scanned"), n.alias("total_matches"), f.alias("files_with_matches"), "path", "matches")).alias("json"))


def documents(nodes: DataFrame, files: DataFrame, errors: DataFrame) -> DataFrame:
    """file_id, doc: a JSON document per file with language, errors and nodes in pre-order.

    The nodes of one file are one row; a file's tree is bounded by the file.
    """
    item = F.struct("node_id", "parent_id", "kind", "native_type", "name", "text", "start_line", "start_column", "end_line", "end_column", "properties")
    per = nodes.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(F.col("node_id").alias("_o"), F.to_json(item).alias("j")))).alias("ns"))
    errs = errors.groupBy("file_id").agg(F.collect_list(F.struct("message", "severity")).alias("errors"))
    both = files.select("file_id", "path", "language").join(per, "file_id").join(errs, "file_id", "left")
    nodes_json = F.concat(F.lit("["), F.array_join(F.transform("ns", lambda n: n["j"]), ","), F.lit("]"))
    head = F.to_json(F.struct(F.lit("1.0").alias("version"), "language", F.col("path").alias("sourcePath"), (F.coalesce(F.size("errors"), F.lit(0)) > 0).alias("hasErrors"), F.coalesce("errors", F.array().cast("array<struct<message:string,severity:string>>")).alias("errors")))
    doc = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"nodes":'), nodes_json, F.lit("}"))
    return both.select("file_id", doc.alias("doc"))


def rewritten(fixed: DataFrame, files: DataFrame) -> DataFrame:
    """path, new_source of the files that changed; to be written to a new place."""
    return fixed.where("has_changes").join(files.select("file_id", "path"), "file_id").select("path", F.col("new_content").alias("new_source"))


def exit_code(findings: DataFrame, fail_on: str = "error") -> int:
    """1 if there is a finding of the severity or above, else 0."""
    n = {"hint": 0, "info": 1, "warning": 2, "error": 3}[fail_on]
    return int(not findings.where(severity_level(F.col("severity")) >= n).isEmpty())
