"""Command line: parse, run, scan, query, languages, verify."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import api
from .sources import files as file_source
from .sources import frontends, rules as rule_source, sinks


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="thicket", description="structural search over source code on Spark")
    p.add_argument("-q", "--quiet", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def walk(s):
        s.add_argument("path")
        s.add_argument("--hidden", action="store_true")
        s.add_argument("--no-ignore", action="store_true")
        s.add_argument("--max-depth", type=int, default=0)
        s.add_argument("-l", "--language")
        s.add_argument("--format", choices=("text", "json", "count"), default="text")

    s = sub.add_parser("parse", help="print the trees of files")
    walk(s)
    s.add_argument("--spans", action="store_true")
    s = sub.add_parser("run", help="find a pattern")
    s.add_argument("-p", "--pattern", required=True)
    walk(s)
    s = sub.add_parser("query", help="run an S-expression query")
    s.add_argument("-e", "--expression", required=True)
    walk(s)
    s = sub.add_parser("scan", help="scan with rules")
    walk(s)
    s.add_argument("-r", "--rules")
    s.add_argument("--ruleset", choices=rule_source.RULESETS, default="none")
    s.add_argument("-c", "--config")
    s.add_argument("-s", "--severity", choices=("hint", "info", "warning", "error"))
    s.add_argument("--exact-severity", action="store_true")
    s.add_argument("--filter", dest="rule_id")
    s.add_argument("--sarif", help="folder for a SARIF log")
    s.add_argument("--fix-to", help="folder for rewritten sources")
    s.add_argument("--fail-on-issues", action="store_true")
    sub.add_parser("languages", help="list languages").add_argument("--format", choices=("text", "json"), default="text")
    sub.add_parser("verify", help="check the front ends")
    return p


def read(spark: SparkSession, a: argparse.Namespace):
    return file_source.read_files(spark, a.path, hidden=a.hidden, no_ignore=a.no_ignore, max_depth=a.max_depth, languages=[a.language] if a.language else None)


def rules_for(a: argparse.Namespace) -> list[rule_source.Rule]:
    rules = rule_source.ruleset(a.ruleset)
    rules = rule_source.merge(rules, rule_source.load_rules(a.rules) if a.rules else [] if rules else rule_source.discover_rules("."))
    config = a.config or rule_source.discover_config(".")
    if config:
        import yaml

        with open(config, encoding="utf-8") as f:
            rules = rule_source.apply_config(rules, yaml.safe_load(f) or {})
    return rules


def lines(df, column: str, out) -> None:
    for r in df.toLocalIterator():
        print(r[column], file=out)


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    a = build_parser().parse_args(args)
    out = out or sys.stdout
    if a.command == "languages":
        rows = [{"name": lang, "extensions": api.extensions_of_language(lang), "front_end": status} for lang, status in frontends.self_check()]
        print(json.dumps({"total": len(rows), "languages": rows}) if a.format == "json" else "\n".join(f"{r['name']}: {' '.join(r['extensions'])}" for r in rows), file=out)
        return 0
    if a.command == "verify":
        for lang, status in frontends.self_check():
            print(f"{lang}: {status}", file=out)
        return 0
    spark = spark or SparkSession.builder.appName("thicket").getOrCreate()
    files = read(spark, a)
    nodes = frontends.parse(files)
    paths = files.select("file_id", "path")
    if a.command == "parse":
        lines(sinks.tree_lines(nodes, spans=a.spans).orderBy("file_id", "node_id"), "line", out)
        return 0
    if a.command in ("run", "query"):
        keys = api.find(nodes, a.pattern, a.language or "*") if a.command == "run" else api.query(nodes, a.expression)
        found = nodes.join(keys.select("file_id", "node_id").distinct(), ["file_id", "node_id"], "left_semi").join(paths, "file_id").orderBy("path", "node_id")
        if a.format == "json":
            lines(sinks.run_json(found, files.count()), "json", out)
        else:
            lines(sinks.count_lines(found) if a.format == "count" else sinks.match_lines(found), "line", out)
        return int(found.isEmpty())
    from .operators import rules as compiled

    rules = rules_for(a)
    found = compiled.scan(nodes, rules, paths, a.severity, a.exact_severity, a.rule_id).join(paths.withColumnRenamed("path", "file_path"), "file_id").persist()
    ordered = found.orderBy("file_path", "start_line", "start_column", "rule_id")
    if a.sarif:
        sinks.write_sarif(found, rule_source.to_frame(spark, rules), a.sarif)
    if a.fix_to:
        sinks.rewritten(api.fix(found, files), files).write.mode("overwrite").parquet(a.fix_to)
    if a.format == "json":
        lines(sinks.json_lines(ordered), "json", out)
    elif a.format == "count":
        lines(found.groupBy("file_path").count().select(F.concat("file_path", F.lit(":"), "count").alias("line")), "line", out)
    else:
        lines(sinks.text_lines(ordered), "line", out)
    return sinks.exit_code(found) if a.fail_on_issues else 0


if __name__ == "__main__":
    sys.exit(main())
