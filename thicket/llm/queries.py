"""Queries of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.snapshots import plain_path
from ..session import table
from . import encoding_repair, languages, mixing, packing, secrets, source_origin, syntax, tokens


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding_repair.damage(table(spark, d, "documents"), "doc_id", "text", F.col("source")).select("doc_id").distinct()


def p10_repaired(spark: SparkSession, d: str) -> DataFrame:
    return encoding_repair.repair(table(spark, d, "documents"), "doc_id", "text", F.col("source"))


def file_origins(spark: SparkSession, d: str) -> DataFrame:
    libs = table(spark, d, "library_files")
    name = F.concat_ws(" ", "lib", "version", "file_name")
    return source_origin.origins(latest_files(spark, d, "path", "content"), "file_id", "path", "content", libs, name, "content")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return file_origins(spark, d).select("file_id")


def p1_origins(spark: SparkSession, d: str) -> DataFrame:
    return file_origins(spark, d)


def p1_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How many files each kind of evidence decided, and its share of all that aren't hand-written."""
    kind = F.substring_index("evidence", " ", 1).alias("evidence")
    per = file_origins(spark, d).groupBy(kind, "origin").agg(F.count(F.lit(1)).alias("n_files"))
    whole = per.select(F.sum("n_files"))
    return per.withColumn("share", F.col("n_files") / whole.scalar())


def p1_hand_written_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings in hand-written files: rows per rule, by files of the latest state."""
    origins = file_origins(spark, d).select("file_id")
    hand = latest_scans(spark, d).join(origins, "file_id", "left_anti").select(plain_path(F.col("path")).alias("file_path"), "file_id")
    f = table(spark, d, "findings").where("file_path is not null").select("rule_id", plain_path(F.col("file_path")).alias("file_path"))
    # one count per rule and path first, so that a path with many findings meets its file once
    per = f.groupBy("rule_id", "file_path").agg(F.count(F.lit(1)).alias("n"))
    return per.join(hand, "file_path").groupBy("rule_id").agg(F.sum("n").alias("n_findings"), F.countDistinct("file_id").alias("n_files"))


#: Messages of parse errors that are about syntax, not about size, time, depth or grammars.
SYNTAX_MESSAGE = r"(?i)\bsyntax\s*error\b|\bunexpected\s+(token|end|eof|'|\")|\bunterminated\b|\bmissing\s+['\"]|\bparse\s*error\b|\bunbalanced\b"


def file_faults(spark: SparkSession, d: str) -> DataFrame:
    """file_id, repo, language (by extension), fault ("" if valid, null if it can't be told) of each file's latest state.

    A file whose text wasn't kept is judged by the messages of its scan.
    """
    files = latest_files(spark, d, "path", "repo", "content")
    found = syntax.faults(files, "file_id", "path", "content")
    kept = files.where("content is not null").select("file_id", "repo", "path").join(found, "file_id", "left")
    told = table(spark, d, "parse_errors").where(F.col("message").rlike(SYNTAX_MESSAGE)).select("scan_id", plain_path(F.col("file_path")).alias("path")).distinct()
    lost = files.where("content is null").select("file_id", "repo", "scan_id", plain_path(F.col("path")).alias("path"))
    lost = lost.join(told.withColumn("fault", F.lit("message")), ["scan_id", "path"], "left").select("file_id", "repo", "path", F.coalesce("fault", F.lit("")).alias("fault"))
    both = kept.select("file_id", "repo", "path", "fault").unionByName(lost)
    return both.select("file_id", "repo", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("language"), "fault")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    files = latest_files(spark, d, "path", "content")
    found = syntax.faults(files, "file_id", "path", "content").where("fault <> ''").select("file_id")
    told = table(spark, d, "parse_errors").where(F.col("message").rlike(SYNTAX_MESSAGE)).select("scan_id", plain_path(F.col("file_path")).alias("path")).distinct()
    lost = latest_scans(spark, d).where("not kept").select("file_id", "scan_id", plain_path(F.col("path")).alias("path"))
    return found.unionByName(lost.join(told, ["scan_id", "path"], "left_semi").select("file_id"))


def p3_faults(spark: SparkSession, d: str) -> DataFrame:
    """How many files each part of the check found invalid, per language."""
    return file_faults(spark, d).where("fault <> ''").groupBy("language", "fault").agg(F.count(F.lit(1)).alias("n_files"))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Files, files with a verdict, invalid files and their share per repository and language, beside what the scans reported.

    A file of a language without a grammar whose text was kept has no verdict; where no file has one
    the share is null.
    """
    rates = file_faults(spark, d).groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n_files"), F.count("fault").alias("n_judged"), F.count_if(F.col("fault") != "").alias("n_invalid"))
    stats = table(spark, d, "scan_stats").dropDuplicates(["scan_id", "repo"])
    reported = stats.groupBy("repo").agg(F.max_by("parse_errors", F.struct("started_at", "scan_id")).alias("repo_reported"))
    return rates.join(reported, "repo", "left").withColumn("invalid_share", F.try_divide(F.col("n_invalid"), F.col("n_judged")))


def language_model(spark: SparkSession, d: str) -> languages.Classifier:
    return languages.fit(table(spark, d, "documents"), "doc_id", "text", F.col("lang"))


#: Kinds of nodes whose text is a comment or a string.
TEXT_KINDS = "Comment|String|TemplateLiteral"


def node_phrases(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "uast_nodes").where(F.col("kind").rlike(TEXT_KINDS)).select("file_id", "node_id", "text", "language")
    nodes = nodes.where(F.col("text").rlike(languages.MAYBE)).distinct()
    return languages.find_phrases(nodes, ["file_id", "node_id"], "text", "language", language_model(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.main_language(node_phrases(spark, d), ["file_id", "node_id"]).select("file_id", "node_id", "text_lang")


def p7_file_shares(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of phrases of each language per file and their share of the file's bytes (null if its size is unknown)."""
    per = node_phrases(spark, d).groupBy("file_id", "lang").agg(F.sum("n_bytes").alias("n_bytes"), F.countDistinct("node_id").alias("n_nodes"))
    size = table(spark, d, "uast_nodes").where("node_id = 0").groupBy("file_id").agg(F.max("end_offset").alias("file_bytes"))
    return per.join(size, "file_id", "left").withColumn("share", F.try_divide(F.col("n_bytes"), F.col("file_bytes")))


def p7_source_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Phrases per file and language in the whole texts of scanned files (latest state)."""
    f = latest_files(spark, d, "language", "content").where("content is not null")
    found = languages.find_phrases(f, ["file_id"], "content", "language", language_model(spark, d))
    return found.groupBy("file_id", "lang").agg(F.count(F.lit(1)).alias("n_phrases"), F.sum("n_bytes").alias("n_bytes"))


def latest_scans(spark: SparkSession, d: str) -> DataFrame:
    """As latest_files, without the texts: file_id, scan_id, path, and whether the text was kept."""
    f = table(spark, d, "file_scans").select("file_id", "scan_id", "path", "scanned_at", "ingested_at", F.col("content").isNotNull().alias("kept"))
    last = f.groupBy("file_id").agg(F.max(F.struct("scanned_at", "ingested_at", "scan_id", "kept", "path")).alias("s"))
    return last.select("file_id", "s.scan_id", "s.path", "s.kept")


def latest_files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """file_id, scan_id and `columns` of the latest scan of each file; ties go to the latest arrival, then the greatest values."""
    f = table(spark, d, "file_scans")
    last = f.groupBy("file_id").agg(F.max(F.struct("scanned_at", "ingested_at", "scan_id", *columns)).alias("s"))
    return last.select("file_id", "s.scan_id", *(f"s.{c}" for c in columns))


def credential_rows(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and captures with credentials: table_name, file_id, item_id, kinds, n_found, redacted."""
    nodes = table(spark, d, "uast_nodes").select("file_id", "node_id", "parent_id", "sib_idx", "kind", "name", "text")
    words = secrets.dictionary(nodes.where("kind = 'Identifier'"), F.col("text"))
    near = nodes.where("text is not null").select("file_id", "node_id", "text").join(secrets.node_contexts(nodes), ["file_id", "node_id"], "left")
    # repeated rows fall together only among what is to be looked at
    near = near.where(F.col("context").isNotNull() | F.col("text").rlike(secrets.MAYBE)).distinct()
    rows = near.select(F.lit("uast_nodes").alias("table_name"), "file_id", F.col("node_id").cast("bigint").alias("item_id"), "text", "context")
    caps = table(spark, d, "captures").select(F.lit("captures").alias("table_name"), "file_id", F.col("capture_id").alias("item_id"), "text", F.lit(None).cast("string").alias("context")).where(F.col("text").rlike(secrets.MAYBE)).distinct()
    return secrets.credentials(rows.unionByName(caps), ["table_name", "file_id", "item_id"], "text", "context", words)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return credential_rows(spark, d).select("table_name", "file_id", "item_id").distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credential_rows(spark, d).select("table_name", "file_id", "item_id", F.array_join("kinds", ",").alias("kinds"), "n_found", "redacted")


def document_sizes(spark: SparkSession, d: str) -> DataFrame:
    return tokens.sizes(table(spark, d, "documents"), "doc_id", "text", "source")


def p8_bins(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(document_sizes(spark, d), "doc_id", table(spark, d, "pack_limits"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(p8_bins(spark, d), table(spark, d, "pack_limits"))


def mixed_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the distinct texts of each source, so that copies don't go beyond a text's repeats.

    Copies are dropped before texts are tokenised; the record with the smallest id stands for them.
    """
    docs = table(spark, d, "documents").where("text <> ''").withColumn("source", mixing.plain_source(F.col("source")))
    first = docs.groupBy("source", F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return tokens.sizes(docs.join(first, "doc_id", "left_semi"), "doc_id", "text", "source")


def p9_sample(spark: SparkSession, d: str) -> DataFrame:
    return mixing.draw(mixed_sizes(spark, d), "doc_id", table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets = mixed_sizes(spark, d), table(spark, d, "mix_targets")
    return mixing.shares(mixing.draw(sizes, "doc_id", targets), sizes, targets)


QUERIES = {q.__name__: q for q in (p1_found, p1_origins, p1_evidence, p1_hand_written_findings, p3_found, p3_rates, p3_faults, p5_found, p5_redacted, p7_found, p7_file_shares, p7_source_phrases, p8_bins, p8_report, p9_sample, p9_shares, p10_found, p10_repaired)}
SQL: dict[str, str] = {}
