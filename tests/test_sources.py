"""Files, front ends, rules, reports, streams, command line."""

import io
import json

import pytest
from pyspark.sql import functions as F

from thicket import api, cli
from thicket.operators import rules as rl
from thicket.sources import files as fs
from thicket.sources import frontends, rules as rs, sinks
from thicket.streaming import scan_stream as ss

CODE = 'import os\n\n\ndef f(a, b=1):\n    # TODO: é\n    return eval(a) + g(a, "s")\n'


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, text in {"a.py": CODE, "sub/b.js": "// FIXME\nfoo(1);\n", "sub/c.json": '{"a": [1, null]}', ".hidden/x.py": "x = 1\n", "skip/d.py": "y = 2\n", "big.py": "z" * 100, "sub/__init__.py": "", ".gitignore": "skip/\n*.log\n!keep.log\n", "keep.log": "k", "no.log": "n"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(root)


def paths(df):
    return sorted(r["path"] for r in df.select("path").collect())


def test_read_files(spark, project):
    assert paths(fs.read_files(spark, project)) == ["a.py", "big.py", "keep.log", "sub/__init__.py", "sub/b.js", "sub/c.json"]
    assert "skip/d.py" in paths(fs.read_files(spark, project, no_ignore=True))
    assert ".hidden/x.py" in paths(fs.read_files(spark, project, hidden=True))
    assert paths(fs.read_files(spark, project, max_depth=1)) == ["a.py", "big.py", "keep.log"]
    assert paths(fs.read_files(spark, project, languages=["js"])) == ["sub/b.js"]
    assert paths(fs.read_files(spark, project, glob="*.json")) == ["sub/c.json"]
    small = {r["path"]: r["content"] for r in fs.read_files(spark, project, max_size=99).collect()}
    assert small["big.py"] is None and small["a.py"] == CODE
    assert [p.rsplit("/", 1)[1] for p in fs.expand(project + "/*.py")] == ["a.py", "big.py"] and len(fs.expand(project, ["py"])) == 5


def nodes_of(spark, text, language):
    return frontends.parse(spark.createDataFrame([(1, language, text)], "file_id bigint, language string, content string"))


def test_python_front_end(spark):
    rows = {r["node_id"]: r for r in nodes_of(spark, CODE, "python").collect()}
    assert rows[0]["kind"] == "Module" and rows[0]["last_id"] == len(rows) - 1
    fn = next(r for r in rows.values() if r["kind"] == "FunctionDeclaration")
    assert (fn["name"], fn["start_line"], fn["start_column"]) == ("f", 4, 0)
    calls = [r for r in rows.values() if r["kind"] == "CallExpression"]
    raw = CODE.encode()
    assert [raw[r["start_offset"] : r["end_offset"]].decode() for r in calls] == ["eval(a)", 'g(a, "s")']
    assert all(rows[r["parent_id"]]["node_id"] < r["node_id"] <= rows[r["parent_id"]]["last_id"] for r in rows.values() if r["parent_id"] is not None)
    assert any(r["native_type"] == "comment" and r["text"] == "# TODO: é" for r in rows.values())


def test_other_front_ends(spark):
    kinds = lambda t, lang: [r["native_type"] for r in nodes_of(spark, t, lang).orderBy("node_id").collect()]
    assert kinds('{"a": [1, null]}', "json") == ["document", "object", "pair", "string", "array", "number", "null"]
    assert kinds("<p id=x>a<br><b>c</p></i>", "html") == ["document", "element", "attribute", "text", "element", "element", "text", "ERROR"]
    assert kinds("f(1) // c\n\ny", "go") == ["source_file", "line", "identifier", "number", "comment", "line", "identifier"]
    assert nodes_of(spark, "def f(:\n", "python").first()["front_end"] == "lexical"
    bad = spark.createDataFrame([(1, "python", "x = (\n"), (2, "json", "{"), (3, "python", "x = 1"), (4, "python", None), (5, None, "a b")], "file_id bigint, language string, content string")
    assert sorted(r["file_id"] for r in frontends.parse_errors(bad).collect()) == [1, 2]
    assert frontends.parse(bad.where("file_id = 4")).count() == 0
    cut = nodes_of(spark, CODE, "python").count()
    short = frontends.parse(spark.createDataFrame([(1, "python", CODE)], "file_id bigint, language string, content string"), max_depth=1)
    assert short.count() < cut and short.where("properties['truncated'] = 'true'").count() > 0


def test_own_front_end(spark):
    api.register_frontend("dart", lambda t: frontends.node("program", 0, len(t)))
    try:
        assert nodes_of(spark, "void", "dart").first()["kind"] == "SourceFile"
    finally:
        frontends.REGISTRY.pop("dart")


def test_rules_sources(tmp_path):
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "a.yaml").write_text("id: a\nlanguage: go\nmessage: m\nrule: {kind: X}\n---\nrules:\n- {id: b, language: python, message: m, rule: {kind: X}, tags: [security]}\n")
    (tmp_path / "rules" / "b.yml").write_text("- {id: a, language: '*', message: second, rule: {kind: Y}}\n")
    loaded = rs.load_rules(str(tmp_path / "rules"))
    assert [r.id for r in loaded] == ["a", "b", "a"]
    assert [(r.id, r.message) for r in rs.merge(loaded)] == [("a", "second"), ("b", "m")]
    assert [r.id for r in rs.discover_rules(str(tmp_path))] == ["a", "b", "a"]
    assert rs.extensions_of(loaded[:2]) == ["go", "py", "pyi", "pyw"] and rs.extensions_of(loaded[2:]) == []
    out = rs.apply_config(loaded, {"disableRules": ["B"], "ruleOverrides": {"a": {"severity": "error"}}})
    assert [(r.id, r.severity, r.enabled) for r in out] == [("a", "error", True), ("b", "warning", False), ("a", "error", True)]
    assert {r.id for r in rs.ruleset("security")} == {"eval-call", "weak-hash"} and rs.ruleset("none") == []
    (tmp_path / ".thicket.yaml").write_text("disableRules: []\n")
    assert rs.discover_config(str(tmp_path / "rules")) == (tmp_path / ".thicket.yaml").resolve()


def test_rule_table(spark):
    rules = rs.ruleset("all")
    back = rs.from_frame(rs.to_frame(spark, rules))
    assert sorted(r.id for r in back) == sorted(r.id for r in rules) and {r.id: r.rule for r in back} == {r.id: r.rule for r in rules}


def test_command_line(spark, project, tmp_path):
    def run(*args):
        out = io.StringIO()
        code = cli.main(list(args), spark, out)
        return code, out.getvalue().strip().split("\n")

    code, lines = run("scan", project, "--ruleset", "all", "--fail-on-issues", "--sarif", str(tmp_path / "sarif"))
    assert code == 1 and any("a.py:6:12: error [eval-call]" in x for x in lines) and any("b.js:1:1: info [todo-comment]" in x for x in lines)
    log = [json.loads(p.read_text()) for p in (tmp_path / "sarif").glob("part-*")]
    results = [r for x in log for run_ in x["runs"] for r in run_["results"]]
    assert {r["ruleId"] for r in results} == {"eval-call", "todo-comment"} and all(r["level"] in ("error", "note") for r in results)
    assert run("scan", project, "--ruleset", "all", "-s", "error")[1] == [x for x in lines if ": error" in x]
    assert run("run", "-p", "CallExpression", project) == (0, ["a.py:6:12  eval(a)", 'a.py:6:22  g(a, "s")'])
    assert run("run", "-p", "CallExpression", "--format", "count", project)[1] == ["a.py:2"]
    assert run("query", "-e", "(call function: (identifier) @f)", project)[0] == 0
    assert run("run", "-p", "ForStatement", project)[0] == 1
    assert json.loads(run("run", "-p", "CallExpression", "--format", "json", project)[1][0])["total_matches"] == 2
    assert "python: py pyw pyi" in run("languages")[1] and "python: OK" in run("verify")[1]
    assert run("parse", "-l", "json", project)[1][0] == "Document"


def test_scanner_api(spark, project):
    s = api.Scanner().load_rules_from_string("id: a\nlanguage: python\nmessage: call of $X\nrule: {kind: CallExpression}")
    assert (s.rule_count, s.rule_ids) == (1, ["a"])
    found = s.scan_files(api.read(spark, project))
    assert {r["file_path"] for r in found.collect()} == {"a.py"}
    assert {r["severity"]: r["n_findings"] for r in s.summary(found).collect()} == {"warning": 2, "total": 2}
    s.clear_rules()
    assert s.rule_count == 0 and api.language_for_extension(".RS") == "rust" and api.extensions_of_language("js") == ["js", "mjs", "cjs"]


def test_documents_and_reports(spark, project):
    files = fs.read_files(spark, project, languages=["python", "json"]).where("n_bytes < 99")
    nodes = frontends.parse(files)
    docs = [json.loads(r["doc"]) for r in sinks.documents(nodes, files, frontends.parse_errors(files)).collect()]
    assert {d["language"] for d in docs} == {"python", "json"} and all(d["nodes"][0]["node_id"] == 0 and d["hasErrors"] is False for d in docs)
    found = rl.scan(nodes, rs.ruleset("all")).join(files.select("file_id", F.col("path").alias("file_path")), "file_id")
    report = [r["line"] for r in sinks.grouped_text(found).orderBy("file_path", "section", "start_line", "start_column").collect()]
    assert report[0] == "a.py" and report[-1] == "2 finding(s)" and "[ERROR] eval-call" in report[2]
    assert json.loads(sinks.json_lines(found, True).first()["json"])["location"]["file"] == "a.py"
    assert {r["id"] for r in sinks.sarif_rules_of_results(found).collect()} == {"eval-call", "todo-comment"}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text(CODE)
    files = ss.read_stream(spark, str(tmp_path / "in"))
    q = ss.scan_stream(files, rs.ruleset("all"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    assert {r["rule_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"eval-call", "todo-comment"}


def test_stream_windows(spark, tmp_path, folder):
    spark.read.parquet(f"{folder}/findings.parquet").select("taken_at", "ingested_at", "rule_id", "file_path").write.parquet(str(tmp_path / "f"))
    src = spark.readStream.schema("taken_at timestamp, ingested_at timestamp, rule_id string, file_path string").parquet(str(tmp_path / "f"))
    for name, df in (("w", ss.counts_over_time(src, "taken_at", "1 day")), ("s", ss.sessions(src, "ingested_at"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "w" else "append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    total = spark.read.parquet(f"{folder}/findings.parquet").count()
    assert spark.table("w").agg(F.sum("n_findings")).first()[0] == total
    scans = spark.read.parquet(f"{folder}/file_scans.parquet").select("file_id", "scanned_at", "n_matches")
    scans.write.parquet(str(tmp_path / "scans"))
    q = ss.latest_state(spark.readStream.schema(scans.schema).parquet(str(tmp_path / "scans"))).writeStream.format("memory").queryName("latest").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["file_id"]: r["last_matches"] for r in spark.table("latest").collect()}
    rows = scans.where("scanned_at is not null and n_matches is not null").groupBy("file_id").agg(F.max_by("n_matches", "scanned_at").alias("m"))
    assert set(got) == {r["file_id"] for r in rows.collect()}


def test_store(spark, tmp_path):
    from thicket.sources import store

    make = lambda *rows: spark.createDataFrame([(i, f"f{i}.py", "python", t) for i, t in rows], "file_id bigint, path string, language string, content string")
    folder = str(tmp_path / "nodes")
    first, second = make((1, "x = 1\n"), (2, "y = f(2)\n"), (3, None)), make((1, "x = 1\n"), (2, "y = g(3)\n"), (4, "z"))
    assert store.update(first, folder) == 2 and store.update(first, folder) == 0
    assert store.update(second, folder) == 2
    texts = {r["text"] for r in store.load(second, folder).where("kind = 'CallExpression'").collect()}
    assert texts == {"g(3)"} and set(store.load(second, folder).columns) == set(frontends.parse(second).columns)
    store.compact(second, folder, str(tmp_path / "small"))
    assert spark.read.parquet(str(tmp_path / "small")).count() == store.load(second, folder).count() < spark.read.parquet(folder).count()
