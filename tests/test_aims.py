"""Scans of the nodes that rules look at find what scans of all nodes find, and send no nodes to the driver."""

import re

import pytest
from pyspark.sql import functions as F

from thicket.operators import rules as rl
from thicket.plans import core_queries as cq
from thicket.sources import frontends, rules as rs

TEXTS = [
    ("python", "def f(x):\n    for a in x:\n        g(a, h(a))  # TODO: b\n    def k():\n        return md5(eval(x))\n    return eval\n"),
    ("Python", "for i in x:\n    [f(i) for i in y]\nelse:\n    f()\nwhile g():\n    async_(1)\n# XXXL\n#FIXME"),
    ("python", "x = ᵉval(b)\neval (c)\nimport md5 . eval\nprint('eval', 'TODO')\n"),
    ("python", "def broken(:\n    md5(x)  # TODO\n    for x in f(y): eval(z)\n"),
    ("python", "y = 1\n"),
    ("go", "func f() { sha1(x) } // FIXME é\nfor { eval(md5) }\n\"// TODO\" 1md5 /* XXX\n */ SHA1"),
    ("javascript", "eval(f(md5a))\n"),
    ("json", '{"\\u0065val": [1, "md5", "// TODO"]}'),
    ("json", '{"a": md5 // TODO\n}'),
    ("html", "<p id=md5><!-- TODO --><EVAL>eval</EVAL><!-- none --></p>"),
    (None, "a TODO b # XXX md5\n"),
    ("own", "anything"),
    ("python", ""),
    ("python", None),
]
NUMBERS = '{id: numbers, language: "*", message: m, rule: {pattern: "1"}}'
RULES = """
- {id: all-of, language: "*", message: "$A in $B", rule: {all: [{pattern: $A}, {kind: Identifier}], notInside: {kind: CallExpression}}, constraints: {A: {regex: "^[a-f]"}}}
- {id: either, language: any, message: m, fix: "g($A)", rule: {any: [{pattern: "'eval'"}, {kind: comment, not: {regex: "T(OD|OO)O"}}, {pattern: $A, kind: string}]}}
- {id: without, language: py, message: m, rule: {kind: FunctionDeclaration, notHas: {any: [{kind: WhileStatement}, {pattern: "'k'"}]}}}
- {id: nested, language: python, message: m, rule: {kind: CallExpression, any: [{has: {kind: CallExpression}}, {not: {inside: {kind: ForStatement}}}]}}
- {id: unused, language: "*", message: m, enabled: false, rule: {kind: Line, precedes: {kind: Line}}}
"""


def findings(nodes, rules):
    found = rl.scan(nodes, rules)
    return sorted((tuple(r) for r in found.withColumn("captures", F.to_json("captures")).drop("node_id").collect()), key=repr)


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(TEXTS)], "file_id bigint, language string, content string")


@pytest.mark.parametrize("rules", [rs.ruleset("all"), rs.parse_rules(RULES), rs.parse_rules(NUMBERS)], ids=["builtin", "mixed", "any node"])
def test_chosen_nodes_have_all_findings(spark, files, rules):
    chosen, every = frontends.parse(files, aims=rl.aims_of(rules)), frontends.parse(files)
    want = findings(every, rules)
    assert findings(chosen, rules) == want
    assert {r.id for r in rules if r.enabled} == {x[1] for x in want}
    assert (chosen.count() < every.count()) == (rules[0].id != "numbers")
    for r in rules:
        assert findings(frontends.parse(files, aims=rl.aims_of([r])), [r]) == [x for x in want if x[1] == r.id]


def test_python_trees_without_comments():
    for _, text in TEXTS[:3]:
        whole, bare = frontends.python(text), frontends.python(text, False)
        whole["kids"] = [k for k in whole["kids"] if k["type"] != "comment"]
        assert whole == bare


def test_required_words():
    words = lambda r: rl.required_words(r) and set(rl.required_words(r))
    assert words(r"\b(TODO|FIXME|XXX)\b") == {"TODO", "FIXME", "XXX"} and words("^(md5|sha1)$") == {"md5", "sha1"}
    assert words("TODO|TODAY") == {"TOD"} or words("TODO|TODAY") == {"TO"}
    assert words("a(bc)+d?") == {"bc"} and words("(?:ab)*x") == {"x"} and words("ab|c*") is None
    assert words("(?i)todo") is None and words("(?i:todo)") is None and words("[ab]") is None and words(r"\0101") is None


def test_relations_that_need_places_need_all_nodes():
    for rule in ({"kind": "Line", "follows": {"kind": "Line"}}, {"kind": "Line", "inside": {"kind": "SourceFile", "stopBy": "neighbor"}}, {"pattern": "(call) @c"}):
        assert rl.aims_of([rs.make_rule({"id": "a", "language": "python", "message": "m", "rule": rule})]) is None


def test_builtin_scan_broadcasts_only_rules(spark, folder):
    out = cq.builtin_scan(spark, folder)
    got = {(r["rule_id"], r["severity"], r["n_findings"], r["n_files"]) for r in out.collect()}
    whole = rl.scan(frontends.parse(cq.kept_files(spark, folder)), rs.ruleset("all"))
    assert got == {tuple(r) for r in whole.groupBy("rule_id", "severity").agg(F.count(F.lit(1)), F.countDistinct("file_id")).collect()}
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"BroadcastHashJoin", plan)) == 1, plan


def test_tokens_with_words():
    words, types = frozenset(("ab", "bc", "TODO")), frozenset(("identifier", "comment"))
    for text in (*(t or "" for _, t in TEXTS), "xab1 1bc 'ab' /* ab\n*/ a bc // TODO abc\nb c abbc", "abc", "", "a-b ab.bc 'x' # q"):
        every = [k for line in frontends.lexical(text)["kids"] for k in line["kids"] if k["type"] in types]
        assert frontends.lexical(text, types)["kids"] == every
        assert frontends.lexical(text, types, words)["kids"] == [k for k in every if any(w in text[k["start"] : k["end"]] for w in words)]
