"""Pattern texts, structural patterns, sequences, S-expressions."""

import pytest
from pyspark.sql import functions as F

from thicket import schema
from thicket.operators import patterns as pt
from thicket.operators import sexpr

from .trees import frame, keys, rows_of


@pytest.mark.parametrize(
    ("text", "want"),
    [("IfStatement", pt.Kind("IfStatement")), ("if_statement", pt.Native("if_statement")), ("$X", pt.Meta("X")), ("§X", pt.Meta("X")), ("∀X", pt.Meta("X")), ("$_", pt.Meta(None)), ("$$A", pt.Meta("A", True, 1)), ("$$$A", pt.Meta("A", True, 0)), ("*", pt.Wild()), ("...", pt.Wild()), ("'a b'", pt.Literal("a b")), ("42", pt.Literal(42)), ("-1.5", pt.Literal(-1.5)), ("true", pt.Literal(True)), ("nil", pt.Literal(None)), ("(a (b))", pt.Query("(a (b))"))],
)
def test_parse(text, want):
    assert pt.parse(text) == want


@pytest.mark.parametrize("text", ["", "$", "$Q + $I", "foo bar"])
def test_refused(text):
    with pytest.raises(pt.PatternError):
        pt.parse(text)
    with pytest.raises(pt.PatternError):
        pt.parse("f(" + text + " + (", "python")


CODE = 'x = eval(a)\ny = eval(a, b)\nz = f(a) + f(a)\nw = f(a) + f(b)\nif x > 10:\n    pass\n'


@pytest.mark.parametrize(("pattern", "want"), [("eval($X)", ["eval(a)"]), ("eval($$$ARGS)", ["eval(a)", "eval(a, b)"]), ("$F($X) + $F($X)", ["f(a) + f(a)"]), ("$A > 10", ["x > 10"]), ("$V = f($_) + $R", ["z = f(a) + f(a)", "w = f(a) + f(b)"]), ("nothing(1)", [])])
def test_code_patterns(spark, pattern, want):
    from thicket import api
    from thicket.operators import rules as rl
    from thicket.sources import frontends
    from thicket.sources.rules import Rule

    nodes = frontends.parse(spark.createDataFrame([(1, "python", CODE)], "file_id bigint, language string, content string")).cache()
    texts = lambda keys: [r["text"] for r in nodes.join(keys.select("file_id", "node_id"), ["file_id", "node_id"], "left_semi").orderBy("node_id").collect()]
    assert texts(api.find(nodes, pattern, "python")) == want
    found = rl.scan(nodes, [Rule("r", "python", "found $X", {"pattern": pattern})])
    assert texts(found) == want
    if pattern == "eval($X)":
        assert found.first()["message"] == "found a" and found.first()["captures"] == {"X": "a"}


def test_texts_of_nodes(spark):
    from thicket.sources import frontends

    nodes = frontends.parse(spark.createDataFrame([(1, "python", 'q = "[1, 2]"')], "file_id bigint, language string, content string"))
    inner = frontends.parse_texts(nodes.where("kind = 'StringLiteral'").withColumn("text", F.expr("trim(both '\"' from text)")), "json")
    assert [r["native_type"] for r in inner.orderBy("node_id").collect()] == ["document", "array", "number", "number"]


def test_placeholders_and_names():
    code, names = pt.placeholders("f($A, $$$REST)")
    assert code == "f(__METAVAR_A__, __METAVAR_MULTI_REST__)" and names["__METAVAR_A__"] == "$A"
    assert pt.metavariables(pt.Structure("A", {}, (pt.Meta("X"), pt.AnyOf((pt.Meta("Y"), pt.Meta("X")))))) == ["X", "Y"]


def test_kinds():
    assert len(schema.KINDS) == 209
    assert schema.kind_of("function_item", "rust") == "FunctionDeclaration" and schema.kind_of("trait_item", "rust") == "TraitDeclaration"
    assert schema.kind_of("???") == "Unknown" and "call_expression" in schema.natives_of("CallExpression")
    assert schema.is_kind_pattern("IfStatement") and not schema.is_kind_pattern("if_statement") and not schema.is_kind_pattern("$NAME")


@pytest.fixture(scope="module")
def calls(spark):
    rows = rows_of(("File", None, [("Call", None, [("Id", "f", []), ("Id", "a", []), ("Num", "1", [])]), ("Call", None, [("Id", "g", []), ("Id", "g", [])]), ("Call", None, [])]))
    return frame(spark, rows)


def seq(*children):
    return pt.Structure("Call", {}, children)


def test_sequences(calls):
    m, many, some = pt.Meta("X"), pt.Meta("R", True, 0), pt.Meta("S", True, 1)
    assert keys(pt.find(calls, seq(m, many))) == [(1, 1), (1, 5)]
    assert keys(pt.find(calls, seq(many))) == [(1, 1), (1, 5), (1, 8)]
    assert keys(pt.find(calls, seq(some))) == [(1, 1), (1, 5)]
    assert keys(pt.find(calls, seq(m, m))) == [(1, 5)]
    assert keys(pt.find(calls, seq())) == [(1, 8)]
    got = pt.find(calls, seq(m, many, pt.Kind("Num"))).collect()
    assert [(c["name"], c["node_ids"], c["text"]) for c in got[0]["captures"]] == [("X", [2], "f"), ("R", [3], "a")]
    # the first multiple metavariable takes as many as it can
    greedy = pt.find(calls, seq(pt.Meta("P", True, 0), pt.Meta("Q", True, 0))).where("node_id = 1").collect()
    assert [len(c["node_ids"]) for c in greedy[0]["captures"]] == [3, 0]


def test_open_sequence(calls):
    assert keys(pt.find(calls, pt.Structure("Call", {}, (pt.Literal("f"),), exact=False))) == [(1, 1)]


def test_two_levels(calls):
    whole = pt.Structure("File", {}, (seq(pt.Literal("f"), pt.Meta("REST", True, 0)), pt.Meta("OTHER", True, 0)))
    got = pt.find(calls, whole).collect()
    assert [(r["file_id"], r["node_id"]) for r in got] == [(1, 0)]
    assert {c["name"]: c["text"] for c in got[0]["captures"]}["REST"] == "a, 1"


def test_own_patterns(calls):
    assert keys(pt.find(calls, pt.AnyOf((pt.Literal(1), pt.Literal("g"))))) == [(1, 4), (1, 6), (1, 7)]
    assert keys(pt.find(calls, pt.AllOf((pt.Kind("Id"), pt.Not(pt.Literal("g")))))) == [(1, 2), (1, 3)]
    rows = pt.find(calls, pt.AnyOf((pt.AllOf((pt.Kind("Num"), pt.Meta("N"))), pt.Meta("O")))).where("node_id in (3, 4)").orderBy("node_id").collect()
    assert [r["captures"][0]["name"] for r in rows] == ["O", "N"]


def test_sexpr(calls):
    text = '((call (id) @a . (id) @b) (#eq? @a "f"))'
    got = sexpr.run(calls, text).collect()
    assert [(r["node_id"], [(c["capture"], c["text"]) for c in r["captures"]]) for r in got] == [(1, [("a", "f"), ("b", "a")])]
    assert len(sexpr.run(calls, "(call (id)+ @x)").collect()) == 2
    assert len(sexpr.run(calls, "(call (id)* @x) @c").collect()) == 3
    assert len(sexpr.run(calls, "(call [(id) (num)] @x)").collect()) == 5
    assert keys(sexpr.root_nodes(calls, "(call (num) .)")) == [(1, 1)]
    assert sexpr.parse("(a) @x (b) @y").capture_names() == ["x", "y"]


@pytest.mark.parametrize("text", ["", "(a", "a)", "(a #eq?)", "(#eq? @a 1)"])
def test_sexpr_errors(text):
    with pytest.raises(sexpr.QueryError) as e:
        sexpr.parse(text)
    assert e.value.row == 0


def test_query_of_pattern():
    assert sexpr.from_pattern(pt.Native("call")) == "(call) @match"
    assert sexpr.from_pattern(pt.Kind("CallExpression")).startswith("[")
    assert sexpr.from_pattern(pt.Literal('a"b')) == '(_) @match (#eq? @match "a\\"b")'
    with pytest.raises(pt.PatternError):
        sexpr.from_pattern(pt.Not(pt.Wild()))


@pytest.mark.parametrize(("text", "want"), [
    ("(p (a)+ @s (b) @n)", [(1, [1, 3], 4), (1, [1], 2), (2, [2], 3)]), ("(p (a)* @s (b) @n)", [(1, [1, 3], 4), (1, [1], 2), (2, [], 1), (2, [2], 3)]),
    ("(p (b) @n (a)+ @s)", [(1, [3], 2), (2, [2], 1)]), ("(p (a)+ @s . (b) @n)", [(1, [1, 3], 4), (1, [1], 2), (2, [2], 3)]), ("(p (a)+ @s (b) @n .)", [(1, [1, 3], 4), (2, [2], 3)]),
])
def test_repeated_children_keep_their_place(spark, text, want):
    rows = [(f, 0, None, 0, 0, 3, "p", "p", True, None, "") for f in (1, 2)]
    for f, kids in ((1, "abab"), (2, "bab")):
        rows += [(f, i + 1, 0, i, 1, 0, k, k, True, None, f"{k}{i}") for i, k in enumerate(kids)]
    rows = [r[:5] + (4 if r[0] == 1 else 3,) + r[6:] if r[1] == 0 else r for r in rows]
    df = spark.createDataFrame(rows, "file_id bigint, node_id int, parent_id int, sib_idx int, depth int, child_count int, kind string, native_type string, is_named boolean, name string, text string")
    for c in ("start_line", "start_column", "end_line", "end_column", "start_offset", "end_offset"):
        df = df.selectExpr("*", f"0 as {c}")
    got = []
    for r in sexpr.run(df, text).collect():
        got.append((r["file_id"], [c["node_id"] for c in r["captures"] if c["capture"] == "s"], next(c["node_id"] for c in r["captures"] if c["capture"] == "n")))
    assert sorted(got) == sorted(want)


def test_unknown_predicates_are_refused(calls):
    with pytest.raises(sexpr.QueryError):
        sexpr.run(calls, "((call (id) @a) (#nonsense? @a))")
    assert sexpr.run(calls, "((call (id) @a) (#set! @a))").count() > 0
