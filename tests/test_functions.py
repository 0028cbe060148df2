"""Text functions and edits."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thicket.functions import text as tx
from thicket.operators import fixes


def test_interpolation(spark):
    rows = [("$A and $AB and $C", {"A": "x", "AB": "y"}, "x and y and $C"), ("§A$$B∀C", {"A": "1", "B": "2", "C": "3"}, "123"), ("no names", {}, "no names"), ("$A", {"A": "$B"}, "$B"), ("", {"A": "x"}, ""), (None, {}, None), ("a$", {}, "a$")]
    df = spark.createDataFrame(rows, "t string, c map<string,string>, want string")
    for r in df.select(tx.interpolate(F.col("t"), F.col("c")).alias("got"), "want").collect():
        assert r["got"] == r["want"]
    one = spark.range(1).select(tx.interpolate_first(F.lit("f($_, $X)"), F.create_map(F.lit("X"), F.lit("y")), F.lit("m")).alias("g")).first()["g"]
    assert one == "f(m, y)"


def test_small_functions(spark):
    c = F.lit
    row = spark.range(1).select(
        tx.preview(c("a" * 120 + "\nb")).alias("p"), tx.snake_case(c("IfStatement")).alias("s"), tx.span_length(c(10), c(25)).alias("l"), tx.span_length(c(9), c(3)).alias("z"),
        tx.offset_to_line(c("ab\ncd"), c(4)).alias("line"), tx.offset_to_column(c("ab\ncd"), c(4)).alias("col"), tx.offset_to_line(c("ab"), c(9)).alias("out"),
        tx.line_to_offset(c("ab\ncd"), c(2), c(1)).alias("at"), tx.line_to_offset(c("ab\ncd"), c(2), c(7)).alias("past"), tx.severity_level(c("ERROR ")).alias("e"), tx.severity_level(c(None).cast("string")).alias("n"), tx.severity_name(c(1)).alias("i"),
        tx.escape(c("a\n\tb")).alias("x"), tx.relative_path(c("r\\s\\t.py"), "r").alias("rel"), tx.same_ignoring_case(c("A"), c("a")).alias("same"),
    ).first()
    assert (row["p"], row["s"], row["l"], row["z"]) == ("a" * 100 + "...", "if_statement", 15, 0)
    assert (row["line"], row["col"], row["out"], row["at"], row["past"]) == (2, 1, None, 4, None)
    assert (row["e"], row["n"], row["i"], row["x"], row["rel"], row["same"]) == (3, 2, "info", "a\\n\\tb", "s/t.py", True)


def test_globs():
    import re

    for glob, path, want in (("*.py", "a.py", True), ("*.py", "b/a.py", False), ("**/*.py", "a.py", True), ("src/**/x.{js,ts}", "src/a/b/x.ts", True), ("a?c", "abc", True), ("[!a].c", "b.c", True), ("[!a].c", "a.c", False)):
        assert bool(re.match(tx.glob_regex(glob), path)) is want


def brute(text, edits):
    raw = text.encode()
    limit, applied = 2**31 - 1, []
    skipped = 0
    for s, e, r in sorted(set(edits), reverse=True):
        if s < 0 or e < s or e > len(raw) or e > limit:
            skipped += 1
            continue
        applied.append((s, e, r))
        limit = s
    for s, e, r in applied:
        raw = raw[:s] + r.encode() + raw[e:]
    return raw.decode(errors="replace"), len(applied), skipped


def test_fixes(spark):
    rng = random.Random(4)
    files, edits, want = [(1, "abcdefgh"), (2, None), (3, "")], [(1, 0, 3, "X"), (1, 2, 5, "Y"), (1, 6, 8, "Z"), (1, 6, 8, "Z"), (2, 0, 1, "q"), (3, 0, 5, "q")], {}
    for f in range(10, 40):
        text = "".join(rng.choice("abé日\n") for _ in range(rng.randint(1, 30)))
        ok = [0]
        for ch in text:
            ok.append(ok[-1] + len(ch.encode()))
        es = []
        for _ in range(rng.randint(1, 6)):
            a, b = sorted((rng.choice(ok), rng.choice(ok)))
            es.append((a, b, rng.choice(["", "N", "éé"])))
        files.append((f, text))
        edits += [(f, *e) for e in es]
        want[f] = brute(text, es)
    fdf = spark.createDataFrame(files, "file_id bigint, content string")
    edf = spark.createDataFrame([(f, s, e, r) for f, s, e, r in edits], "file_id bigint, start_offset int, end_offset int, fix string")
    got = {r["file_id"]: r for r in fixes.apply_fixes(edf, fdf).collect()}
    assert got[1]["new_content"] == "abYfZ" and (got[1]["n_applied"], got[1]["n_skipped"]) == (2, 1)
    assert 2 not in got and got[3]["n_skipped"] == 1 and got[3]["new_content"] == ""
    for f, (text, n, s) in want.items():
        assert (got[f]["new_content"], got[f]["n_applied"], got[f]["n_skipped"]) == (text, n, s)


def test_edit_makers(spark):
    row = spark.createDataFrame([(3, 5, "x")], "start_offset int, end_offset int, fix string").select(fixes.insert_before(F.lit("a")).alias("b"), fixes.insert_after(F.lit("a")).alias("e"), fixes.delete().alias("d"), fixes.replace().alias("r")).first()
    assert (row["b"][0], row["b"][1], row["e"][0], row["e"][1], row["d"][2], row["r"][2]) == (3, 3, 5, 5, "", "x")


@given(st.text(st.characters(codec="utf-8"), max_size=60))
@settings(max_examples=60, deadline=None)
def test_variables_in_any_text(t):
    assert tx.variables(t + " $LONGER $LON") == sorted(set(tx.variables(t)) | {"LONGER", "LON"}, key=lambda n: (-len(n), n))
