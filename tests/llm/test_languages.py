"""Chunked lexing and language labels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.llm import languages as lg
from thicket.llm import lexing

PIECES = ["--", "<!--", "-->", ";", "%", '"', "'", "`", "/", "*", "#", "\\", "\n", "a ", " b", "xx", '"""', "'''", "é"]


@pytest.mark.parametrize("fam", ["c", "hash", "dash", "markup", "semicolon", "percent"])
def test_transition_functions_compose(fam):
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice(PIECES) for _ in range(40))
        state = lexing.CODE
        for _at, piece in lexing.split_text(text, 7):
            state = lexing.transitions(piece, fam)[state]
        assert state == lexing.scan(text, lexing.CODE, fam)[0]


def test_chunked_and_whole_texts_agree(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice([*PIECES, "word word ", "\n"]) for _ in range(rng.randint(1, 400))), rng.choice(["python", "go", None])) for i in range(60)] + [(90, None, "go"), (91, "", "go")]
    df = spark.createDataFrame(rows, "file_id bigint, content string, language string")

    def covered(size):
        out = {}
        for r in lexing.inner_texts(df, ["file_id"], "content", "language", size).collect():
            if r["state"] != lexing.CODE:
                out.setdefault(r["file_id"], set()).update((i, r["state"]) for i in range(r["start"], r["start"] + len(r["inner"])))
        return out

    assert covered(1 << 18) == covered(30)


def test_phrases():
    p = lg.phrases
    assert p(" The parser keeps it `f()` and drops the rest. ") == ["The parser keeps it   and drops the rest"]
    assert p("-*- coding: utf-8 -*-") == [] and p("noqa: E501") == [] and p("https://a.b/c d") == [] and p("not found") == []
    assert p("gr\\u00f6\\u00dfte Zahl der Welt") == ["größte Zahl der Welt"]
    assert p("解析器会保留下一行文本。x") == ["解析器会保留下一行文本"] and p("解析器") == []


@pytest.fixture(scope="module")
def model(spark, folder):
    from pyspark.sql import functions as F

    return lg.fit(spark.read.parquet(folder.replace("sf0.001", "sf0.01") + "/documents.parquet"), "doc_id", "text", F.col("lang"))


HELD_OUT = {
    "en": "The old loader walks over the remaining tokens before the scan starts", "de": "Diese Hilfsfunktion behält den letzten gültigen Wert", "fr": "Le lecteur garde la dernière position connue", "es": "El recorrido conserva los cambios pendientes", "pt": "O leitor percorre as expressões vazias após a revisão",
    "it": "Il lettore conserva la riga successiva", "pl": "Drugi przebieg usuwa posortowane zakresy", "ru": "Старый загрузчик сохраняет незаписанные правки", "zh": "共享缓存重新检查下一行文本", "ja": "各スレッドは毎回かならず次の行を比べます",
}
CODE = ["SELECT a, id FROM b WHERE id", "for row in batch", "return new Widget", "FROM a JOIN b ON a", "import name from place"]


def test_labels(model):
    assert dict(zip(HELD_OUT, lg.label_phrases(list(HELD_OUT.values()), model))) == {k: k for k in HELD_OUT}
    assert lg.label_phrases([v.upper() for v in HELD_OUT.values()], model) == list(HELD_OUT)
    assert lg.label_phrases(CODE, model) == [lg.NONE] * len(CODE)
    assert lg.label_phrases([], model) == []


def test_held_out_accuracy(model, spark, folder):
    """Phrases of documents of another size, against their own labels (which are partly wrong)."""
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{folder}/documents.parquet").where(lg.language_of(F.col("lang")).isNotNull() & (F.col("doc_kind") != "source_file"))
    pairs = [(r["l"], p) for r in df.select(lg.language_of(F.col("lang")).alias("l"), "text").collect() for p in lg.phrases(lg.FENCE.sub(" ", r["text"] or ""))]
    got = lg.label_phrases([p for _, p in pairs], model)
    assert np.mean([a == b for (a, _), b in zip(pairs, got)]) > 0.85


def test_found_in_nodes(spark, model):
    rows = [(1, 1, "// The parser keeps the old value", "go"), (1, 2, '"not found"', "go"), (1, 3, None, "go"), (1, 4, "", None), (1, 5, "# Der Läufer prüft alle Werte\n# und löscht die alten Werte, the end", "python"), (1, 6, "'" + "9" * 300_000 + " Le lecteur garde la valeur '", "go")]
    df = spark.createDataFrame(rows, "file_id bigint, node_id int, text string, language string")
    got = {r["node_id"]: r["text_lang"] for r in lg.main_language(lg.find_phrases(df, ["file_id", "node_id"], "text", "language", model), ["file_id", "node_id"]).collect()}
    assert got == {1: "en", 5: "de", 6: "fr"}
    assert lg.find_phrases(df.limit(0), ["file_id"], "text", "language", model).count() == 0


def test_every_text_with_a_phrase_is_looked_at(spark):
    rng = random.Random(6)
    parts = ["Loaded", "from", "cache", "é", "l'état", "x_1", "file2", "{0}", "{item_1}", "${user_2}", "`x_1`", "%5d", "%s", "<b>", "</br>", "\\n", "\\t", "\\u00e9", "日", "本語", "\n", " ", " ", " ", " ", "　", ", ", ". ", "²", "_", "7"]
    texts = ['"Loaded {0} from cache"', "loaded{item_1}from`x_1`cache", "one\\ntwo\\nthree", "日\n本\n語\n文\n字\n列", "# a ² b", "ein paar Worte"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(3, 14))) for _ in range(6000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    seen = {r["id"] for r in df.where(F.col("text").rlike(lg.MAYBE)).collect()}
    want = {i for i, t in enumerate(texts) if lg.phrases(t)}
    assert {0, 1, 2, 3, 5} <= want <= seen and len(want) > 200
    few = ["", "one two", '"snake_case_name"', "camelCaseName", "a1b2c3d4", "日本", "x" * 300_000]
    assert spark.createDataFrame([(t,) for t in few], "text string").where(F.col("text").rlike(lg.MAYBE)).isEmpty()


def test_size_of_chunks_changes_nothing(spark):
    rng = random.Random(8)
    plain = "no delimiters in this text at all just words and words " * 9
    rows = [(i, "".join(rng.choice([*PIECES, "word word ", "\n"]) for _ in range(rng.randint(1, 400))), rng.choice(["python", "go", None])) for i in range(60)]
    rows += [(90, None, "go"), (91, "", "go"), (92, plain, "go"), (93, f"/* {plain}*/ x = 1; // {plain}\ny = \"{plain}\"", "go"), (94, plain, None), (94, plain[3:], "go"), (95, "x = 1; " * 60 + "// last words here", "go")]
    df = spark.createDataFrame(rows, "file_id bigint, content string, language string")
    got = {size: sorted(tuple(r) for r in lexing.inner_texts(df, ["file_id"], "content", "language", size).collect()) for size in (30, 200, 1 << 18)}
    assert got[30] == got[200] == got[1 << 18]
    assert (92, 0, lexing.CODE, plain) in got[30] and sum(r[0] == 94 for r in got[30]) == 2


def test_a_span_over_many_chunks_is_one(spark):
    comment = "/* " + "the reader keeps the last known position and drops the rest " * 40 + "*/"
    df = spark.createDataFrame([(1, f"x = 1; {comment} y = 2;", "go"), (2, "no delimiter here but many words " * 30, "go"), (3, "<p>a</p><!-- the reader keeps the last position -->", "html"), (4, "select 1 -- the reader keeps the last position\nfrom b", "SQL")], "file_id bigint, content string, language string")
    for size in (7, 64, lexing.CHUNK, 1 << 18):
        got = {r["file_id"]: (r["start"], r["state"], r["inner"]) for r in lexing.inner_texts(df, ["file_id"], "content", "language", size).collect()}
        assert got[1] == (9, lexing.BLOCK, comment[2:-2]) and got[2][1] == lexing.CODE and len(got[2][2]) == 990
        assert got[3][1] == lexing.MARKUP and got[4] == (11, lexing.LINE, " the reader keeps the last position")


def test_sample_takes_the_same_rows_in_one_pass(spark):
    rows = [(i, f"text {i}", ["en", "DE", "fr_FR", None, "xx"][i % 5]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    seen = {}
    keep, lg.train_on = lg.train_on, lambda rows, bound: seen.update(rows=rows)
    try:
        lg.fit(df, "doc_id", "text", F.col("lang"), documents_bound=100)
    finally:
        lg.train_on = keep
    h = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    for code, label in (("en", "en"), ("de", "DE"), ("fr", "fr_FR")):
        want = [t for i, t, x in sorted(rows, key=lambda r: h[r[0]]) if x == label][:10]
        assert [t for c, t in seen["rows"] if c == code] == want
