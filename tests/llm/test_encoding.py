"""Encoding repair: round trips of damage, quotations, dirt."""

import random

import pytest
from pyspark.sql import functions as F

from thicket.llm import encoding_repair as er

SENTENCES = {
    "de": "Der Läufer prüft die übrigen Zeichen bevor die Größe der Tabelle geändert wird", "fr": "La vérification répète les caractères accentués à chaque deuxième exécution", "es": "La configuración señala la línea siguiente aunque falte la señal del módulo",
    "pl": "Główny indeks łączy następną linię żeby wynik był stały", "ru": "Каждый поток удаляет следующую строку если файл слишком большой", "ja": "パーサーは検索の前に次の行を読み飛ばします", "en": "Today’s parser keeps the “batch” — before the scan starts",
}


def damage(t, true, read):
    raw = t.encode(true)
    return "".join(er.TABLES[read][b] for b in raw) if er.TABLES.get(read) else raw.decode(read)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    rows, want = [], {}
    i = 0
    for _ in range(40):
        for text in SENTENCES.values():
            words = text.split()
            rng.shuffle(words)
            rows.append((i, " ".join(words), "a"))
            i += 1
    cases = [("de", "utf-8", "cp1252"), ("fr", "utf-8", "latin-1"), ("es", "utf-8", "cp437"), ("pl", "utf-8", "mac_roman"), ("ru", "utf-8", "cp1251"), ("ru", "cp1251", "latin-1"), ("ja", "utf-8", "cp850"), ("en", "utf-8", "cp1252"), ("pl", "utf-8", "cp1250"), ("ja", "cp932", "cp1252")]
    for lang, true, read in cases:
        want[i] = SENTENCES[lang]
        rows.append((i, damage(SENTENCES[lang], true, read), "a"))
        i += 1
    twice = damage(damage(SENTENCES["fr"], "utf-8", "cp1252"), "utf-8", "cp1252")
    want[i] = SENTENCES["fr"]
    rows.append((i, twice, "b"))
    clean = {1000: "The log shows `Ã©` where a letter should be.", 1001: None, 1002: "", 1003: "plain", 1004: "├── core\n└── tests", 1005: "±6 µs at 40°", 1006: "about `�` only"}
    rows += [(k, t, None) for k, t in clean.items()] + [(1007, "fun��o", "a")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("token", F.lit("clash")), want, clean


def test_damage_is_found_and_repaired(corpus):
    df, want, clean = corpus
    got = {r["doc_id"]: r for r in er.repair(df, "doc_id", "text", F.col("source")).collect()}
    assert set(got) == set(want) | {1007}
    for k, text in want.items():
        assert got[k]["restored_text"] == text
    assert got[1007]["n_lost"] == 1 and got[1007]["restored_text"] == "fun��o"


def test_empty(corpus):
    df, _, _ = corpus
    assert er.damage(df.limit(0), "doc_id", "text", F.col("source")).count() == 0


def test_quotations():
    assert er.quoted("`Ã©`") == "Ã©" and er.quoted("(`â€™`).") == "â€™"
    assert er.quoted("`caf\u00e9`") is None and er.quoted("x`Ã©`") is None and er.quoted("Ã©") is None


@pytest.mark.parametrize("b", er.READ_AS)
def test_candidates_have_the_original(b):
    for text in SENTENCES.values():
        for word in text.split():
            if not word.isascii():
                try:
                    bad = damage(word, "utf-8", b)
                except UnicodeDecodeError:
                    continue
                assert word in er.candidates(bad)


@pytest.mark.parametrize(("true", "read"), er.OTHER)
def test_other_chains_keep_mixed_tokens(true, read):
    for word in ("JSON-файл", "café", "naïve-Größe", "następną"):
        try:
            bad = damage(word, true, read)
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        if bad != word and not any(c < " " or "\x7f" <= c < "\xa0" for c in word):
            assert word in er.candidates(bad)


def test_searched_chains():
    assert {("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1250", "cp1251")} <= set(er.OTHER)
    assert er.candidates("cafй")["café"] == (er.CHAIN_NO["cp1252>cp1251"], 1)


def test_mixed_and_dos_damage_is_repaired(spark):
    rng = random.Random(4)
    rows, want = [], {}
    texts = [*SENTENCES.values(), "JSON-файл не найден HTML-файл слишком большой"]
    for i in range(30 * len(texts)):
        words = texts[i % len(texts)].split()
        rng.shuffle(words)
        rows.append((i, " ".join(words), "a"))
    cases = [(texts[-1], "cp1251", "latin-1", "b"), (texts[-1], "koi8-r", "latin-1", "c"), (SENTENCES["fr"], "cp1252", "cp1251", "d"), (SENTENCES["de"], "cp850", "cp1252", "e"), (SENTENCES["es"], "cp437", "cp1252", "f")]
    for text, true, read, source in cases * 6:
        want[len(rows)] = text
        rows.append((len(rows), damage(text, true, read), source))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {r["doc_id"]: r["restored_text"] for r in er.repair(df, "doc_id", "text", F.col("source")).collect()} == want
