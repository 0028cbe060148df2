"""Natural language inside code: phrases, and their language by multinomial logistic regression.

A phrase is a run of plain words (three or more), or of six or more Chinese or Japanese characters,
in a comment or string. A multinomial logistic regression on hashed character n-grams, trained here
on a bounded sample of labelled documents, gives it one of ten languages or `none` (code, queries,
directives).
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from . import lexing

#: The languages told apart.
LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "pl", "ru", "zh", "ja")
NONE = "none"
CLASSES = (*LANGUAGES, NONE)
BITS = 16
ORDERS = (1, 2, 3, 4)
#: Bound of the training sample: documents taken, and phrases per class.
SAMPLE_DOCUMENTS, SAMPLE_PHRASES = 2000, 600
LEAST_WORDS, LEAST_CJK = 3, 6
#: Weight of the class `none` against the languages: a name at the end doesn't make a sentence code.
NONE_WEIGHT = 0.4

WORD = r"[^\W\d_]+(?:['’ʼ-][^\W\d_]+)*"
CJK = r"぀-ヿ㐀-䶿一-鿿々〆ー"
WORDS = re.compile(rf"(?<![^\s(\[\"'«„“‘*#>¿¡—–])(?:{WORD}[,.;:!?…)\]»”\"’]*\s+(?:(?:[*#]+|//+)\s+)?(?:[—–«„“(¿¡-]\s?)?){{{LEAST_WORDS - 1},}}{WORD}(?=[,.;:!?…)\]»”\"'’\s*<{{%]|\Z)")
SIGNS = re.compile(rf"[{CJK}](?:[{CJK}。、，．！？：；「」『』（）…・\s]|[A-Za-z0-9])*[{CJK}]")
ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\U([0-9a-fA-F]{8})|\\u\{([0-9a-fA-F]{1,6})\}")
#: Code, formats and markup inside a sentence; the words around them stay one phrase.
CODE_SPAN = re.compile(r"`[^`\n]*`|\$\{[^}\n]*\}|\{[\w.:]*\}|%[-+0-9.]*[sdifgxuc]\b|</?[A-Za-z][\w]*/?>")


def unescape(text: str) -> str:
    r"""\u, \x and \U escapes as characters; others stay."""

    def one(m: re.Match) -> str:
        n = int(next(g for g in m.groups() if g), 16)
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else m.group()

    return ESCAPE.sub(one, text) if "\\" in text else text


def phrases(text: str) -> list[str]:
    """Candidate phrases of a comment's or string's inside."""
    text = unescape(text).replace("\\n", " \n").replace("\\t", " ")
    out = []
    rest = CODE_SPAN.sub(" ", text)
    if re.search(rf"[{CJK}]", rest):
        for m in SIGNS.finditer(rest):
            if sum(1 for c in m.group() if "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿") >= LEAST_CJK:
                out.append(m.group())
        rest = SIGNS.sub(" ` ", rest)
    out.extend(m.group() for m in WORDS.finditer(rest))
    return out


def shape(text: str) -> str:
    """How the words of a text are written, one private character per word: small, capital first, capitals, one letter."""
    return "".join("\ue003" if len(w) == 1 else "\ue000" if w.islower() else "\ue002" if w.isupper() else "\ue001" for w in re.findall(r"[^\W\d_]+", text))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts (lower case, white space as one blank) and the bounds between texts."""
    norm = [" " + re.sub(r"[\s\d\W]+", " ", t.lower()).strip() + " " + shape(t) for t in texts]
    c = np.frombuffer("".join(norm).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in norm], np.int64)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(c))  # characters up to the end of the text
    keys, owner = [], []
    who = np.repeat(np.arange(len(norm)), sizes)
    h = np.zeros(len(c), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        shifted = np.zeros(len(c), np.uint64)
        shifted[: len(c) - n + 1] = c[n - 1 :] if n > 1 else c
        h = (h * np.uint64(0x100000001B3) + shifted + np.uint64(n)) & np.uint64(0xFFFFFFFFFFFF)
        if n in ORDERS:
            ok = left >= n
            keys.append(((h[ok] ^ (h[ok] >> np.uint64(19))) % np.uint64(1 << BITS)).astype(np.int32))
            owner.append(who[ok])
    key, who = np.concatenate(keys), np.concatenate(owner)
    order = np.argsort(who, kind="stable")
    return key[order], np.searchsorted(who[order], np.arange(len(norm) + 1))


class Classifier:
    """Weights of the regression: one row per hash bucket, one column per class."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights.astype(np.float32), bias.astype(np.float32)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, len(CLASSES)))
        out = []
        for i in range(0, len(texts), 2000):
            key, at = grams(texts[i : i + 2000])
            n = np.maximum(np.diff(at), 1)[:, None]
            z = np.add.reduceat(self.weights[key], at[:-1], axis=0) / np.sqrt(n) + self.bias
            z = np.exp(z - z.max(1, keepdims=True))
            out.append(z / z.sum(1, keepdims=True))
        return np.concatenate(out)


def train(texts: list[str], labels: list[str], epochs: int = 12, rate: float = 0.5, seed: int = 7) -> Classifier:
    """Adagrad on the cross-entropy of the multinomial logistic regression, in mini-batches."""
    rng = np.random.default_rng(seed)
    y = np.array([CLASSES.index(x) for x in labels])
    key, at = grams(texts)
    k = len(CLASSES)
    w, b = np.zeros((1 << BITS, k), np.float32), np.zeros(k, np.float32)
    g2, b2 = np.full((1 << BITS, k), 1e-3, np.float32), np.full(k, 1e-3, np.float32)
    rows = np.arange(len(texts))
    for _ in range(epochs):
        rng.shuffle(rows)
        for i in range(0, len(rows), 256):
            part = rows[i : i + 256]
            parts = [key[at[r] : at[r + 1]] for r in part]
            n = np.array([max(len(p), 1) for p in parts])
            flat, who = np.concatenate(parts), np.repeat(np.arange(len(part)), [len(p) for p in parts])
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
            z = np.add.reduceat(w[flat], starts, axis=0) / np.sqrt(n)[:, None] + b
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(part)), y[part]] -= 1
            z /= len(part)
            used, back = np.unique(flat, return_inverse=True)
            per = (z / np.sqrt(n)[:, None])[who]
            g = np.stack([np.bincount(back, per[:, j], len(used)) for j in range(k)], 1).astype(np.float32)
            g2[used] += g * g
            w[used] -= rate * g / np.sqrt(g2[used])
            gb = z.sum(0).astype(np.float32)
            b2 += gb * gb
            b -= rate * gb / np.sqrt(b2)
    return Classifier(w, b)


def plain_letters(text: str) -> str:
    """The text as typed without accents (ü as ue, and so on)."""
    text = "".join({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue", "ł": "l", "Ł": "L", "œ": "oe"}.get(c, c) for c in text)
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def no_language(names: list[str], n: int, seed: int = 3) -> list[str]:
    """Word runs as they occur in code, queries and directives, with names put in."""
    r = random.Random(seed)
    x = lambda: r.choice("abcdefghijkmnopqrstuvwxyz") if r.random() < 0.2 else re.sub(r"[\d_]+", " ", r.choice(names)).strip().split(" ")[0] or "x"
    y = lambda: r.choice("abcdefghijkmnopqrstuvwxyz")
    forms = (
        lambda: f"FROM {y()} JOIN {y()} ON {y()}", lambda: f"SELECT {y()}, {y()} FROM {y()}", lambda: f"LEFT JOIN {y()} ON {y()}", lambda: f"for {y()} in {x()}", lambda: f"if {y()} or {y()}",
        lambda: f"SELECT {x()}, {x()} FROM {x()} WHERE {x()}", lambda: f"FROM {x()} JOIN {x()} ON {x()}", lambda: f"select {x()} from {x()} order by {x()}", lambda: f"INSERT INTO {x()} VALUES", lambda: f"UPDATE {x()} SET {x()}", lambda: f"DELETE FROM {x()} WHERE {x()}", lambda: f"CREATE TABLE IF NOT EXISTS {x()}",
        lambda: f"ORDER BY {x()} DESC LIMIT", lambda: f"GROUP BY {x()}, {x()}", lambda: f"for {x()} in {x()}", lambda: f"for {x()} in {x()}: {x()}", lambda: f"return new {x()}", lambda: f"if {x()} and {x()}", lambda: f"if not {x()}: return", lambda: f"if {x()} is None: return {x()}", lambda: f"while {x()} do {x()}", lambda: f"import {x()} from {x()}", lambda: f"from {x()} import {x()}",
        lambda: f"public static void {x()}", lambda: f"private final {x()} {x()}", lambda: f"let mut {x()}", lambda: f"const {x()} of {x()}", lambda: f"pub fn {x()}", lambda: f"def {x()} end", lambda: f"{x()} {x()} {x()}", lambda: f"{x()} {x()} {x()} {x()}", lambda: f"git commit -m {x()}", lambda: f"{x()} --all --{x()} -o out", lambda: f"docker run {x()} {x()}", lambda: f"for (int {x()}", lambda: f"if ({x()} {x()}", lambda: f"{x()} (const {x()}", lambda: f"BEGIN {x()} PRIVATE KEY", lambda: f"END PUBLIC KEY",
        lambda: f"eslint disable next line {x()}", lambda: f"pylint disable {x()}", lambda: f"type: ignore {x()}", lambda: f"clang-format off", lambda: f"coding: utf", lambda: f"pragma once {x()}", lambda: f"prettier-ignore {x()}", lambda: f"SPDX-License-Identifier: MIT {x()}", lambda: f"else if {x()} return {x()}", lambda: f"throw new {x()}", lambda: f"case {x()}: return {x()}", lambda: f"lambda {x()}: {x()}", lambda: f"class {x()} extends {x()}", lambda: f"export default {x()}", lambda: f"User Id {x()} Password {x()}", lambda: f"div class {x()} span {x()}",
    )
    return [r.choice(forms)() for _ in range(n)]


def language_of(lang: Column) -> Column:
    """Two-letter code of a dirty language label; null for what isn't one of the ten."""
    code = F.substring_index(F.substring_index(F.lower(F.trim(lang)), "_", 1), "-", 1)
    return F.when(code.isin(*LANGUAGES), code)


def fit(documents: DataFrame, key: str, text: str, lang: Column, documents_bound: int = SAMPLE_DOCUMENTS, phrases_bound: int = SAMPLE_PHRASES) -> Classifier:
    """Train on at most `documents_bound` documents (those with the smallest key hashes, languages in turn).

    Only those come to the driver, and at most `phrases_bound` phrases of each class are used. Labels
    that a first fit doubts strongly are left out of the second.
    """
    per = documents_bound // len(LANGUAGES)
    labelled = documents.where(F.col(text).isNotNull()).select(language_of(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key).alias("_h")).where("lang is not null")
    # one pass: every task keeps its own first `per` of a language before anything is shuffled
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "text"))
    rows = labelled.withColumn("_no", place).where(F.col("_no") <= per).collect()
    rows.sort(key=lambda r: (LANGUAGES.index(r["lang"]), r["_no"]))
    return train_on([(r["lang"], r["text"]) for r in rows], phrases_bound)


FENCE = re.compile(r"```.*?```", re.S)
NAME = re.compile(r"\b[a-z]+_[a-z_]+\b")


def train_on(rows: list[tuple[str, str]], bound: int = SAMPLE_PHRASES) -> Classifier:
    by: dict[str, list[str]] = {c: [] for c in CLASSES}
    names: list[str] = ["value", "index", "table", "queue"]
    for lang, text in rows:
        prose = FENCE.sub(" ` ", text)
        codelike = len(re.findall(r"[;{}()=]", prose)) > 0.02 * len(prose)
        for p in phrases(prose) if not codelike else (q for f in ("c", "hash") for s in lexing.scan(prose, 0, f)[1] for q in phrases(prose[s[1] : s[2]])):
            by[lang].append(p)
        if len(names) < 5000:
            names.extend(NAME.findall(text))
    texts, labels = [], []
    r = random.Random(5)
    for c, ps in by.items():
        ps = sorted(set(ps))
        r.shuffle(ps)
        for p in ps[:bound]:
            # sentences in parts, in capitals, and as typed without accents, too
            w = p.split()
            some = [p, plain_letters(p), p.upper()] + ([" ".join(w[i : i + 3]) for i in range(0, len(w) - 2, 5)][:2] if len(w) > 4 else [])
            texts.extend(some)
            labels.extend([c] * len(some))
    extra = no_language(names, bound * 2)
    texts += extra
    labels += [NONE] * len(extra)
    first = train(texts, labels, epochs=3)
    p = first.probabilities(texts)
    keep = [i for i, c in enumerate(labels) if p[i, CLASSES.index(c)] > 0.05]
    return train([texts[i] for i in keep], [labels[i] for i in keep], epochs=5)


LATIN = [i for i, c in enumerate(CLASSES) if c not in ("ru", "zh", "ja")]


def possible(text: str) -> list[bool]:
    """Classes that the script of a phrase allows."""
    cyr = sum("Ѐ" <= c <= "ӿ" for c in text)
    cjk = sum("぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" for c in text)
    kana = sum("぀" <= c <= "ヿ" for c in text)
    if cjk >= LEAST_CJK:
        return [c == ("ja" if kana else "zh") for c in CLASSES] if kana != 0 or cjk > 0 else [True] * len(CLASSES)
    if cyr * 2 > len(re.sub(r"\W", "", text)):
        return [c in ("ru", NONE) for c in CLASSES]
    return [c not in ("ru", "zh", "ja") for c in CLASSES]


def label_phrases(texts: list[str], model: Classifier) -> list[str]:
    p = model.probabilities(texts)
    for i, t in enumerate(texts):
        p[i] *= possible(t)
        p[i, -1] *= NONE_WEIGHT
    return [CLASSES[j] for j in p.argmax(1)] if len(texts) else []


def spans_of_text(text: str, fam: str) -> list[str]:
    """Insides of the comments and strings of a node's text; the text itself if it has no delimiter."""
    spans = lexing.scan(text, lexing.CODE, fam)[1]
    return [text[i:j] for _, i, j in spans] or [text]


# Word characters, and what may part two words of a phrase before phrases() takes code and escapes out: white space, or what such a piece starts with.
W, S = r"\p{L}\p{Nl}\p{No}", r"\s\x1C-\x1F\x85\p{Z}`{%<\\"
#: What a text must hold to have a phrase, for the JVM's regular expressions: words and gaps in turn, enough signs, or an escape.
MAYBE = rf"\A[^{W}]*+(?:[{W}][^{S}]*+[{S}][^{W}]*+){{{LEAST_WORDS - 1}}}[{W}]|(?:[{CJK}][^{CJK}]*+){{{LEAST_CJK}}}|\\[uxU]"


def find_phrases(df: DataFrame, keys: list[str], text: str, language: str, model: Classifier, size: int = lexing.CHUNK) -> DataFrame:
    """keys, lang, phrase, n_bytes: the labelled phrases inside comments and strings of each text.

    Texts are lexed in chunks of `size` characters, see `lexing`; each comment or string is then
    split into phrases and each phrase labelled. Null and empty texts have no phrase.
    """
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)
    head = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            owner, texts = [], []
            ids = list(b[keys].itertuples(index=False, name=None))
            for i, inner in enumerate(b["inner"]):
                for p in phrases(inner):
                    owner.append(i)
                    texts.append(p)
            labels = label_phrases(texts, sent.value)
            rows = [(*ids[o], lab, t, len(t.encode("utf-8", "replace"))) for o, t, lab in zip(owner, texts, labels) if lab != NONE]
            yield pd.DataFrame(rows, columns=[*keys, "lang", "phrase", "n_bytes"])

    rows = df.where(F.col(text).rlike(MAYBE))
    inner = lexing.inner_texts(rows, keys, text, language, size).select(*keys, "inner")
    return inner.mapInPandas(run, f"{head}, lang string, phrase string, n_bytes int")


def main_language(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text_lang, n_bytes: the language with most bytes of phrases (ties: the first by name)."""
    per = found.groupBy(*keys, "lang").agg(F.sum("n_bytes").alias("n"))
    best = F.max(F.struct(F.col("n"), F.translate("lang", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba").alias("_r"), F.col("lang"))).alias("_b")
    return per.groupBy(*keys).agg(best, F.sum("n").alias("n_bytes")).select(*keys, F.col("_b.lang").alias("text_lang"), "n_bytes")
