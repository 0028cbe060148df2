"""Finding and repairing text that was decoded with the wrong character encoding.

A latent chain stands behind every stretch of text: the identity, or one or more steps of "encoded
as A, decoded as B". The probability of what is seen under a chain is that of the text before the
damage under a character model of clean text, times the chain's share in the group (source) of the
record. Both the character model and the shares are unknown and are found by expectation
maximisation over all records: the E-step gives each distinct stretch its posterior over chains, the
M-step adds up the expected character pairs and chain counts. Weak evidence in one record (a single
letter pair) is thereby judged by what all other records look like.

Stretches are runs without ASCII white space that contain a character beyond ASCII. All state that
goes to the workers has a fixed size (hashed counts), whatever the number of records.
"""

from __future__ import annotations

import codecs
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship

PAIR_BITS, CHAR_BITS, GROUPS = 18, 16, 64
#: Encodings in which UTF-8 bytes are wrongly read.
READ_AS = ("latin-1", "cp1252", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "cp1257", "iso8859-2", "iso8859-15", "cp866", "koi8-r", "gb18030", "cp932")
#: Other pairs: the true encoding, and the one in which it was wrongly read.
OTHER = tuple((a, b) for b in ("latin-1", "cp1252") for a in ("cp1251", "koi8-r", "cp866", "cp1250", "iso8859-2", "gb18030", "cp932", "euc_jp", "big5")) + (
    ("cp1252", "latin-1"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "cp866"), ("cp1251", "mac_roman"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1250", "cp1251"),
)
CHAINS = ("", "lost", *(f"utf-8>{b}" for b in READ_AS), *(f"{a}>{b}" for a, b in OTHER), "deeper")
CHAIN_NO = {c: i for i, c in enumerate(CHAINS)}
FIRST_OTHER = 2 + len(READ_AS)
LOST = "�"
#: Log odds against the identity from which a stretch counts as damaged.
LEAST_ODDS = 2.0
BACK_OFF = 20.0
#: The fit ends when a round moves less than this share of the stretches from chain to chain, and after ten rounds: with
#: more, a frequent word teaches the model its own wrong reading (árbol as 疵bol).
SETTLED, ROUNDS = 2e-5, 10
#: Distinct stretches of one task.
TASK_TOKENS = 4_000
TOKEN = r"(?<![^ \t\r\n])[\x00-\x08\x0B\x0C\x0E-\x1F!-\x7F]*+[^\x00-\x7F][^ \t\r\n]*"


def single_byte(name: str) -> str | None:
    """The 256 characters of a single-byte encoding, with control characters in its gaps."""
    if name in ("gb18030", "cp932", "euc_jp", "big5", "utf-8"):
        return None
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


TABLES = {n: single_byte(n) for n in dict.fromkeys([*READ_AS, *(x for p in OTHER for x in p)])}
ENCODERS = {n: codecs.charmap_build(t) for n, t in TABLES.items() if t}


def to_bytes(text: str, name: str) -> bytes | None:
    try:
        return codecs.charmap_encode(text, "strict", ENCODERS[name])[0] if name in ENCODERS else text.encode(name)
    except UnicodeEncodeError:
        return None


def from_bytes(raw: bytes, name: str) -> str | None:
    try:
        return codecs.charmap_decode(raw, "strict", TABLES[name])[0] if TABLES.get(name) else raw.decode(name)
    except UnicodeDecodeError:
        return None


def undo(text: str, true: str, read: str) -> str | None:
    raw = to_bytes(text, read)
    back = None if raw is None else from_bytes(raw, true)
    return None if back is None or back == text or any(c < " " or "\x7f" <= c < "\xa0" for c in back) and true != "utf-8" else back


def candidates(text: str) -> dict[str, tuple[int, int]]:
    """Possible originals: text -> (chain number, steps). The identity is always there.

    Steps of wrongly read UTF-8 are undone as long as that gives anything new; each makes the text
    shorter, so there is an end.
    """
    found = {text: (0, 0)}
    level, depth = [text], 0
    while level:
        after = []
        depth += 1
        for t in level:
            for b in READ_AS:
                back = undo(t, "utf-8", b)
                if back is not None and back not in found:
                    found[back] = (CHAIN_NO[f"utf-8>{b}"] if depth == 1 else CHAIN_NO["deeper"], depth)
                    if not back.isascii():
                        after.append(back)
        level = after
    for a, b in OTHER:
        back = undo(text, a, b)
        if back is not None and back not in found:
            found[back] = (CHAIN_NO[f"{a}>{b}"], 1)
    return found


def hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the character pairs and the characters of a text with its borders."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    # all digits are alike, so that numbers don't thin out the counts
    c = np.where((c >= 48) & (c <= 57), 48, c).astype(np.uint64)
    pair = ((c[:-1] * np.uint64(0x9E3779B1) + c[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)) % np.uint64(1 << PAIR_BITS)
    return pair.astype(np.int64), (c[1:] % np.uint64(1 << CHAR_BITS)).astype(np.int64)


class Model:
    """Hashed counts of clean text and the shares of the chains; its size is fixed."""

    def __init__(self, pairs: np.ndarray, chars: np.ndarray, shares: np.ndarray):
        self.pairs, self.chars = pairs, chars
        self.total = float(chars.sum()) + 1.0
        pooled = shares.sum(0)
        pooled = (pooled + 0.05) / (pooled.sum() + 0.05 * len(pooled))
        mixed = shares + 20.0 * pooled
        self.log_share = np.log(mixed / mixed.sum(1, keepdims=True))

    def score(self, pair: np.ndarray, char: np.ndarray) -> float:
        """Log likelihood of a text with these hashes."""
        # the character before: the one after, shifted by one; the first is a border
        before = np.concatenate([[32], char[:-1]])
        uni = (self.chars[char] + 0.02) / (self.total + 0.02 * (1 << CHAR_BITS))
        # a seldom seen context says little about what follows it
        two = (self.pairs[pair] + BACK_OFF * uni) / (self.chars[before] + BACK_OFF)
        return float(np.log(np.minimum(two, 1.0)).sum())


def quoted(token: str) -> str | None:
    """The inside of a token that is nothing but a sequence in backticks, else None."""
    a, b = token.find("`"), token.rfind("`")
    inside = token[a + 1 : b] if 0 <= a < b else ""
    rest = token[:a] + token[b + 1 :] if inside else token
    return inside if inside and not any(c.isalnum() for c in rest) and "`" not in inside and not any(c.isascii() and c.isalnum() for c in inside) else None


#: Stretches whose candidates a worker keeps from round to round, and their longest length.
MEMORY, MEMORY_LENGTH = 30_000, 200
_known: dict[str, list] = {}


def prepared(token: str) -> list[tuple[str, int, int, np.ndarray, np.ndarray]]:
    """(original, chain, steps, pair hashes, character hashes) of each candidate; the identity comes first."""
    got = _known.get(token)
    if got is None:
        got = [(t, chain, steps, *hashes(t)) for t, (chain, steps) in candidates(token).items()]
        if len(token) <= MEMORY_LENGTH:
            if len(_known) >= MEMORY:
                _known.clear()
            _known[token] = got
    return got


def scored(token: str, model: Model | None) -> list[tuple[str, int, int, float]]:
    """(original, chain, steps, log likelihood) of each candidate; the identity comes first."""
    if model is None:
        # to begin with, what happens to be valid UTF-8 counts as damaged, and no other damage is assumed
        return [(t, chain, steps, (-1e3 if chain >= FIRST_OTHER and steps == 1 else 0.0) - 2.5 * len(t)) for t, chain, steps, _, _ in prepared(token)]
    return [(t, chain, steps, model.score(pair, char)) for t, chain, steps, pair, char in prepared(token)]


def posterior(options: list[tuple[str, int, int, float]], group: int, model: Model | None) -> np.ndarray:
    """Probabilities of the candidates in one group."""
    w = np.array([x[3] for x in options])
    if model is not None:
        w = w + model.log_share[group][[x[1] for x in options]]
    p = np.exp(w - w.max())
    return p / p.sum()


def judge(token: str, group: int, model: Model) -> tuple[float, str, int]:
    """(log odds that the token is damaged, restored text, chain number).

    A replacement character is damage that can't be undone. A short sequence in backticks is talked
    about; it counts only if one repair still leaves a damaged sequence.
    """
    q = quoted(token)
    if LOST in token and not (q and set(q) == {LOST}):
        return 50.0, token, CHAIN_NO["lost"]
    options = scored(q or token, model)
    p = posterior(options, group, model)
    # in a quotation one step back is what is talked about
    wrong = [i for i, x in enumerate(options) if x[2] >= (2 if q else 1)]
    if not wrong:
        return -50.0, token, 0
    odds, best = float(p[wrong].sum()), options[max(wrong, key=lambda i: (p[i], options[i][0]))]
    return math.log(max(odds, 1e-20) / max(1 - odds, 1e-20)), token.replace(q, best[0]) if q else best[0], best[1]


def tokens_of(df: DataFrame, key: str, text: str, group: Column) -> DataFrame:
    """One row per stretch: key, group number, token."""
    named = F.regexp_replace(F.coalesce(F.lower(F.trim(group.cast("string"))), F.lit("")), "[- ]", "_")
    no = F.pmod(F.xxhash64(named), F.lit(GROUPS)).cast("int")
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return df.where(F.col(text).rlike(r"[^\x00-\x7F]")).select(key, no.alias("group"), F.explode(tokens).alias("token"))


def distinct_tokens(rows: DataFrame) -> DataFrame:
    """token, groups: each distinct stretch with its count per group (at most GROUPS entries)."""
    counts = rows.groupBy("token", "group").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("token").agg(F.collect_list(F.struct("group", "n")).alias("groups"))


E_SCHEMA = "part int, at int, weight double"


def expect(batches: Iterator[pd.DataFrame], model: Model | None) -> Iterator[pd.DataFrame]:
    """E-step: expected counts of character pairs (part 0), characters (1) and chains per group (2)."""
    pairs, chars, shares = np.zeros(1 << PAIR_BITS), np.zeros(1 << CHAR_BITS), np.zeros((GROUPS, len(CHAINS)))
    for b in batches:
        for token, groups in zip(b["token"], b["groups"]):
            if LOST in token:
                for g in groups:
                    shares[g["group"], CHAIN_NO["lost"]] += g["n"]
                continue
            if quoted(token):
                continue
            options = scored(token, model)
            chains = [x[1] for x in options]
            weight = np.zeros(len(options))
            for g in groups:
                p = posterior(options, g["group"], model) * g["n"]
                weight += p
                np.add.at(shares[g["group"]], chains, p)
            for w, (_t, _chain, _steps, pair, char) in zip(weight, prepared(token)):
                if w > 1e-4:
                    np.add.at(pairs, pair, w)
                    np.add.at(chars, char, w)
                    chars[32] += w
    for part, a in enumerate((pairs, chars, shares.ravel())):
        at = np.nonzero(a)[0]
        yield pd.DataFrame({"part": np.full(len(at), part, np.int32), "at": at.astype(np.int32), "weight": a[at]})


def fit(tokens: DataFrame, rounds: int = ROUNDS) -> Model:
    """EM over distinct tokens until the shares of the chains settle. Each round sends fixed-size counts to the driver."""
    model, before = None, None
    sc = tokens.sparkSession.sparkContext
    for _ in range(rounds):
        sent = sc.broadcast(model)
        # at most 2**18 + 2**16 + GROUPS * len(CHAINS) rows, whatever the input
        counts = tokens.mapInPandas(lambda batches, sent=sent: expect(batches, sent.value), E_SCHEMA).groupBy("part", "at").agg(F.sum("weight").alias("weight")).toPandas()
        arrays = [np.zeros(1 << PAIR_BITS), np.zeros(1 << CHAR_BITS), np.zeros(GROUPS * len(CHAINS))]
        for part, a in enumerate(arrays):
            rows = counts[counts["part"] == part]
            a[rows["at"].to_numpy()] = rows["weight"].to_numpy()
        shares = arrays[2].reshape(GROUPS, -1)
        model = Model(arrays[0], arrays[1], shares)
        if before is not None and np.abs(shares - before).sum() <= SETTLED * max(shares.sum(), 1.0):
            break
        before = shares
    return model


def damaged_tokens(tokens: DataFrame, model: Model) -> DataFrame:
    """token, group, restored, chain, odds of the stretches that are damaged under the model."""
    sent = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for token, groups in zip(b["token"], b["groups"]):
                for g in groups:
                    odds, restored, chain = judge(token, g["group"], sent.value)
                    if odds >= LEAST_ODDS:
                        out.append((token, g["group"], restored, CHAINS[chain], odds))
            yield pd.DataFrame(out, columns=["token", "group", "restored", "chain", "odds"])

    return tokens.mapInPandas(run, "token string, group int, restored string, chain string, odds double")


def damage(df: DataFrame, key: str, text: str, group: Column) -> DataFrame:
    """Damaged stretches per record: key, token, restored, chain, odds.

    Null and empty texts have none. The same text under several keys gives the same stretches.
    """
    ship(df.sparkSession)
    rows = cut(tokens_of(df, key, text, group))
    distinct = cut(distinct_tokens(rows))
    # spread by count: their work is in the processor, not in their few bytes
    distinct = cut(distinct.repartition(max(1, -(-distinct.count() // TASK_TOKENS))))
    bad = damaged_tokens(distinct, fit(distinct))
    return rows.distinct().join(bad, ["token", "group"]).select(key, "token", "restored", "chain", "odds")


def repair(df: DataFrame, key: str, text: str, group: Column) -> DataFrame:
    """Records with damage and the text with every restorable stretch put back: key, restored text, n_stretches, n_lost.

    `key` must be unique. Stretches with a lost character stay as they are and are counted in n_lost.
    """
    bad = damage(df, key, text, group).groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("token", "restored"))).alias("_map"), F.count(F.lit(1)).alias("n_stretches"), F.count_if(F.col("chain") == "lost").alias("n_lost"))
    swap = F.pandas_udf(swap_tokens, "string")
    return df.select(key, text).join(bad, key).select(key, swap(F.col(text), F.map_entries("_map")).alias("restored_text"), "n_stretches", "n_lost")


def swap_tokens(texts: pd.Series, maps: pd.Series) -> pd.Series:
    token = re.compile(TOKEN)

    def one(t: str, pairs) -> str:
        d = {p["key"]: p["value"] for p in pairs}
        return token.sub(lambda m: d.get(m.group(), m.group()), t)

    return pd.Series([one(t, m) for t, m in zip(texts, maps)])
