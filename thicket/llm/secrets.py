"""Credentials in source text: finding them and taking them out.

A literal is segmented by Viterbi into words of a dictionary (the words of the corpus' identifiers)
and single unexplained characters; what stays unexplained is its residual. A literal in an
assignment or another place that holds values is a credential if its residual reaches what that
place asks for (LEAST): a long one next to any name, a short one where the name, the address, the
header or the sentence already says that a secret stands there. Nothing is found without that
measure. Placeholders, references, hashes, public keys, plain ids and names that only talk about
secrets don't count.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship

#: A word of the dictionary makes up at least this share of all words of identifiers, so there are at
#: most 1 / LEAST_SHARE of them however large the corpus; and it is seen at least so often.
LEAST_SHARE, LEAST_SEEN = 1e-5, 3
#: Unexplained characters from which a literal is a secret, by the place it stands in.
LEAST = {"assignment": 16, "named": 1, "neighbour": 1, "login": 1, "sentence": 1, "address": 1, "header": 6, "query": 6, "token": 8, "private key": 16}

# How secrets are named, in several languages; the last word of a name decides.
ALONE = "password passwd passphrase pwd passwort kennwort contrasena contraseña clave senha haslo hasło parola пароль secret secreto geheimnis credential credentials passe smtppass token apikey authtoken secretkey privatekey accesskey accesstoken".split()
LONG = ("password", "passwd", "passwort", "kennwort", "secret", "pwd", "apikey", "authtoken", "accesstoken")
BEFORE_KEY = "api secret private signing encryption access auth master account service client hmac session".split()
BEFORE_TOKEN = "auth access private api refresh bearer session deploy bot user secret id".split()
BEFORE_PASS = "smtp db user admin root mail ftp ssh login http proxy de".split()

NAME = r"[A-Za-z_\u00C0-\u024F\u0400-\u04FF][\w\u00C0-\u024F.-]*"
LITERAL = r"\"(?P<d>(?:\\.|[^\"\\\n])*)\"|'(?P<s>(?:\\.|[^'\\\n])*)'|`(?P<b>[^`\n]*)`|(?P<u>[^\s\"'`,;(){}\[\]<>]+)"
ASSIGN = re.compile(rf"(?P<name>{NAME})[\"'`]?\]?\s*(?::=|=>|->|==?|:|,)\s*(?P<lit>{LITERAL})(?P<after>\s*\(|(?:\s*\+\s*(?:\"[^\"\n]*\"|'[^'\n]*'))*)")
QUERY = re.compile(r"[?&](?P<name>[A-Za-z_-]{2,30})=(?P<v>[^&\s\"'`#<>]+)")
ADDRESS = re.compile(r"[a-z][a-z0-9+.-]*://(?P<user>[^\s:/@\"'`]*):(?P<v>[^\s/@\"'`]+)@")
HEADER = re.compile(r"(?i)(?:authorization|proxy-authorization|x-auth(?:-token)?|x-api-key|api-key|x-access-token|cookie)[\"']?\s*[:=]\s*[\"']?(?:(?:basic|bearer|token|apikey|digest)\s+)?(?P<v>(?!(?:basic|bearer|token|apikey|digest)\b)[^\s\"'`,;<>]{6,})")
LOGIN = re.compile(r"(?i)\b(?:log_?in|sign_?in|authenticate|auth|set_?password|basic_?auth)\w*\(\s*(?:[\"'][^\"'\n]*[\"']|[\w.]+)\s*,\s*(?:\"(?P<d>(?:\\.|[^\"\\\n])*)\"|'(?P<s>(?:\\.|[^'\\\n])*)')")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<v>.*?)(?:-----END [A-Z0-9 ]*-----|\Z)", re.S)
#: Shapes of well-known tokens.
SHAPES = re.compile(r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abprs]-[\w-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{10,}|SG\.[\w-]{10,}(?:\.[\w-]{10,})?|AIza[\w-]{30,}|ya29\.[\w-]{20,}|npm_[A-Za-z0-9]{30,}|pypi-[\w-]{30,}|eyJ[\w-]{8,}\.(?:eyJ)?[\w-]{8,}(?:\.[\w-]{6,})?)")
PLACEHOLDER = re.compile(r"(?i)^(?:[*x•.#_-]+|<[^<>]*>|\$\{?\(?[\w.:-]*\)?\}?|\{\{.*\}\}|\{[\w.]*\}|%\(?[\w.]*\)?[sd]?|%[\w]+%|@[\w.]+@|env[:.].*|vault[:.].*|ref[:.].*|secret[s]?[:/].*|.*\b(?:your|insert|replace|change|enter|put|add|example|dummy|placeholder|redacted|todo|fixme|sample|changeit)(?:[-_ .].*|\b.*|me.*)|(?:your|my|the|some|insert|replace|change)[-_ ].*|changeme|none|null|nil|true|false|undefined|n/?a|\[.*\]|\(.*\)|)$")
REFERENCE = re.compile(r"\$\{[^}]*\}|\$\([^)]*\)|\{\{[^}]*\}\}|%\([^)]*\)s|<%.*%>|os\.environ|getenv|process\.env|System\.")
# How hashes and public keys are written.
HASH = re.compile(r"(?i)^(?:(?:sha\d*|md5|sha3|blake2\w?|crc32)[-:$=].*|\$(?:1|2[aby]?|5|6|y|argon2\w*|pbkdf2\S*|scrypt)\$.*|\{(?:ssha|sha|md5|crypt)\w*\}.*|(?:ssh|ecdsa)-\S+ .*|data:.*|-----BEGIN (?:[A-Z0-9]+ )*(?:PUBLIC KEY|CERTIFICATE).*)", re.S)
#: A literal that may be a secret next to any name: long, of one piece, with digits and letters of both cases.
PIECE = r"[A-Za-z0-9_+/=.~!@#$%^&*-]"
LONG_LITERAL = rf"(?<!{PIECE})(?={PIECE}*[0-9])(?={PIECE}*[A-Z])(?={PIECE}*[a-z]){PIECE}{{16,}}(?!{PIECE})"
#: Names of long literals that aren't secrets, and literals that are addresses or paths.
PLAIN_NAMES = frozenset("id uuid guid hash digest checksum sha sha1 sha256 sha512 md5 crc commit revision rev etag integrity fingerprint signature public pub verify icon image logo data content body base64 encoded version url uri href src link path file origin class font color model".split())
PATH = re.compile(r"^(?:\.{0,2}/|[\w.-]+/[\w.-]+/|\w+\.\w+\.\w+)|://")
#: Words that make a sentence one about a secret, and what comes last in it the secret itself.
PROSE = re.compile(r"(?i)\b(?:password|passwd|passphrase|passwort|kennwort|contraseña|contrasena|clave|mot de passe|senha|hasło|haslo|parola d'ordine|пароль|secret|token|api[ -]key|credentials?)\b|密码|密钥|パスワード|秘密鍵")
SAID = re.compile(r"(?:\b(?:is|was|remains?|still|with|password|passwort|lautet|ist|bleibt|es|sigue siendo|siendo|est|reste|è|rimane|é|continua|to|jest)\b|[:：=]|[是为は])\s*[\"'`«“]?(?P<v>[^\s\"'`«»“”]{6,})[\"'`»”]?\s*[.。]?\s*(?:\*/|-->)?\s*$", re.I)
#: What a text must hold to be looked at at all, for the JVM's regular expressions: whatever find() accepts without a
#: context has one of these parts. The two last words of a name may be split anywhere by digits and signs.
MAYBE = "(?iu)" + "|".join([
    "key|pass", *(r"[\p{Nd}_.-]*".join(w) for w in ALONE), "密码|密钥|パスワード|秘密鍵",
    r"auth|cookie|log_?in|sign_?in|://[^\s/@]*:[^\s/@]+@|[?&][a-z_-]+=",
    rf"(?-i:{LONG_LITERAL})", r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|k_live_|k_test_|SG\.|AIza|ya29\.|npm_|pypi-|eyJ",
])


def words_of(name: str) -> list[str]:
    """Lower-case words of an identifier in snake, kebab, dotted or camel case."""
    return [w.lower() for w in re.findall(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+(?![^\W\d_A-Z])", name)]


def names_secret(name: str | None) -> bool:
    """Whether an identifier names a secret's value (not something about a secret)."""
    w = words_of(name or "")
    if not w:
        return False
    last, before = w[-1], w[-2] if len(w) > 1 else ""
    if before in ("public", "pub", "verify", "row", "primary", "foreign", "sort", "check", "is", "has", "no"):
        return False
    if last == "key":
        return before in BEFORE_KEY
    if last in ("pass",):
        return before in BEFORE_PASS
    if last == "token":
        return not before or before in BEFORE_TOKEN
    return last in ALONE or last.endswith(LONG) or "".join(w[-2:]) in ALONE or (last == "passe" and before == "de")


NAMES_SECRET = r"(?i)(pass|pwd|passe|wort|contrasena|contraseña|clave|senha|has[łl]o|parola|пароль|secret|secreto|credentials?|token|key|password|passwd|passphrase|apikey)$"


class Dictionary:
    """Words with their costs (negative log probabilities) for the segmentation."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) + 1
        self.cost = {w: math.log(total / c) for w, c in counts.items()}
        self.longest = max(map(len, self.cost), default=1)

    UNKNOWN = 7.0

    def residual(self, literal: str) -> int:
        """Characters that the cheapest segmentation leaves unexplained; joints between words are free.

        From the third on, words that run together without a sign or a capital between them count as one
        unexplained character each: that is no way to write a name.
        """
        s = literal.lower()
        if len(s) != len(literal):  # a few letters change their length
            literal = s
        best = [0.0] + [math.inf] * len(s)
        back = [0] * (len(s) + 1)
        for i in range(len(s)):
            free = s[i] in " _-./:" and 0 < i < len(s) - 1
            c = best[i] + (0.5 if free else self.UNKNOWN)
            if c < best[i + 1]:
                best[i + 1], back[i + 1] = c, i
            for j in range(i + 2, min(len(s), i + self.longest) + 1):
                w = self.cost.get(s[i:j])
                if w is not None and best[i] + w < best[j]:
                    best[j], back[j] = best[i] + w, i
        left, run, j = 0, 0, len(s)
        while j > 0:
            i = back[j]
            if j - i > 1:
                run = run + 1 if run and not literal[j : j + 1].isupper() else 1
                left += run > 2
            else:
                run = 0
                left += not (s[i] in " _-./:" and 0 < i < len(s) - 1)
            j = i
        return left


def is_secret(value: str, words: Dictionary, place: str) -> bool:
    """Whether a literal's residual reaches what the place it stands in asks for."""
    v = value.strip()
    if not v or PLACEHOLDER.match(v) or REFERENCE.search(v) or HASH.match(v):
        return False
    return words.residual(v) >= LEAST[place]


def may_be_anything(value: str, name: str) -> bool:
    """Whether a literal is long and mixed enough, and its name open enough, to be judged without a secret's name."""
    return re.fullmatch(LONG_LITERAL, value) is not None and not PATH.search(value) and PLAIN_NAMES.isdisjoint(words_of(name)) and not PLAIN_NAMES.intersection(name.lower().split("_"))


def quoted_value(m: re.Match) -> tuple[str, int, int]:
    for g in ("d", "s", "b", "u"):
        if g in m.re.groupindex and m.group(g) is not None:
            return m.group(g), m.start(g), m.end(g)
    return "", m.end(), m.end()


def find(text: str, context: str | None, words: Dictionary) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each credential in a text; `context` is a name from neighbouring nodes."""
    out: list[tuple[int, int, str]] = []
    for m in PEM.finditer(text):
        body = re.sub(r"\\n|\s", "", m.group("v"))
        if not REFERENCE.search(body) and words.residual(body) >= LEAST["private key"]:
            out.append((m.start("v"), m.end("v"), "private key"))
    for m in ADDRESS.finditer(text):
        if not REFERENCE.search(m.group()) and is_secret(m.group("v"), words, "address"):
            out.append((m.start("v"), m.end("v"), "address"))
    for m in QUERY.finditer(text):
        n = m.group("name").lower()
        if (names_secret(n) or n in ("key", "sig", "signature", "auth", "token", "pass")) and is_secret(m.group("v"), words, "query"):
            out.append((m.start("v"), m.end("v"), "query"))
    for m in HEADER.finditer(text):
        if is_secret(m.group("v"), words, "header"):
            out.append((m.start("v"), m.end("v"), "header"))
    for m in SHAPES.finditer(text):
        if not re.search(r"(?i)x{6}|example", m.group()) and words.residual(m.group()) >= LEAST["token"]:
            out.append((m.start(), m.end(), "token"))
    for m in ASSIGN.finditer(text):
        if m.group("after").lstrip().startswith("("):
            continue
        v, i, j = quoted_value(m)
        joined = v + "".join(re.findall(r"[\"']([^\"'\n]*)[\"']", m.group("after")))
        bare = m.group("u") is not None
        if names_secret(m.group("name")):
            # a bare word is a reference to something, a bare number an id or a count
            reference = bare and (re.fullmatch(r"[A-Za-z_][\w.]*", joined) and words.residual(joined) < 8 or joined.startswith(("self.", "this.", "&", "*")) or re.fullmatch(r"[+-]?\d{1,5}", joined))
            hit = not reference and is_secret(joined, words, "named")
        else:
            hit = text[m.end("name") : i].strip("\"'` ]")[:1] != "," and may_be_anything(joined, m.group("name")) and is_secret(joined, words, "assignment")
        if hit:
            out.append((i, j, "assignment"))
            out.extend((m.start("after") + p.start(1), m.start("after") + p.end(1), "assignment") for p in re.finditer(r"[\"']([^\"'\n]*)[\"']", m.group("after")))
    for m in LOGIN.finditer(text):
        v, i, j = quoted_value(m)
        if is_secret(v, words, "login"):
            out.append((i, j, "login"))
    if context and not out:
        m = re.match(rf"\s*[a-zA-Z]{{0,2}}(?:{LITERAL})\s*$", text, re.S) or re.match(r"\s*[a-zA-Z]{0,2}(?P<d>.*)\s*$", text, re.S)
        v, i, j = quoted_value(m)
        named = names_secret(context)
        if (named or may_be_anything(v, context)) and is_secret(v, words, "neighbour" if named else "assignment"):
            out.append((i, j, "neighbour"))
    if not out and text.lstrip()[:1] in "#/*-;<'\"`" and PROSE.search(text):
        m = SAID.search(text)
        if m:
            v = m.group("v").rstrip(".,;:")
            if is_secret(v, words, "sentence") and not re.search(r"//|\w=\w|^[\w.]+[(\[]|^[^\W\d_]+$", v):
                out.append((m.start("v"), m.start("v") + len(v), "sentence"))
    return out


def redact(text: str, spans: list[tuple[int, int, str]], mask: str = "REDACTED") -> str:
    """The text with each credential replaced by a mask; everything else stays as it is.

    The mask is one plain word, which may stand in any literal, address, attribute or bare value.
    """
    out, at = [], 0
    for i, j, _ in sorted(spans):
        if j <= at:
            continue
        out.append(text[at : max(i, at)])
        out.append(mask)
        at = j
    return "".join(out) + text[at:]


def dictionary(names: DataFrame, name: Column, share: float = LEAST_SHARE) -> Dictionary:
    """The words that make up at least `share` of all words of identifiers; counts cover every row."""
    split = F.split(F.lower(F.regexp_replace(name, r"([a-z])([A-Z])", "$1_$2")), r"[^\p{L}]+")
    words = cut(names.select(F.explode(split).alias("w")).where("length(w) >= 3 and length(w) <= 24").groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    total = words.agg(F.sum("n")).first()[0] or 0
    # at most 1 / share rows
    rows = words.where((F.col("n") >= LEAST_SEEN) & (F.col("n") >= F.lit(share * total))).collect()
    common = "password secret token key user admin root server data base name value type string number list map file path host port test mode main id url not found for new get set the and with of to in on at my api login client service account private public read write true false null none production staging local default".split()
    return Dictionary({**{w: LEAST_SEEN for w in common}, **{r["w"]: r["n"] for r in rows}})


def credentials(rows: DataFrame, keys: list[str], text: str, context: str, words: Dictionary) -> DataFrame:
    """keys, kinds (distinct, sorted), n_found, redacted: rows with at least one credential.

    Null and empty texts have none. `context` may be null everywhere; keys need not be unique, each
    row is judged on its own.
    """
    ship(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(words)
    head = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for *ids, t, c in b.itertuples(index=False, name=None):
                spans = find(t, c, sent.value)
                if spans:
                    out.append((*ids, sorted({s[2] for s in spans}), len(spans), redact(t, spans)))
            yield pd.DataFrame(out, columns=[*keys, "kinds", "n_found", "redacted"])

    picked = rows.select(*keys, text, context).where(F.col(text).isNotNull() & (F.col(context).isNotNull() | F.col(text).rlike(MAYBE)))
    return picked.mapInPandas(run, f"{head}, kinds array<string>, n_found int, redacted string")


def node_contexts(nodes: DataFrame) -> DataFrame:
    """file_id, node_id, context: string nodes beside a name.

    The name is the parent's, or that of the sibling just before (an identifier, or a string used as
    a key or argument). Strings that may be a secret next to any name get any name, others only one
    that ends like a secret's; a name of a secret goes before others.
    """
    secret = lambda c: F.col(c).rlike(NAMES_SECRET)
    bare = F.regexp_replace("text", r"^[\"'`]|[\"'`]$", "")
    strings = nodes.where(F.col("kind").rlike("String|Template")).select("file_id", "node_id", "parent_id", "sib_idx", F.coalesce(bare.rlike(f"^{LONG_LITERAL}$"), F.lit(False)).alias("_long"))
    named = nodes.where(F.col("name").isNotNull() & ~F.col("kind").rlike("Function|Method|Class|Type")).select("file_id", F.col("node_id").alias("parent_id"), F.col("name").alias("context"))
    before = nodes.where(F.col("kind").rlike("Identifier|Property") | F.col("kind").rlike("String") & bare.rlike(NAMES_SECRET)).where("text is not null")
    before = before.select("file_id", "parent_id", (F.col("sib_idx") + 1).alias("sib_idx"), bare.alias("context"))
    sides = []
    for names, on in ((named, ["file_id", "parent_id"]), (before, ["file_id", "parent_id", "sib_idx"])):
        sides.append(strings.join(names.where(secret("context")), on).select("file_id", "node_id", "context"))
        sides.append(strings.where("_long").join(names.where(~secret("context")), on).select("file_id", "node_id", "context"))
    near = sides[0]
    for s in sides[1:]:
        near = near.unionByName(s)
    return near.groupBy("file_id", "node_id").agg(F.max(F.struct(secret("context").alias("s"), "context"))["context"].alias("context"))
