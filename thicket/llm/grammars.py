"""Small grammars of programming languages, as regular productions over token classes.

A file is lexed into one class character per token. It is then reduced in windows from the inside
out: the inside of a pair of brackets goes through the reductions of the language (declarations,
function heads, expressions and so on become one symbol each), must match a production for that
bracket, and becomes one symbol itself. What is left must match the production of a file. As every
reduction and production is regular, the token pairs that may stand side by side follow from them
(`permissible_pairs`).

Token classes shared by the languages: i name, n number or constant, s text, o binary operator, -
plus or minus, * & | < > = ! ? : , ; . themselves, a compound assignment, p increment, r arrow,
q ::, v ellipsis, w range or walrus, N end of line. Capital and other letters are keywords, see each
grammar. Symbols of reductions are Greek letters; G A B are reduced brackets ( [ {.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

try:
    from re import _parser as sre
except ImportError:  # pragma: no cover
    import sre_parse as sre


def some(item: str) -> str:
    """Items with commas between them, perhaps none, perhaps a comma at the end."""
    return f"(?:{item}(?:,{item})*,?)?"


def any_of(*parts: str) -> str:
    return "(?:" + "|".join(parts) + ")"


def words(text: str, char: str) -> dict[str, str]:
    return dict.fromkeys(text.split(), char)


@dataclass
class Grammar:
    name: str
    keywords: dict[str, str]
    operators: dict[str, str]
    #: regular expressions of tokens that are dropped, and of texts
    comment: str
    text: str
    #: how line ends count: none, layout, semicolon (Go), asi (JavaScript), line (Ruby)
    lines: str
    #: (kinds of brackets or "", pattern, symbol): the reductions, in order
    steps: list[tuple[str, str, str]]
    #: kind of bracket -> [(symbol, production)]; the first that matches counts
    productions: dict[str, list[tuple[str, str]]]
    directive: str = ""
    name_re: str = r"[A-Za-z_$\u00AA-\u02FF\u0370-\u1FFF\u3040-\u30FF\u3400-\u9FFF\uAC00-\uD7A3][\w$]*"
    number: str = r"0[xX][0-9a-fA-F_]+[uUlLnN]*|0[bBoO][0-9_]+n?|(?:[0-9](?:[0-9_]*[0-9])?)(?:\.(?![.A-Za-z_])[0-9_]*)?(?:[eE][+-]?[0-9]+)?(?:[uif](?:8|16|32|64|128|size)|[fFdDlLuUnNmMji]{0,3})(?![A-Za-z_])|\.[0-9]+(?:[eE][+-]?[0-9]+)?"
    ready: dict = field(default_factory=dict)

    def prepare(self) -> "Grammar":
        kinds = ("paren", "square", "brace", "top", "suite")
        self.ready = {k: ([(re.compile(p), s) for on, p, s in self.steps if not on or k in on.split()], [(s, re.compile(p)) for s, p in self.productions.get(k, [])]) for k in kinds}
        ops = "|".join(re.escape(o) for o in sorted(self.operators, key=len, reverse=True))
        # most tokens are plain names, so they are tried first; blanks are skipped in one step
        quick = r"[A-Za-z_]\w*+(?![\"'#$?!:`])"
        parts = [quick, r"[()\[\]{},;]", r"^[ \t]*#(?:\\\n|[^\n])*" if self.directive else "", self.comment, self.text, self.number, self.name_re, ops, r"\n[ \t\f]*", r"[^\s#]" if self.directive else r"\S"]
        self.ready["tokens"] = re.compile(r"[ \t\f]*(" + "|".join(p for p in parts if p) + ")", re.M)
        self.ready["directive"] = re.compile(self.directive) if self.directive else None
        return self

    def reduce(self, kind: str, inside: str) -> str | None:
        """The symbol for the inside of a bracket, or None if no production matches."""
        steps, productions = self.ready[kind]
        for pattern, symbol in steps:
            inside = pattern.sub(symbol, inside)
        return next((s for s, p in productions if p.fullmatch(inside)), None)


C_OPERATORS = {
    **{c: c for c in "()[]{},;:.?=*&|<>"}, "+": "-", "-": "-", "!": "!", "~": "!", "++": "p", "--": "p", "...": "v", "::": "q",
    **words("/ % == != <= >= && || ^ <<", "o"), **words("+= -= *= /= %= &= |= ^= <<= >>=", "a"),
}
C_COMMENT = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/"
QUOTED = r"\"(?:\\[\s\S]|[^\"\\\n])*+\"|'(?:\\[\s\S]|[^'\\\n])*+'"
TERNARY = ("", r"ε(?:\?ε(?:\?ε:ε)?:ε)+", "ε")
#: What a statement can follow, besides the beginning.
START = r"(?:(?<=[;BβηEDYQφι])|^)"


def expression(prim: str, post: str, pre: str, binary: str, before: str = "") -> str:
    unary = f"{before}(?:{pre})*{prim}(?:{post})*"
    return f"{unary}(?:{binary}{unary})*"


def java() -> Grammar:
    kw = {**words("public private protected static final abstract native synchronized transient volatile strictfp default", "m"), **words("int long short byte char boolean float double void", "t"), **words("class interface enum", "L"), "import": "M", "package": "P", "return": "R", "if": "I", "else": "E", "for": "F", "while": "W", "do": "D", **words("break continue", "K"), "switch": "S", "case": "C", "throw": "T", "assert": "T", "try": "Y", "catch": "H", "finally": "Q", "new": "u", **words("extends implements", "e"), "throws": "h", **words("this super", "i"), **words("null true false", "n"), "instanceof": "x", **words("const goto", "\x00")}
    gen = r"(?:<[i.,?&A<>etn]*>)"
    typ = rf"(?:t|i(?:\.i)*{gen}?(?:\.i{gen}?)*)A*"
    steps = [
        ("", r"@(?!L)i(?:\.i)*G?", "m"), ("", r"@L", "L"),
        ("top brace", rf"Mm?i(?:\.i)*(?:\.\*)?;|m*Pi(?:\.i)*;", "ι"),
        ("", rf"u{typ}(?:[GA]B?|B)?", "ν"), ("", rf"{typ}q(?:i|u)", "ν"), ("", r"\.L", ".i"),
        ("top brace", rf"{START}(?:m+{gen}?(?:{typ})?|{typ})i[GΠ]A*(?:h{typ}(?:,{typ})*)?(?=[B;m])|{START}i[GΠ](?:h{typ}(?:,{typ})*)?(?=B)", "φ"),
        ("top brace", rf"{START}m*Li{gen}?[GΠ]?(?:e{typ}(?:,{typ})*)*(?=B)", "φ"),
        ("top brace", r"IG|F[GΗ]|WG|SG(?=B)|H[GΠ]|Y[GΠ]|mG(?=B)", "η"),
        ("top brace", r"(?:(?<=[;Bβη:EDYQφm])|^)B", "β"),
        ("top brace", rf"(?:(?<=[;Bβη:EDYQι])|^)m*{typ}iA*(?=[=;,])", "δ"),
        ("paren", rf"(?:(?<=[,;])|^)m*{typ}v?iA*(?=[,=:;]|$)|^m*{typ}(?:\|{typ})+i$", "δ"), ("paren", rf"^(?:tA*|i(?:\.i)*{gen}A*|i(?:\.i)*A+)$", "τ"),
        ("", r"(?:i|G|Π)r(?=[^,;:])", "λ"),
        ("", r"λ*" + expression(any_of("i", "n", "s", "G", "ν", "SGB", "ηβ(?=$)"), r"\.i|qi|G|A|p", r"[!\-p]|[GΤ](?=[insGνλΤ!])|Τ(?=-)", r"λ*(?:o|\*|&|-|\||<|>{1,3}|=|a|x)", "") + "|λB", "ε"),
        ("", r"λε|λB", "ε"), TERNARY, ("", r"ε(?:=ε)+", "ε"),
    ]
    simple = any_of(r"δ(?:=(?:ε|B))?(?:,ε(?:=B)?)*", r"ε(?:,ε)*", "Rε?", "Kε?", r"Tε(?::ε)?")
    stmt = rf"(?:[ηEDYQ]|C(?:ε(?:,ε)*[:r]|λ)|m[:r]|ε:)*(?:[Bβ]|;|{simple};|φ(?:[Bβ]|;|mε;)|mβ|ι)"
    brace = [("B", rf"(?:{stmt})*(?:Cε:|m:)*"), ("B", some("(?:ε|B)")), ("B", some("m?ε[Bβ]?") + f"(?:;(?:{stmt})*)?")]
    paren = [("G", some("ε")), ("Π", some("δ")), ("Η", r"(?:δ(?:=(?:ε|B))?(?:,ε)*|ε(?:,ε)*)?;ε?;(?:ε(?:,ε)*)?|δ:ε"), ("Τ", "τ|ε(?:&ε)+"), ("Π", r"(?:δ=ε|ε)(?:;(?:δ=ε|ε))*;?"), ("G", some("(?:ε=)?(?:ε|B|m)"))]
    return Grammar("java", kw, {**C_OPERATORS, "->": "r", "@": "@"}, C_COMMENT, r"\"\"\"[\s\S]*?\"\"\"|" + QUOTED, "none", steps, {"paren": paren, "square": [("A", "ε?")], "brace": brace, "top": [("", r"(?:ι|;|φ[Bβ])*")]})


def csharp() -> Grammar:
    kw = {**words("public private protected internal static readonly sealed abstract virtual override async partial extern unsafe volatile const ref out params event implicit explicit operator required", "m"), **words("int long short byte char bool float double decimal void string object uint ulong ushort sbyte dynamic", "t"), **words("class interface enum struct", "L"), "using": "M", "namespace": "P", "return": "R", "if": "I", "else": "E", **words("for foreach", "F"), "in": "X", "while": "W", "lock": "W", "do": "D", **words("break continue goto", "K"), "switch": "S", "case": "C", "default": "Z", "throw": "T", "try": "Y", "catch": "H", "finally": "Q", "new": "u", **words("this base", "i"), **words("null true false", "n"), **words("is as", "x"), "await": "!", **words("typeof sizeof nameof", "i")}
    gen = r"(?:<[i.,?A<>tG]*>)"
    typ = rf"(?:t|Π|i(?:[.q]i)*{gen}?(?:\.i{gen}?)*)(?:\?|A)*"
    steps = [
        ("top brace", r"(?:(?<=[;BβηEDYQφι])|^)A+(?=[mtiLA])", "m"), ("paren", r"(?:(?<=[,])|^)A+(?=[mti])", "m"),
        ("top brace", r"mM(?=i)|M(?=[mi])", "M"), ("top brace", r"Mm?(?:i=)?i(?:[.q]i)*;", "ι"), ("top brace", r"Pi(?:\.i)*(?=[B;])", "φ"),
        ("", rf"u(?:{typ})?(?:[GA]+B?|B)", "ν"),
        ("top brace", rf"{START}(?:m+(?:{typ})?|{typ})i{gen}?[GΠ](?::iG)?(?:i{typ}:[i,LuG]*)*(?=[B;r])|{START}i[GΠ](?::iG)?(?=B)", "φ"),
        ("top brace", rf"{START}m*Li{gen}?[GΠ]?(?::{typ}(?:,{typ})*)?(?:i{typ}:[i,LuG]*)*(?=[B;])", "φ"),
        ("top brace", rf"{START}m+{typ}(?:i|iA)(?=[Br])|{START}{typ}i(?=Β)", "φ"),
        ("top brace", r"IG|F[GΗ]|WG|SG(?=B)|H[GΠ]?(?:iG)?(?=B)|M[GΠ](?!;)", "η"),
        ("top brace", r"(?:(?<=[;Bβη:EDYQφ])|^)B", "β"),
        ("top brace", rf"(?:(?<=[;Bβη:EDYQιM])|^)m*{typ}i(?=[=;,])", "δ"),
        ("paren", rf"(?:(?<=[,;])|^)m*{typ}i(?=[,=;]|$)", "δ"), ("paren", rf"^m*{typ}i(?=X)", "δ"), ("paren", rf"(?:(?<=,)|^)m(?=[i(])", "!"), ("paren", rf"^(?:t(?:\?|A)*|i(?:\.i)*{gen}(?:\?|A)*|i(?:\.i)*(?:\?|A)+)$", "τ"),
        ("", r"m?(?:i|G|Π)r(?=[^,;])", "λ"),
        ("", r"λ*" + expression(any_of("i", "n", "s", "G", "ν", "t(?=\\.)", "ZG?(?!:)"), rf"\.i(?:{gen}(?=G))?|\?\.i|\?(?=A)|G|A|p|!(?=[.;,)]|$)|SB|x!?(?:t\??A*|i(?:\.i)*\??)i?(?=[^.GA=i]|$)", r"[!\-p]|[GΤ](?=[insGνλΤ!])", r"λ*(?:o|\*|&|-|\||<|>{1,3}|=|a|x)", "") + "|λB", "ε"),
        ("", r"λε|λ[Bβ]|Tε(?=$)", "ε"), TERNARY, ("", r"ε(?:=ε)+", "ε"),
    ]
    simple = any_of(r"M?δ(?:=(?:ε|B))?(?:,ε)*", r"ε(?:,ε)*", "Rε?", "K(?:ε|Cε|Z)?", "Tε?")
    stmt = rf"(?:[ηEDYQ]|Cε(?:ε)?:|Z:|ε:)*(?:[Bβ]|;|{simple};|φ(?:[Bβ](?:=(?:ε|B);)?|;|r(?:ε|[Bβ]);)|ι)"
    brace = [("B", f"(?:{stmt})*"), ("B", some(r"(?:ε|B|ε=B|A=ε)")), ("Β", r"(?:m*ε(?:;|[Bβ]|rε;))*"), ("B", some("(?:ε|Z)(?:Iε)?(?:rε)?"))]
    paren = [("G", some(r"(?:ε:)?ε")), ("Π", some(r"δ(?:=ε)?|!?m*δ")), ("Η", r"(?:δ(?:=(?:ε|B))?(?:,ε)*|ε(?:,ε)*)?;ε?;(?:ε(?:,ε)*)?|δXε"), ("Τ", "τ"), ("Π", r"δ=ε|" + some(r"[ti]"))]
    return Grammar("csharp", kw, {**C_OPERATORS, "=>": "r", "??": "o", "??=": "a", "->": "."}, C_COMMENT, r"[$@]{1,2}\"(?:[^\"]|\"\")*+\"|\"\"\"[\s\S]*?\"\"\"|" + QUOTED, "none", steps, {"paren": paren, "square": [("A", some(r"(?:ε:)?ε") + "|,*")], "brace": brace, "top": [("", r"(?:ι|;|φ(?:[Bβ]|;)|m;?|" + simple + ";)*")]}, directive=r"\s*#\s*(?:if|elif|else|endif|region|endregion|pragma|define|undef|nullable|error|warning|line)\b.*")


def c_language() -> Grammar:
    kw = {**words("static const extern register volatile inline signed restrict typedef auto", "m"), **words("int long short char float double void unsigned _Bool bool size_t", "t"), **words("struct union enum", "L"), "return": "R", "if": "I", "else": "E", "for": "F", "while": "W", "do": "D", **words("break continue goto", "K"), "switch": "S", "case": "C", "default": "Z", "sizeof": "z", "NULL": "n"}
    base = r"m*(?:t+(?:m|t)*|Li?B|Li|i)m*"
    ptr = r"(?:\*m*)*"
    steps = [
        ("", r"z(?:G|Τ|Π|i)", "n"),
        ("top brace", rf"{START}{base}{ptr}i[GΠ](?=[B;])", "φ"),
        ("top brace", r"IG|FΗ|WG|SG(?=B)", "η"),
        ("top brace", r"(?:(?<=[;Bβη:EDφ])|^)B", "β"),
        ("top brace", rf"(?:(?<=[;Bβη:ED])|^){base}{ptr}(?:i|Τ|G(?=[GΠ]))(?:A|Π|G)*(?=[=;,:])", "δ"), ("top brace", r"(?:(?<=[;Bβη])|^)m*L(?:i[Bβ]?|[Bβ])(?=;)", "δ"),
        ("paren", rf"(?:(?<=[,;])|^)m*(?:t+(?:m|t)*|Li|i)m*{ptr}(?:i|[GΤ](?=[GΠ]))(?:A|Π|G)*(?=[,=;]|$)", "δ"), ("paren", rf"^m*(?:t+(?:m|t)*|Li|i(?=\*))m*{ptr}$|^\*+i?(?:A|G)*$|(?:(?<=,)|^)m*t+m*{ptr}A*(?=,|$)", "τ"),
        ("", expression(any_of("i", "n", "s+", "G"), r"\.i|G|A|p", r"[!\-*&p]|[GΤΠ](?=[insGΤΠ!*&\-B])", r"(?:o|\*|&|-|\||<|>{1,2}|=|a)", "") + "|ΤB", "ε"),
        TERNARY, ("", r"ε(?:=ε)+", "ε"),
    ]
    simple = any_of(r"δ(?::ε)?(?:=(?:ε|B))?(?:,ε(?:=B)?)*", r"ε(?:,ε)*", "R(?:ε|B)?", "Kε?")
    stmt = rf"(?:[ηED]|Cε:|Z:|ε:)*(?:[Bβ]|;|{simple};)"
    brace = [("B", f"(?:{stmt}|φ;)*"), ("B", some(r"(?:(?:\.ε=|A=)?(?:ε|B))"))]
    paren = [("G", r"ε?(?:,ε)*"), ("Π", r"(?:[δτ](?:,[δτ])*(?:,v)?)?"), ("Η", r"(?:δ(?:=(?:ε|B))?(?:,ε)*|ε(?:,ε)*)?;ε?;(?:ε(?:,ε)*)?"), ("Τ", "τ"), ("G", "(?:ε|τ)(?:,(?:ε|τ))*")]
    return Grammar("c", kw, {**C_OPERATORS, "->": "."}, C_COMMENT, r"(?:u8|[LuU])?\"(?:\\[\s\S]|[^\"\\\n])*+\"|[LuU]?'(?:\\[\s\S]|[^'\\\n])*+'", "none", steps, {"paren": paren, "square": [("A", "ε?")], "brace": brace, "top": [("", rf"(?:φ[Bβ;]|{simple};|;)*")]}, directive=r"\s*#\s*(?:include\s*(?:<[^>\n]+>|\"[^\"\n]+\"|[A-Z]\w*)|define\s+\w+|undef\s+\w+|if\b|ifdef\s+\w+|ifndef\s+\w+|elif\b|else\b|endif\b|pragma\b|error\b|warning\b|line\b).*|\s*#\s*$")


def script(typed: bool) -> Grammar:
    kw = {"function": "f", "return": "R", **words("const let var", "V"), "if": "I", "else": "E", "for": "F", **words("of in", "X"), "while": "W", "with": "W", "do": "D", **words("break continue debugger", "K"), "switch": "S", "case": "C", "default": "Z", "throw": "T", "try": "Y", "catch": "H", "finally": "Q", **words("new typeof void delete await yield", "!"), "class": "L", "extends": "e", "import": "M", "export": "P", "instanceof": "x", **words("this super", "i"), **words("null true false", "n"), "async": "j", "static": "m", "enum": "\x00"}
    gen, ret, types = "", "", []
    if typed:
        kw |= {**words("as satisfies", "y"), **words("interface enum namespace", "L"), "implements": "e", **words("public private protected readonly abstract declare keyof", "m")}
        gen = r"(?:<[i.,A<>|&snBΦGΠ=re?:m]*>)?"
        one = r"m*(?:!?i(?:\.i)*(?:<[i.,A<>|&snBΦGΠrm]*>)?|s|n|!i|B|Φ|A|[GΠ](?:r|(?=A)|(?=[|&,=;N{]|$)))A*"
        typ = rf"(?:[|&]?(?:[GΠ]r)*{one}(?:[|&](?:[GΠ]r)*{one})*(?:xi)?)"
        ret = rf"(?::{typ})?"
        types = [
            ("paren", rf"(?:(?<=,)|^)m*v?(?:i|A|B)[?]?:{typ}(?=[=,]|$)", "π"),
            ("", rf"V(?:i|A|B)!?:{typ}(?=[=;N,X]|$)", "Vi"), ("", rf"y{typ}", ""),
            ("top brace", rf"{START}P?m*ii{gen}={typ}(?=[;N]|$)|(?<=N)P?m*ii{gen}={typ}(?=[;N]|$)", "ι"),
            ("brace", rf"(?:(?<=[;NBμβ])|^)m*(?:i|s|A)[?!]?:{typ}(?=[=;N]|$)", "κ"),
        ]
    head = r"(?:(?<=[;NBβηEDYQφι,μ])|^)"
    steps = [
        ("top brace", r"M(?:(?:i,)?(?:i|[BΝ]|\*[yi]i)i)?s(?=[;N]|$)|P(?:[BΝ]|\*(?:[yi]i)?)(?:is)?(?=[;N]|$)", "ι"), ("top brace", r"PZ?(?=[VfLjmλiGB!sn\[(A])", ""),
        ("", rf"j?f\*?i?{gen}[GΠ]{ret}B", "φ"), ("", rf"m*Li?{gen}(?:e!?[i.,GA<>]+)*[BΦ]", "φ"),
        ("brace", rf"{head}(?:m|j|\*)*(?:i?[isnA]|[XZRVDKTMPfej!])[GΠ]{ret}B", "μ"),
        *types,
        ("top brace", r"IG|F!?[GΗ]|WG|SG(?=B)|H[GΠ]?(?=B)", "η"),
        ("top brace", r"(?:(?<=[;NBβηEDYQιφ])|^)φ", "Δ"), ("top brace", r"(?:(?<=[;NBβηEDYQιΔ])|^)B", "β"),
        ("", rf"j?(?:i|{gen}[GΠ]{ret})r", "λ"),
        ("", expression(any_of("i", "n", "s", "G", "A", "B", "φ", "λB", "MG", "j(?=[.G;,)=]|$)", r"X(?=[=;,.)]|$)"), r"\.[ijXZRVIEFWDKSCTYHQLMPfem!yn]|\.A|\.G|G|A|p|s" + (r"|!(?=[.,;)A=:N]|$)" if typed else ""), r"[!\-pv]", r"(?:o|\*|&|-|\||<|>{1,3}|=|a|X|x)", "λ*"), "ε"),
        TERNARY, ("", r"ε(?:[=aX]ε)+", "ε"),
    ]
    es = r"ε(?:,ε)*"
    simple = any_of(rf"Vε?(?:,ε)*", es, f"R(?:{es})?", f"T{es}", "Kε?", "ι", "Vi")
    stmt = rf"(?:[ηEDYQ]|Cε:|Z:|ε:)*(?:β|B|Δ|[;N]|{simple}[;N])"
    body = rf"(?:{stmt})*(?:(?:[ηEDYQ]|Cε:|Z:)*{simple})?"
    key = r"(?:ε|[XZRVIEFWDKSCTYHQLMPfejm])"
    obj = some(any_of(rf"{key}:ε", "ε", "μ", "j"))
    cls = rf"(?:μ|[;N]|m*(?:ε|κ)(?:=ε)?[;N]|mβ)*(?:m*(?:ε|κ)(?:=ε)?)?"
    paren = [("G", some("ε")), ("Π", some(r"(?:π(?:=ε)?|m*ε)")), ("Η", rf"(?:Vε?(?:,ε)*|{es})?;(?:{es})?;(?:{es})?|Vε|V?εXε"), ("G", es)]
    square = [("A", r",*(?:ε(?:,+ε)*,*)?"), *([("A", r"π|ε:.*")] if typed else [])]
    brace = [("B", body), ("B", obj), ("Ν", some(r"[εZ](?:εε|yε)?")), ("Φ", cls)]
    if typed:
        brace += [("Φ", rf"(?:κ[;,N]*|m*ε\??[GΠ]?:[ε|&BAλ<>=,!]*[;,N]+|ε[;,N]+)*(?:κ|m*ε\??[GΠ]?:[ε|&BAλ<>=,!]*)?")]
        paren += [("Π", r"(?:ε(?::ε)?|π)(?:,(?:ε(?::ε)?|π))*")]
    ops = {**C_OPERATORS, "=>": "r", **words("=== !== ?? **", "o"), "?.": ".", **words("??= ||= &&= **= >>>=", "a"), "@": "@"}
    ops.pop("::")
    regex = r"(?:(?<=[=(,:\[!&|?;{}\n])|(?<=[=(,:\[!&|?;{}] )|(?<=return ))/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
    return Grammar("typescript" if typed else "javascript", kw, ops, C_COMMENT, regex + "|" + QUOTED + r"|`(?:\\[\s\S]|[^`\\])*+`", "asi", steps, {"paren": paren, "square": square, "brace": brace, "top": [("", body)]})


def golang() -> Grammar:
    kw = {"package": "P", "import": "M", "func": "f", "return": "R", **words("var const", "V"), "type": "U", "if": "I", "else": "E", "for": "F", "range": "X", **words("switch select", "S"), "case": "C", "default": "Z", **words("break continue goto fallthrough", "K"), **words("go defer", "D"), "map": "m", "chan": "h", **words("struct interface", "L"), **words("nil true false", "n")}
    one = r"(?:i(?:\.i)?|L[BΦ]|[GΠ]|f[GΠ](?:i(?:\.i)?|[GΠ])?)"
    typ = rf"(?:(?:\*|A|mA|h|v|r)*{one})"
    steps = [
        ("top", r"M(?:[i.]?s|[GΙ])|Pi", "ι"),
        ("top", rf"(?:(?<=;)|^)f(?:[GΠ])?iA?[GΠ]{typ}?(?=[B;])", "φ"),
        ("top brace", rf"U(?:i=?{typ}|G)", "δ"), ("top brace", rf"V(?:i(?:,i)*{typ}?(?==|;|$)|G)", "δ"),
        ("", rf"f[GΠ]{typ}?B", "ν"),
        ("", r"(?:(?<=[=(,:;w!&*oRr{<>-])|^)(?:mA|A)(?:\*|A|mA|h)*(?:i(?:\.i)?|L[BΦ])(?=[BG])", "i"), ("", r"(?<=G)mA(?:\*|A|mA)*i(?:\.i)?(?=,|$)", "i"), ("paren", rf"^(?:mA|A|h)+{one}(?=,|$)", "i"),
        ("paren", rf"(?:(?<=,)|^)(?:i(?:,i)*)?(?:i|(?<=i))(?:(?:\*|A|mA|h|v|r)+{one}|i(?:\.i)?|f[GΠ]{typ}?|L[BΦ])(?=,|$)", "π"), ("paren", rf"(?:(?<=,)|^)(?:\*|A|mA|h)+{one}(?=,|$)", "π"),
        ("top brace", r"([IFS](?:[^BIFS]*))B", r"\1β"), ("top brace", r"(?<=[Eφ])B|(?:(?<=;)|^)B", "β"),
        ("", expression(any_of("i", "n", "s", "G", "ν"), r"\.i|\.G|\.Ι|G|A|B", r"[!\-*&r^]", r"(?:o|\*|&|-|\||<|>{1,2}|r)", ""), "ε"),
    ]
    es = r"ε(?:,ε)*"
    simple = any_of(rf"{es}(?:(?:=|a|w)(?:X?{es}))?", "εp", "εrε", "Xε")
    stmt = any_of(rf"δ(?:={es})?", simple, f"R(?:{es})?", "Kε?", "Dε", rf"I(?:{simple};)?εβ(?:EI(?:{simple};)?εβ)*(?:Eβ)?", rf"F(?:(?:{simple})?;ε?;(?:{simple})?|{simple})?β", rf"S(?:{simple};)?(?:{simple})?β", "β", "φβ?", "ι")
    body = rf"(?:(?:C(?:{simple}):|Z:|ε:)*(?:{stmt})?;)*(?:C(?:{simple}):|Z:)*(?:{stmt})?"
    brace = [("B", body), ("B", some(r"(?:(?:ε|B|β):)?(?:ε|B|β)") + ";?"), ("Φ", r"(?:[iε,.*Ahmνr]+(?:[GΠ][iε*A]*|[BΦ])?ε?;?)*")]
    paren = [("G", some("εv?")), ("Π", some("(?:π|ε)")), ("Ι", r"(?:ε?ε;?)*|(?:ε(?:,ε)*ε?(?:=" + es + ");?)*")]
    square = [("A", r"ε?|v|(?:ε)?:(?:ε)?(?::(?:ε)?)?|ε(?:,ε)*ε?|\*ε|i")]
    ops = {**C_OPERATORS, ":=": "w", "<-": "r", "&^": "o", "&^=": "a"}
    for o in ("?", "::", "~"):
        ops.pop(o, None)
    return Grammar("go", kw, ops, C_COMMENT, r"\"(?:\\.|[^\"\\\n])*+\"|`[^`]*+`|'(?:\\[^\n]{1,10}?|[^'\\\n])'", "semicolon", steps, {"paren": paren, "square": square, "brace": brace, "top": [("", body)]})


def rust() -> Grammar:
    kw = {"fn": "f", "let": "V", **words("mut ref dyn", "m"), "pub": "P", "use": "M", "mod": "U", **words("crate self Self super union await", "i"), **words("struct enum", "L"), **words("trait impl", "J"), "type": "Y", **words("const static", "v"), "if": "I", "else": "E", "for": "F", "in": "X", "while": "W", "loop": "D", "match": "S", "return": "R", **words("break continue", "K"), **words("unsafe async move extern", "u"), "where": "h", "as": "y", **words("true false", "n")}
    t = r"[&*mvJilqGΠA<>,!n\-r:]"
    pat = r"[im&qnsGΠAB|w<>*\-]"
    steps = [
        ("", r"#!?A", ""), ("", r"\.\.\.", ""),
        ("top brace", r"P?G?M[iq*BΝy,]+;", "ι"),
        ("top brace", rf"P?[GΠ]?[vus]*fi(?:<{t}*>)?[GΠ](?:r(?:[&*mvJilqGΠA<>,!\-]|r(?=[&i]))+)?(?:h[i<>,&lq:GΠ=!*m-]*)?(?=[B;])", "φ"),
        ("top brace", rf"P?[GΠ]?u*(?:L|J|U)(?:[i<>,&lq:A!mGΠ=\-]|F(?=[i&]))*(?:h[i<>,&lq:GΠ=!*m-]*)?(?=[BΦΝ;])", "φ"), ("top brace", rf"P?[GΠ]?Yi(?:<{t}*>)?={t}+(?=;)", "φ"), ("top brace", rf"P?[GΠ]?vm?i:{t}+(?==)", "δ"),
        ("", rf"V{pat}+(?::{t}+)?(?==(?!=)|;)", "δ"),
        ("", rf"F{pat}+X", "ψ"),
        ("", rf"y(?:\*m?|\*v)?(?:&|m)*i(?:qi)*(?:<{t}*>)?", ""),
        ("", rf"i(?:qi)*q<{t}*>(?:qi)*", "i"),
        ("top brace", r"([IWψS](?:[^BIWψSE;]*))B", r"\1β"), ("top brace paren", r"(?<=[EDu])B", "β"), ("top brace", r"(?:(?<=[;βφ])|^)B", "β"), ("top brace paren", r"l:(?=[WψD])", ""),
        ("", r"u?(?:(?:(?<=[(,=:;orRwβ{&])|^)\|[^|]*\||(?:(?<=[(,=:;rR])|^)o(?=[insGAB!*&\-Iβ]))(?:r[&mi<>qA]+(?=B))?", "λ"),
        ("", r"K(?:l)?(?=[;,}]|$)", "n"),
        ("", expression(any_of(r"q?i(?:qi)*(?:!(?:[GΠ]|A|B))?", "n", "s", "G", "A", "λB", "B(?=[^;])", "uβ", "w(?=$|[\\])])"), r"\.[in]|G|A|\?|(?<=i)B", r"[!\-*&m]|&&|R|w(?=[in])", r"(?:o|\*|&|-|\||<|>{1,2}|=(?!=)|a|w)", "λ*"), "ε"),
        ("", r"εw", "ε"), ("", r"λε", "ε"),
        ("top brace paren square", r"(?:Iδ?=?ε(?:oδ=ε)*β)(?:EI(?:δ=)?εβ)*(?:Eβ)?|W(?:δ=)?εβ|ψεβ|Dβ|Sεβ|uβ", "κ"),
        ("top brace paren square", r"λκ|(?<=[=rRo,\-*])κ(?:\.ε|\?)*", "ε"), ("", r"κ\.ε(?:\.ε)*", "ε"), ("", r"ε(?:=ε)+|Rε", "ε"), ("", r"ε(?:(?:o|-|\*|=|a)ε)+", "ε"),
    ]
    stmt = any_of(r"φ[BβΦΝ;]|ι|δ(?:=ε)?(?:Eβ)?;|ε;|κ;?|R;|;|β|εB")
    body = rf"(?:{stmt})*(?:ε|κ|R)?"
    arms = r"(?:(?:ε|[|wGΠBA,&mil])+(?:Iε)?r(?:ε|κ|B|β),?)*"
    brace = [("B", body), ("B", arms), ("B", some(r"(?:ε(?::ε)?|wε?)")), ("Φ", r"(?:P?G?ε:[ε&*mvJlqGΠA<>,!:\-]+?(?:,|$))*"), ("Ν", some(r"ε(?:[GΠ]|B|Φ)?(?:=ε)?")), ("Ν", some(r"[εqiy*BΝ]+"))]
    paren = [("G", some(r"(?:ε|κ)")), ("Π", some(rf"(?:[&lm]*ε|ε):[ε{t[1:-1]}]+?|[&lm]*ε")), ("Π", some(rf"P?G?[ε{t[1:-1]}]+")), ("Π", some(rf"{pat}+"))]
    square = [("A", some("(?:ε|κ)")), ("A", r"ε;ε"), ("A", rf"[ε{t[1:-1]}]+(?:;ε)?"), ("A", r"[εiqGΠ,=s]*")]
    ops = {**C_OPERATORS, "->": "r", "=>": "r", "..": "w", "..=": "w", "#": "#", "@": "w"}
    for o in ("++", "--", "..."):
        ops.pop(o)
    text = r"b?r#*\"[\s\S]*?\"#*|b?\"(?:\\[\s\S]|[^\"\\])*+\"|b?'(?:\\[^\n]{1,10}?|[^'\\\n])'|'[a-z_]\w*"
    return Grammar("rust", kw, ops, C_COMMENT, text, "none", steps, {"paren": paren, "square": square, "brace": brace, "top": [("", body)]})


def ruby() -> Grammar:
    kw = {"def": "d", "end": "»", **words("class module", "k"), **words("if unless", "I"), "elsif": "J", "else": "E", **words("while until", "W"), "for": "F", "in": "X", "do": "O", "case": "C", "when": "w", "then": "t", "begin": "Y", "rescue": "V", "ensure": "Z", **words("return break next redo", "R"), **words("yield self super", "i"), **words("nil true false", "n"), **words("and or", "o"), **words("not defined?", "!"), **words("alias undef", "L")}
    steps = [
        ("suite", r"^d(?:i\.)?(?:i=?|o|A|-|<)?(?:G|[i,=*&lnsAB]*)[N;]", "φ"), ("suite", r"^k(?:i(?:qi)*(?:<i(?:qi)*)?|oi)[N;]", "φ"),
        ("", r"\|[i,*&=lnsG]*\|", "π"),
        ("", r"(?:(?<=[N;=mtφπE])|^)i(?:[.q]i)*(?=[insl!])", "ξ"),
        ("", expression(any_of("i", "n", "s+", "G", "A", "B", "ß", "rG?[Bß]", "qi"), r"[.q][ik]|\.G|G|A|B|ß", r"[!\-*&]", r"(?:o|\*|&|-|\||<|>{1,2}|w)", ""), "ε"),
        ("", r"ε\?ε:ε", "ε"), ("", r"lε|εrε|l(?=[,N]|$)", "α"),
        ("", r"ξ[αε](?:,[αε])*", "ε"),
    ]
    args = r"ε(?:,ε)*"
    simple = any_of(rf"{args}(?:=(?:{args}))*", "εaε", rf"R(?:{args})?", "Lε,?ε?")
    stmt = rf"(?:{simple})(?:oε)*(?:mε|Vε)*"
    body = rf"(?:(?:{stmt})?[N;])*(?:{stmt})?"
    rescue = rf"(?:V(?:{args})?(?:ri|rε|α)?[Nt]{body})*(?:EN{body})?(?:ZN{body})?"
    suite = [("ß", s) for s in (rf"φ{body}{rescue}", rf"Iε[Nt;]+{body}(?:Jε[Nt;]+{body})*(?:EN?{body})?", rf"Wε[N;O]{body}", rf"F{args}Xε[N;O]{body}", rf"Oπ?N?{body}{rescue}", rf"C(?:ε)?N*(?:wε(?:,ε)*[Nt;]+{body})+(?:EN?{body})?", rf"YN?{body}{rescue}")]
    paren = [("G", some(r"N?[αε]")), ("G", some(r"[εα*&](?:=ε)?")), ("G", body)]
    brace = [("B", some(r"[αε]")), ("B", rf"π?N*{body}")]
    ops = {**C_OPERATORS, **words("=> ->", "r"), **words("** === =~ !~ <=>", "o"), **words(".. ...", "w"), "&.": ".", **words("||= &&= **=", "a")}
    ops.pop("++"), ops.pop("--")
    text = r"\"(?:\\[\s\S]|[^\"\\])*+\"|'(?:\\[\s\S]|[^'\\])*+'|`(?:\\.|[^`\\])*+`|%[wiqQ]?[\[({<][^\])}>]*+[\])}>]|(?:(?<=[(,=~\n])|(?<=[(,=~] )|(?<=if ))/(?:\\.|[^/\\\n])+/[imx]*|:\"[^\"\n]*\"|(?<![:\w]):(?!:)[A-Za-z_]\w*[?!=]?"
    name = r"[@$]{0,2}[A-Za-z_\u00AA-\u02FF\u0370-\u1FFF\u3040-\u30FF\u3400-\u9FFF\uAC00-\uD7A3]\w*(?:[?!](?![=~]))?(?::(?![:\w]))?"
    return Grammar("ruby", kw, ops, r"#[^\n]*|^=begin[\s\S]*?^=end[^\n]*", text, "line", steps, {"paren": paren, "square": [("A", some(r"[αε]"))], "brace": brace, "top": [("", body)], "suite": suite}, name_re=name)


def python() -> Grammar:
    kw = {"if": "I", "elif": "J", "else": "E", "for": "F", "in": "X", "while": "W", "def": "D", "class": "C", "return": "R", "import": "M", "from": "O", "as": "Q", "with": "T", "try": "Y", "except": "V", "finally": "Z", "raise": "H", **words("pass break continue", "P"), "lambda": "L", **words("and or", "o"), "not": "!", "is": "x", **words("None True False", "n"), "yield": "y", "del": "d", **words("global nonlocal", "g"), "assert": "S", "async": "j", "await": "!"}
    dotted = r"i(?:\.i)*"
    steps = [
        ("top suite", rf"O[.v]*(?:{dotted})?M(?:G|\*|i(?:Qi)?(?:,i(?:Qi)?)*)(?=[;N])|M{dotted}(?:Qi)?(?:,{dotted}(?:Qi)?)*(?=[;N])", "ι"),
        ("top suite", r"j?DiG(?=[:r])|CiG?(?=:)", "φ"),
        ("", r"L(?:\*?i(?:=[\-]?[ins])?(?:,\*?i(?:=[\-]?[ins])?)*)?:", "λ"),
        ("", r"j?F(?:\*?[iGA](?:\.i|A|G)*)(?:,\*?[iGA](?:\.i|A|G)*)*,?X", "ψ"),
        ("", expression(any_of("i", "n", "s+", "G", "A", "B"), r"\.i|G|A", r"[!\-*]", r"(?:o|\*|&|-|\||<|>|@(?!.*N[^N]*$)|x!?|!?X)", "λ*"), "ε"),
        ("", r"ε(?:IεEλ*ε)+", "ε"), ("", r"λε", "ε"), ("", r"εwε", "ε"), ("paren", r"yO?ε(?:,ε)*|y$", "ε"),
    ]
    tests = r"ε(?:,ε)*,?"
    comp = r"(?:ψε(?:,ε)*(?:Iε)*)+"
    value = any_of(tests, f"y(?:O?{tests})?")
    simple = any_of(rf"{tests}(?:={value})*", rf"εa{value}", rf"ε:ε(?:={value})?", f"R(?:{tests})?", "P", f"y(?:O?{tests})?", "ι", r"H(?:ε(?:Oε)?)?", f"d{tests}", "gε(?:,ε)*", "Sε(?:,ε)?")
    line = rf"{simple}(?:;{simple})*;?N"
    s = any_of("ß", line)
    compound = any_of(rf"Iε:{s}(?:Jε:{s})*(?:E:{s})?", rf"ψ{tests}:{s}(?:E:{s})?", rf"Wε:{s}(?:E:{s})?", rf"(?:@εN)*φ(?:rε)?:{s}", rf"j?Tε(?:Qε)?(?:,ε(?:Qε)?)*:{s}", rf"Y:{s}(?:(?:V(?:ε(?:Qε|,ε)?)?:{s})+(?:E:{s})?(?:Z:{s})?|Z:{s})")
    body = f"(?:{compound}|{line})"
    slc = r"(?:ε|ε?:ε?(?::ε?)?)"
    paren = [("G", some(rf"(?:ε(?:{comp})?|ε=ε|ε:ε(?:=ε)?|\*|o|εQε)"))]
    square = [("A", rf"(?:{slc}(?:,{slc})*,?|ε{comp})?")]
    brace = [("B", some(r"ε(?::ε)?")), ("B", rf"ε(?::ε)?{comp}")]
    ops = {**{c: c for c in "()[]{},;:.=*&|<>@"}, "+": "-", "-": "-", "~": "!", "**": "*", ":=": "w", "->": "r", "...": "n", **words("/ // % == != <= >= ^ << >>", "o"), **words("+= -= *= /= //= %= &= |= ^= <<= >>= **= @=", "a")}
    text = r"(?:[rRbBuUfF]{0,2})(?:\"\"\"(?:\\[\s\S]|[^\\])*?\"\"\"|'''(?:\\[\s\S]|[^\\])*?'''|\"(?:\\[\s\S]|[^\"\\\n])++\"|'(?:\\[\s\S]|[^'\\\n])++'|\"\"(?!\")|''(?!'))"
    return Grammar("python", kw, ops, r"#[^\n]*|\\\n", text, "layout", steps, {"paren": paren, "square": square, "brace": brace, "top": [("", f"{body}*")], "suite": [("ß", f"{body}+")]})


#: Extension of a path -> grammar.
GRAMMARS = {"py": python(), "js": script(False), "ts": script(True), "java": java(), "go": golang(), "rs": rust(), "cs": csharp(), "rb": ruby(), "c": c_language()}
for _g in GRAMMARS.values():
    _g.prepare()


# ---------------------------------------------------------------- token pairs that follow from the productions
def adjacency(pattern: str) -> tuple[bool, set[str], set[str], set[tuple[str, str]]]:
    """(may be empty, first, last, adjacent pairs) of a regular production, as in Glushkov's automaton."""
    def join(parts):
        nullable, first, last, pairs = True, set(), set(), set()
        for n, f, l, p in parts:
            pairs |= p | {(a, b) for a in last for b in f}
            first = first | f if nullable else first
            last = last | l if n else set(l)
            nullable = nullable and n
        return nullable, first, last, pairs

    def chars(items) -> set[str]:
        out = set()
        for op, a in items:
            out |= {chr(a)} if op is sre.LITERAL else {chr(c) for c in range(a[0], a[1] + 1)} if op is sre.RANGE else set()
        return out

    def walk(tree):
        parts = []
        for op, av in tree:
            if op is sre.LITERAL:
                c = {chr(av)}
                parts.append((False, c, c, set()))
            elif op in (sre.NOT_LITERAL, sre.ANY) or op is sre.IN and av[0][0] is sre.NEGATE:
                continue  # skips over what other productions describe
            elif op is sre.IN:
                c = chars(av)
                parts.append((False, c, c, set()))
            elif op is sre.BRANCH:
                sub = [walk(x) for x in av[1]]
                parts.append((any(s[0] for s in sub), *(set().union(*(s[i] for s in sub)) for i in (1, 2, 3))))
            elif op is sre.SUBPATTERN:
                parts.append(walk(av[3]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
                lo, hi, sub = av
                n, f, l, p = walk(sub)
                parts.append((n or lo == 0, f, l, p | {(a, b) for a in l for b in f} if hi is sre.MAXREPEAT or hi > 1 else p))
            # look-around and anchors take no token
        return join(parts)

    return walk(sre.parse(pattern))


BRACKETS = {**dict.fromkeys("GΠΗΤΙ", "()"), "A": "[]", **dict.fromkeys("BΒΦΝβ", "{}")}
KIND_BRACKETS = {"paren": "()", "square": "[]", "brace": "{}", "suite": "«»"}


def permissible_pairs(g: Grammar) -> set[str]:
    """Every two token classes that may stand side by side in a file of the language.

    Each reduction says what its symbol may stand for; first and last tokens of the symbols are found
    by iteration to a fixed point, and every pair of symbols that a production allows side by side
    yields the pairs of the tokens at their border.
    """
    tokens = set(g.keywords.values()) | set(g.operators.values()) | set("insl") | set("N;«»|m")
    first: dict[str, set[str]] = {}
    last: dict[str, set[str]] = {}
    pairs: set[tuple[str, str]] = set()
    dropped: list[tuple[set[str], set[str]]] = []
    starts: set[str] = set()
    for _on, pattern, symbol in g.steps:
        _n, f, l, p = adjacency(pattern)
        pairs |= p
        symbol = symbol.replace("\\1", "")
        if symbol == "":
            dropped.append((f, l))
        else:
            first.setdefault(symbol[0], set()).update(f)
            last.setdefault(symbol[-1], set()).update(l)
            pairs |= set(zip(symbol, symbol[1:]))
    for kind, rules in g.productions.items():
        a, b = KIND_BRACKETS.get(kind, ("", ""))
        for _symbol, pattern in rules:
            n, f, l, p = adjacency(pattern)
            pairs |= p
            starts |= f if kind in ("top", "brace") else set()
            if a:
                pairs |= {(a, x) for x in f} | {(x, b) for x in l} | ({(a, b)} if n else set())

    def border(table: dict[str, set[str]], side: int):
        memo: dict[str, set[str]] = {}

        def of(s: str) -> set[str]:
            seen, todo, out = set(), [s], set()
            while todo:
                x = todo.pop()
                if x in seen:
                    continue
                seen.add(x)
                if x in BRACKETS:
                    out.add(BRACKETS[x][side])
                elif x == "ß":
                    out.update("»" if side else "N«")
                elif x in tokens or x in "()[]{}":
                    out.add(x)
                todo.extend(table.get(x, ()))
            return out

        return lambda s: memo.setdefault(s, of(s))

    ahead, behind = border(first, 0), border(last, 1)
    out = {x + y for a, b in pairs for x in behind(a) for y in ahead(b)}
    everything = tokens | set("()[]{}")
    # what a reduction drops stands between, before or after expressions and declarations
    heads = {x for c in starts | set("εφιδ") for x in ahead(c)} | {y for a, b in pairs if a in "εφιδ" for y in ahead(b)}
    tails = {x for c in "εφιδ" for x in behind(c)} | {x for a, b in pairs if b in "εφιδ" for x in behind(a)}
    for f, l in dropped:
        out |= {x + y for x in tails for c in f for y in ahead(c)} | {x + y for c in l for x in behind(c) for y in heads}
    if g.productions.get("suite"):
        out |= {"N«", "»»", "»N"} | {"»" + x for x in everything} | {x + "«" for x in everything}
    return out
