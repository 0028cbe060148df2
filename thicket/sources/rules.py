"""Rules: reading YAML, validating, configuration and rule sets. All of it is small and on the driver."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CONDITIONS = ("pattern", "any", "all", "not", "kind", "regex", "inside", "notInside", "has", "notHas", "precedes", "follows")
#: Where rules are looked for if none are named.
DEFAULT_PLACES = ("rules", ".rules", "rules.yaml", ".thicket.yaml")
RULESETS = ("none", "security", "performance", "quality", "all")


class RuleError(ValueError):
    """A rule that can't be used."""


@dataclass(frozen=True)
class Rule:
    id: str
    language: str
    message: str
    rule: dict
    severity: str = "warning"
    note: str | None = None
    url: str | None = None
    fix: str | None = None
    constraints: dict = field(default_factory=dict)
    files: tuple[str, ...] = ()
    ignores: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    enabled: bool = True
    examples: dict = field(default_factory=dict)


def make_rule(d: dict) -> Rule:
    """A rule of a parsed document; the four required parts are checked."""
    d = dict(d)
    body = d.pop("rule", None)
    if body is None:
        body = {k: d.pop(k) for k in CONDITIONS if k in d}
    for k in ("id", "language", "message"):
        if not str(d.get(k) or "").strip():
            raise RuleError(f"rule {d.get('id')!r} has no {k}")
    if not isinstance(body, dict) or not any(k in body for k in CONDITIONS):
        raise RuleError(f"rule {d['id']!r} has no condition")
    severity = str(d.get("severity") or "warning").strip().lower()
    if severity not in ("hint", "info", "warning", "error"):
        raise RuleError(f"rule {d['id']!r} has severity {severity!r}")
    many = lambda k: tuple(d.get(k) or ())
    return Rule(str(d["id"]), str(d["language"]).strip(), str(d["message"]), body, severity, d.get("note"), d.get("url"), d.get("fix"), d.get("constraints") or {}, many("files"), many("ignores"), many("tags"), d.get("enabled", True) is not False, d.get("examples") or {})


def parse_rules(text: str, strict: bool = True) -> list[Rule]:
    """Rules of a YAML text: one or more documents, each a rule, a list of rules, or a mapping with `rules`."""
    import yaml

    out = []
    for doc in yaml.safe_load_all(text):
        for d in doc.get("rules", [doc]) if isinstance(doc, dict) else doc or []:
            try:
                out.append(make_rule(d))
            except (RuleError, AttributeError, TypeError):
                if strict:
                    raise
    return out


def load_rules(path: str, strict: bool = True) -> list[Rule]:
    """Rules of a file, or of all .yaml and .yml files below a folder in order of their paths."""
    p = Path(path)
    files = sorted(f for f in p.rglob("*") if f.suffix in (".yaml", ".yml")) if p.is_dir() else [p]
    return [r for f in files for r in parse_rules(f.read_text(encoding="utf-8"), strict)]


def discover_rules(root: str) -> list[Rule]:
    """Rules of the first default place that exists below `root`; none if there is none."""
    for place in DEFAULT_PLACES:
        p = Path(root, place)
        if p.exists():
            return load_rules(str(p), strict=False)
    return []


def discover_config(start: str, name: str = ".thicket.yaml") -> Path | None:
    """The configuration file in `start` or the nearest folder above."""
    here = Path(start).resolve()
    return next((d / name for d in (here, *here.parents) if (d / name).is_file()), None)


def apply_config(rules: Iterable[Rule], config: dict) -> list[Rule]:
    """Disable rules, override severity, enabled and fix, and add file globs for all, as a configuration says."""
    off = {str(x).lower() for x in config.get("disableRules") or ()}
    overrides = {str(k).lower(): v or {} for k, v in (config.get("ruleOverrides") or {}).items()}
    out = []
    for r in rules:
        o = overrides.get(r.id.lower(), {})
        changes = {k: o[k] for k in ("severity", "enabled", "fix") if o.get(k) is not None}
        r = replace(r, **changes, files=(*r.files, *(config.get("files") or ())), ignores=(*r.ignores, *(config.get("ignores") or ())))
        out.append(replace(r, enabled=False) if r.id.lower() in off else r)
    return out


def merge(*sets: Iterable[Rule]) -> list[Rule]:
    """Rules of several sets; of equal ids the last one counts, in the place of the first."""
    by: dict[str, Rule] = {}
    for s in sets:
        for r in s:
            by[r.id] = r
    return list(by.values())


def ruleset(name: str) -> list[Rule]:
    """The built-in rules of a set: none, security, performance, quality or all."""
    if name not in RULESETS:
        raise RuleError(f"unknown rule set {name!r}")
    if name == "none":
        return []
    rules = load_rules(str(Path(__file__).resolve().parent / "builtin_rules.yaml"))
    return [r for r in rules if name == "all" or name in r.tags]


def extensions_of(rules: Iterable[Rule]) -> list[str]:
    """Sorted extensions of the rules' languages; empty, meaning all, only if every rule is universal."""
    from ..schema import ALIASES, LANGUAGES, UNIVERSAL

    out = set()
    for r in rules:
        lang = ALIASES.get(r.language.lower(), r.language.lower())
        if lang not in UNIVERSAL:
            out |= set(LANGUAGES.get(lang, "").split())
    return sorted(out)


SCHEMA = "rule_id string, language string, severity string, message string, note string, url string, rule_json string, constraints_json string, fix string, files array<string>, ignores array<string>, tags array<string>, enabled boolean"


def to_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    rows = [(r.id, r.language, r.severity, r.message, r.note, r.url, json.dumps(r.rule), json.dumps(r.constraints), r.fix, list(r.files), list(r.ignores), list(r.tags), r.enabled) for r in rules]
    return spark.createDataFrame(rows, SCHEMA)


def from_frame(df: DataFrame) -> list[Rule]:
    """Rules of a table like scan_rules (bounded: rules are programs, read to the driver); null severity is warning."""
    out = []
    for r in df.orderBy("rule_id").collect():
        d = r.asDict()
        body = json.loads(d["rule_json"])
        out.append(Rule(d["rule_id"], d["language"], d["message"] or d["rule_id"], body, (d.get("severity") or "warning").lower(), d.get("note"), d.get("url"), d.get("fix"), json.loads(d.get("constraints_json") or "{}"), tuple(d.get("files") or ()), tuple(d.get("ignores") or ()), tuple(d.get("tags") or ()), d.get("enabled") is not False))
    return out
