"""Rules: from built-in packs, from one YAML file, or from a manifest of files."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from veilframe.sources.packs import ACTIVE, NATIVE, PACKS

CATEGORIES = ("IndividualName", "IdentificationNumber", "FinancialData", "ContactInfo", "InternalAsset", "HighConfidenceAi", "PotentialHeuristic", "Organization", "Location", "Other")
ACTIONS = ("Block", "Redact", "Mask", "AuditOnly")


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str  # R regular expression, D dictionary term, H heuristic, S heuristic that skips sentence starts
    category: str
    action: str
    pattern: str


@dataclass
class RuleSet:
    rules: list[Rule] = field(default_factory=list)
    ai_enabled: bool = False
    ai_threshold: float = 0.85

    def of(self, *kinds: str) -> list[Rule]:
        return [r for r in self.rules if r.kind in kinds]


def pack(*names: str, native: bool = False) -> RuleSet:
    """Built-in packs by name (all active ones by default)."""
    rows = [r for n in (names or ACTIVE) for r in PACKS[n]] + list(NATIVE if native else ())
    return RuleSet([Rule(*r) for r in rows])


def _yaml(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def from_file(path: str) -> RuleSet:
    data = _yaml(path)
    out = RuleSet(ai_enabled=bool(data.get("ai_enabled", False)), ai_threshold=float(data.get("ai_confidence_threshold", 0.85)))
    for r in data.get("rules") or []:
        kind = {"Regex": "R", "Dictionary": "D"}[r["type"]]
        out.rules.append(_checked(Rule(r["id"], kind, r.get("category", "Other"), r.get("action", "Redact"), r["pattern"])))
    for h in data.get("heuristics") or []:
        kind = "S" if h.get("skip_sentence_start") else "H"
        out.rules.append(_checked(Rule(h["label"], kind, h.get("category", "Other"), h.get("action", "Redact"), h["pattern"])))
    return out


def _checked(rule: Rule) -> Rule:
    if rule.category not in CATEGORIES or rule.action not in ACTIONS:
        raise ValueError(f"{rule.id}: unknown category or action")
    return rule


def from_manifest(path: str) -> tuple[RuleSet, list[str]]:
    """All files a manifest names, one after the other; a file that cannot be read, or that lies outside the rules
    folder, is a warning.  Any file that turns the model tier on sets the threshold; the last one wins."""
    data = _yaml(path)
    top = os.path.realpath(os.path.join(os.path.dirname(path), data.get("rules_dir", ".")))
    if not os.path.isdir(top):
        top = os.path.realpath(data.get("rules_dir", "."))
    out, warnings = RuleSet(), []
    for name in data.get("active_rules") or []:
        file = os.path.realpath(os.path.join(top, name))
        if not file.startswith(top + os.sep):
            warnings.append(f"{name}: outside the rules folder")
            continue
        try:
            more = from_file(file)
        except Exception as e:  # noqa: BLE001 - the manifest's contract: warn and go on
            warnings.append(f"{name}: {e}")
            continue
        out.rules += more.rules
        if more.ai_enabled:
            out.ai_enabled, out.ai_threshold = True, more.ai_threshold
    return out, warnings


def refuse_warnings(loaded: tuple[RuleSet, list[str]]) -> RuleSet:
    """The boot policy: a job does not start on a manifest with warnings."""
    rules, warnings = loaded
    if warnings:
        raise ValueError("; ".join(warnings))
    return rules


class HotRules:
    """Reads a manifest again when it or a file it names has changed; for foreachBatch."""

    def __init__(self, path: str):
        self.path, self._stamp, self._rules = path, None, None

    def current(self) -> RuleSet:
        data = _yaml(self.path)
        top = os.path.join(os.path.dirname(self.path), data.get("rules_dir", "."))
        files = [self.path, *(os.path.join(top, n) for n in data.get("active_rules") or [])]
        stamp = [(f, os.path.getmtime(f)) for f in files if os.path.exists(f)]
        if stamp != self._stamp:
            self._rules, self._stamp = refuse_warnings(from_manifest(self.path)), stamp
        return self._rules


def rules_frame(spark, rules: RuleSet):
    return spark.createDataFrame([(r.id, r.kind, r.category, r.action, r.pattern) for r in rules.rules], "id string, kind string, category string, action string, pattern string")
