"""The whole detection engine as one Arrow kernel: normalise, terms, patterns, names, promotion, fusion, resolution.

The native form in ``spans`` covers rules without names and look-alikes; this one is for what depends on order: name
hits widen confirmed spans one by one, and fusion uses potentials up.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame

from veilframe.functions.text import PREFIX_BY_CATEGORY, PREFIX_BY_RULE, PRIORITY
from veilframe.operators.intervals import Cover, Intervals
from veilframe.operators.names import OF_CANDIDATES, PATTERNS, find_candidates, find_names
from veilframe.operators.normalize import normalize
from veilframe.operators.prefilter import Prefilter
from veilframe.operators.windows import confirmed_by
from veilframe.ship import ship
from veilframe.sources.rules import RuleSet
from veilframe.sources.words import Words

REPORT = (
    "sanitized_text string, is_blocked boolean, redactions array<struct<rule_id:string,action:string,offset:long,length:long,placeholder:string,category:string>>, "
    "token_map map<string,string>, potential_misses array<struct<text:string,label:string,offset:long>>"
)
#: Characters of texts that patterns are looked for in together; one longer text is looked at by itself.
TOGETHER = 1_000_000
#: Rows of a batch of reports.
ROWS = 1000
#: Fixed value: a verdict with this score needs no other look.
SURE = 0.95
#: What may stand between a confirmed name and a potential that fuses with it, beside white space.
JOINTS = (" bin ", " al ", " da ", " de ", " van ", " von ")


def placeholder_prefix(rule_id: str, category: str) -> str:
    up = rule_id.upper()
    return next((p for p, parts in PREFIX_BY_RULE if any(x in up for x in parts)), PREFIX_BY_CATEGORY.get(category, "TOKEN"))


class Span:
    __slots__ = ("start", "end", "rule", "action", "category")

    def __init__(self, start: int, end: int, rule: str, action: str, category: str):
        self.start, self.end, self.rule, self.action, self.category = start, end, rule, action, category

    def stronger(self, action: str) -> None:
        if PRIORITY[action] > PRIORITY[self.action]:
            self.action = action

    def name_too(self, rule: str) -> None:
        if rule not in self.rule.split("+"):
            self.rule += "+" + rule


def packed(confirmed: list[Span], potential: list[Span], candidates: list) -> bytes:
    """What was found in a text, for ``Engine.report`` of a later pass."""
    spans = [[(s.start, s.end, s.rule, s.action, s.category) for s in of] for of in (confirmed, potential)]
    return pickle.dumps((*spans, candidates))


def unpacked(found: bytes) -> tuple[list[Span], list[Span], list]:
    confirmed, potential, candidates = pickle.loads(found)
    return [Span(*s) for s in confirmed], [Span(*s) for s in potential], candidates


class Tokens:
    """Numbers placeholders; one for each text, or one for each session."""

    def __init__(self):
        self.by_text: dict[str, str] = {}

    def of(self, text: str, span: Span) -> str:
        return self.by_text.setdefault(text.lower(), f"[{placeholder_prefix(span.rule, span.category)}_{len(self.by_text) + 1}]")


class Terms:
    """All dictionary terms as one automaton: a text is read once, however many terms there are."""

    def __init__(self, terms: list):
        """terms: (rule, its term in lower-case ASCII)."""
        self.rules = [(r, t) for r, t in terms if t]
        self.order = {r.id: k for k, (r, _) in reversed(list(enumerate(self.rules)))}
        self.by_term: dict[str, list] = {}
        for rule, term in self.rules:
            self.by_term.setdefault(term, []).append(rule)
        # a text with more letters than any term is none of them
        self.longer = re.compile(rf"(?:[\W_]*[^\W_]){{{max(map(len, self.by_term), default=0) + 1}}}")
        self.automaton = None
        if self.by_term:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for term, rules in self.by_term.items():
                self.automaton.add_word(term, (len(term), rules))
            self.automaton.make_automaton()

    def found(self, low: str) -> Iterator[tuple]:
        """(rule, start, end) of each term with no letter or digit beside it, overlapping ones too."""
        for last, (size, rules) in self.automaton.iter(low):
            at, end = last + 1 - size, last + 1
            if not (at and low[at - 1].isalnum()) and not (end < len(low) and low[end].isalnum()):
                for rule in rules:
                    yield rule, at, end

    def equal(self, n) -> list:
        return [] if self.longer.match(n.ascii) else self.by_term.get(n.stripped, [])


class _Following:
    """Potential spans by their starts: which one may follow a confirmed span?"""

    def __init__(self, text: str, potential: list[Span]):
        self.text, self.potential = text, potential
        self.at: dict[int, list[int]] = {}
        for k, p in enumerate(potential):
            self.at.setdefault(p.start, []).append(k)
        self.starts = sorted(self.at)
        self.used: set[int] = set()

    def take(self, end: int) -> Span | None:
        """The first listed one after ``end`` with nothing but white space, or a joint of names, between."""
        if len(self.used) == len(self.potential):
            return None
        near = self.starts[bisect_left(self.starts, end) : bisect_right(self.starts, _BLANK.match(self.text, end).end())]
        near += [end + len(j) for j in JOINTS if self.text.startswith(j, end)]
        k = min((k for s in near for k in self.at.get(s, ()) if k not in self.used), default=None)
        if k is None:
            return None
        self.used.add(k)
        return self.potential[k]

    def left(self) -> list[Span]:
        return [p for k, p in enumerate(self.potential) if k not in self.used]


_BLANK = re.compile(r"\s*")


class Engine:
    def __init__(self, rules: RuleSet, words: Words | None = None, verdicts: dict[str, tuple[str, float]] | None = None, threshold: float = 0.85):
        """verdicts: what a model has said before of names (their ASCII reading in lower case): label and score.
        threshold: the score that an answer about a candidate needs, if it is less than the fixed ones."""
        self.words, self.verdicts, self.threshold = words or Words(), verdicts or {}, threshold
        self.terms = Terms([(r, normalize(r.pattern).ascii.lower()) for r in rules.of("D")])
        self.patterns = [(r, re.compile(r.pattern)) for r in rules.of("R")]
        self.heuristics = [(r, re.compile(r.pattern)) for r in rules.of("H", "S")]
        self.for_rules = Prefilter({f"{r.id} {p.pattern}": p.pattern for r, p in self.patterns})
        self.for_candidates = Prefilter({k: p.pattern for k, p in OF_CANDIDATES.items()})
        self.for_names = Prefilter({k: p.pattern for k, p in PATTERNS.items()} | {f"{r.id} {p.pattern}": p.pattern for r, p in self.heuristics})

    def prepared(self, texts: list[str | None], candidates: bool = False) -> Iterator[tuple]:
        """What ``report`` need not find out again for each text: its readings, and the patterns that it cannot hold, which
        are looked for in many texts at once; with candidates, those of candidates too."""
        at = 0
        while at < len(texts):
            to, held = at, 0
            while to < len(texts) and (to == at or held + len(texts[to] or "") <= TOGETHER):
                held += len(texts[to] or "")
                to += 1
            read = [normalize(t or "") for t in texts[at:to]]
            unicode, other = [n.unicode for n in read], [k for k, n in enumerate(read) if n.ascii != n.unicode]
            of_unicode = self.for_names.absent([x.replace("_", " ") for x in unicode])
            of_ascii = list(of_unicode)
            for k, names in zip(other, self.for_names.absent([read[k].ascii.replace("_", " ") for k in other])):
                of_ascii[k] = names
            more = (self.for_candidates.absent(unicode),) if candidates else ()
            yield from zip(read, self.for_rules.absent(unicode), zip(of_unicode, of_ascii), *more)
            at = to

    def reports(self, texts: list[str | None], said: list | None = None) -> list[dict | None]:
        said = said or [None] * len(texts)
        return [None if t is None else self.report(t, None, known, answers) for t, known, answers in zip(texts, self.prepared(texts, any(said)), said)]

    def candidates(self, n, confirmed: list[Span], absent: set | tuple = ()) -> list[tuple[int, int, str, bool]]:
        return find_candidates(n.unicode, [(s.start, s.end) for s in confirmed], self.words, absent)

    def settled(self, n, confirmed: list[Span], said: list, candidates: list) -> list[Span]:
        """The confirmed spans and those that answers of a model confirm."""
        known = [(s.start, s.end) for s in confirmed]
        more = [Span(a, b, rule, "Redact", "HighConfidenceAi") for a, b, rule in confirmed_by(n.unicode, candidates, known, said, self.threshold, self.words)]
        return sorted(confirmed + more, key=lambda s: (s.start, -s.end))

    def _terms(self, n) -> list[Span]:
        if not self.terms.rules:
            return []
        low, out = n.ascii.lower(), []
        for rule, at, end in self.terms.found(low):
            out.append(Span(n.to_unicode[n.from_ascii[at]], n.to_unicode[n.from_ascii[end]], rule.id, rule.action, rule.category))
        for rule in self.terms.equal(n):  # the whole text, whatever separates its letters
            letters = [i for i, c in enumerate(n.ascii) if c.isalnum()]
            end = n.from_ascii[letters[-1]] + 1
            out.append(Span(n.to_unicode[n.from_ascii[letters[0]]], n.to_unicode[end], rule.id, rule.action, rule.category))
        order = self.terms.order
        return sorted(out, key=lambda s: order[s.rule])

    def _patterns(self, n, absent: set | tuple = ()) -> list[Span]:
        out = []
        for rule, pattern in self.patterns:
            if f"{rule.id} {pattern.pattern}" in absent:
                continue
            at = 0
            while at < len(n.unicode) and (m := pattern.search(n.unicode, at)):
                out.append(Span(m.start(), m.end(), rule.id, rule.action, rule.category))
                at = (m.start() if m.end() > m.start() else at) + 1
        return out

    def detect(self, n, rules: set | tuple = (), names: tuple = ((), ())) -> tuple[list[Span], list[Span]]:
        """(confirmed, potential), in characters of the Unicode reading."""
        confirmed = sorted(self._terms(n) + self._patterns(n, rules), key=lambda s: (s.start, -s.end))
        at = Intervals((s.start, s.end) for s in confirmed)
        potential: list[Span] = []

        def confirm(*span) -> None:
            confirmed.append(Span(*span))
            at.add(span[0], span[1])

        for f in find_names(n.unicode, n.ascii, self.heuristics, self.words, names):
            back = n.from_ascii if f.ascii else n.from_unicode
            start, end = n.to_unicode[back[f.start]], n.to_unicode[back[f.end]]
            said, score = self.verdicts.get(n.ascii[n.to_ascii[back[f.start]] : n.to_ascii[back[f.end]]].lower(), ("", 0.0)) if self.verdicts else ("", 0.0)
            k = at.first(start, end)
            if k is not None:
                hit = confirmed[k]
                hit.start, hit.end = min(hit.start, start), max(hit.end, end)
                hit.stronger(f.action)
                at.widen(k, start, end)
            elif score >= SURE:
                confirm(start, end, f"ai_cache_{said}", f.action, "HighConfidenceAi")
            elif f.action == "AuditOnly":
                confirm(start, end, f.label, f.action, f.category)
            elif f.category == "IndividualName":
                confirm(start, end, f"heuristic_promotion_{f.label}", f.action, f.category)
            else:
                potential.append(Span(start, end, f.label, f.action, f.category))
        return sorted(confirmed, key=lambda s: (s.start, -s.end)), potential

    def resolve(self, text: str, confirmed: list[Span], potential: list[Span]) -> list[Span]:
        """Confirmed spans swallow potentials that follow them, fuse with neighbours and merge with what they overlap."""
        out: list[Span] = []
        following = _Following(text, potential)
        for s in confirmed:
            while (p := following.take(s.end)) is not None:
                s.end, s.rule = p.end, s.rule + "+fused"
                s.stronger(p.action)
            if out and s.start >= out[-1].end and not text[out[-1].end : s.start].strip():
                out[-1].end = s.end
                out[-1].name_too(s.rule)
                out[-1].stronger(s.action)
            elif out and s.start < out[-1].end:
                last = out[-1]
                rank = (PRIORITY[s.action], s.end - s.start)
                mine = (PRIORITY[last.action], last.end - last.start)
                if rank[0] > mine[0] or (rank[0] == mine[0] and rank[1] > mine[1]):
                    last.rule = s.rule
                elif rank == mine:
                    last.name_too(s.rule)
                last.stronger(s.action)
                last.end = max(last.end, s.end)
            else:
                out.append(s)
        potential[:] = following.left()
        return out

    def report(self, text: str, tokens=None, known: tuple | None = None, said: list | None = None, found: bytes | None = None) -> dict:
        """said: answers of a model about this text's candidates (``windows.confirmed_by``).
        found: what was found in it before (``packed``), which is not looked for again."""
        if found is None:
            n, rules, names, *more = known or (normalize(text), (), ((), ()))
            confirmed, potential = self.detect(n, rules, names)
            candidates = self.candidates(n, confirmed, *more) if said else []
        else:
            n, (confirmed, potential, candidates) = normalize(text), unpacked(found)
        if said:
            confirmed = self.settled(n, confirmed, said, candidates)
        spans = self.resolve(n.unicode, confirmed, potential)
        tokens = tokens or Tokens()
        width = _byte_offsets(text)
        shown, hidden, parts, at, mapped = [], [], [], 0, {}
        for s in spans:
            a, b = n.from_unicode[s.start], n.from_unicode[s.end]
            value = n.unicode[s.start : s.end]
            entry = {"rule_id": s.rule, "action": s.action, "offset": width(a), "length": width(b) - width(a), "placeholder": "", "category": s.category}
            if s.action == "AuditOnly":
                shown.append(entry)
                continue
            token = tokens.of(value, s)
            mapped[token] = value
            parts += [text[at:a], token]
            at = b
            hidden.append(entry | {"placeholder": token})
        reds = shown + hidden
        misses, covered = [], Cover((r["offset"], r["offset"] + r["length"]) for r in reds)
        for p in potential:
            o = width(n.from_unicode[p.start])
            if not covered.holds(o):
                misses.append({"text": n.unicode[p.start : p.end], "label": p.rule, "offset": o})
        return {
            "sanitized_text": "".join([*parts, text[at:]]), "is_blocked": any(r["action"] == "Block" for r in reds), "redactions": reds,
            "token_map": list(mapped.items()), "potential_misses": misses,
        }


def _byte_offsets(text: str):
    """Bytes of the first i characters of a text, from running sums that are made when first asked for."""
    if text.isascii():
        return lambda i: i
    sums: list = []

    def width(i: int) -> int:
        if not sums:
            import numpy as np

            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
            sums.append(np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)))
        return int(sums[0][i - 1]) if i else 0

    return width


def _in_lists(column):
    """(bounds of each row's values, the fields of all values) of a column of lists of structs."""
    import numpy as np

    at = column.offsets.to_numpy() if len(column) else np.zeros(1, np.int32)  # no rows may come without offsets
    return at - at[0], column.values.slice(at[0], at[-1] - at[0]).flatten()


def answers_of(column) -> list[list[tuple]]:
    """The answers of each row, field by field for all rows at once; a null row has none."""
    at, (kinds, places, entities) = _in_lists(column)
    of, fields = _in_lists(entities)
    flat = list(zip(*(f.to_pylist() if f.null_count or f.type == "string" else f.to_numpy().tolist() for f in fields)))
    of = of.tolist()
    every = list(zip(kinds.to_pylist(), places.to_pylist(), (flat[a:b] for a, b in zip(of, of[1:]))))
    at = at.tolist()
    return [every[a:b] for a, b in zip(at, at[1:])]


def scrub(df: DataFrame, rules: RuleSet, column: str = "text", words: Words | None = None, said: str | None = None, threshold: float = 0.85, found: str | None = None) -> DataFrame:
    """df with ``report``; null texts have a null report.

    said: a column of answers (``verdicts.SAID``) about each text's candidates; it is not returned.
    found: a column of what was found in each text before (``packed``); neither is it.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    ship(df.sparkSession)
    arrow = to_arrow_type(_parse_datatype_string(REPORT))
    keep = [i for i, f in enumerate(df.schema.fields) if f.name not in (said, found)]
    schema = StructType([*(df.schema.fields[i] for i in keep), StructField("report", _parse_datatype_string(REPORT))])
    made: dict = {}

    def answers(part) -> list | None:
        return said and answers_of(part.column(said))

    def run(batches: Iterator) -> Iterator:
        engine = made.setdefault("engine", Engine(rules, words, None, threshold))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(column).to_pylist()
                if found:
                    reports = [None if t is None else engine.report(t, None, None, known, f) for t, known, f in zip(texts, answers(part) or [None] * len(texts), part.column(found).to_pylist())]
                else:
                    reports = engine.reports(texts, answers(part))
                yield pa.RecordBatch.from_arrays([*map(part.column, keep), pa.array(reports, arrow)], names=[*(batch.schema.names[i] for i in keep), "report"])

    return df.mapInArrow(run, schema)


def _found(df: DataFrame, column: str, rules: RuleSet, words: Words | None, kind: str, prepared, find) -> DataFrame:
    """A row for each of find(engine, *x) for x in prepared(engine, texts): the other columns, start, end, ``kind``, match."""
    import pyarrow as pa

    ship(df.sparkSession)
    keep = [c for c in df.columns if c != column]
    schema = ", ".join([*(f"`{c}` {dict(df.dtypes)[c]}" for c in keep), "start int", "end int", f"{kind} string", "match string"])

    def run(batches: Iterator) -> Iterator:
        engine = Engine(rules, words)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [t or "" for t in part.column(column).to_pylist()]
                rows = [(i, *found) for i, known in enumerate(prepared(engine, texts)) for found in find(engine, *known)]
                which, *cols = zip(*rows) if rows else ([], [], [], [], [])
                cols = [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.string()))]
                which = pa.array(which, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(which) for c in keep), *cols], names=[*keep, "start", "end", kind, "match"])

    return df.select(*(f"`{c}`" for c in keep), f"`{column}`").mapInArrow(run, schema)


def name_spans(df: DataFrame, column: str = "text", heuristics: RuleSet | None = None, words: Words | None = None) -> DataFrame:
    """A row for each certain name: the other columns, start, end, label, match (in the text as normalised)."""

    def find(engine: Engine, n, rules, names) -> Iterator[tuple]:
        for f in find_names(n.unicode, n.ascii, engine.heuristics, engine.words, names):
            yield f.start, f.end, f.label, (n.ascii if f.ascii else n.unicode)[f.start : f.end]

    return _found(df, column, heuristics or RuleSet(), words, "label", Engine.prepared, find)


def name_candidates(df: DataFrame, column: str = "text", words: Words | None = None, rules: RuleSet | None = None) -> DataFrame:
    """A row for each span that only a model could settle: the other columns, start, end, kind, match.

    What ``rules`` and the certain names confirm in a text is no candidate there; without rules, nothing is confirmed.
    """

    def find(engine: Engine, n, absent, names, more) -> Iterator[tuple]:
        known = [] if rules is None else [(s.start, s.end) for s in engine.detect(n, absent, names)[0]]
        for a, b, kind, _ in find_candidates(n.unicode, known, engine.words, more):
            yield a, b, kind, n.unicode[a:b]

    return _found(df, column, rules or RuleSet(), words, "kind", lambda engine, texts: engine.prepared(texts, True), find)
