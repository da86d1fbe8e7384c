"""What a model is asked about spans that may be names, and which of them its answers confirm.

Candidates of a text share questions: the sentences around them, merged where they touch.  A text of at most 512 bytes is
one question.  A candidate that stands where names stand (after "by", "dr", ... or beside a name in a list) is also asked
about by itself, as the name of a John and of a doctor.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

from veilframe.operators.intervals import Intervals
from veilframe.operators.names import at_sentence_start, valid
from veilframe.sources.words import Words

#: Bytes of a text that is asked about whole, and the scores that are enough whatever the rules' threshold.
WHOLE, ENOUGH, ENOUGH_CASED = 512, 0.70, 0.65
#: What may stand between names of a list; words before a name; words before an organisation that acts, and
#: what may follow them.
LISTED = (", ", ", and ", " and ", " & ")
BEFORE = ("by", "from", "for", "to", "user", "attendees", "assigned", "lead", "patient", "per", "dr", "mr", "mrs", "ms", "ask", "ping", "contact", "email", "dm", "cc", "attn")
AGENTS, OPENINGS = ("by", "from", "for"), "<[( :"
#: Titles whose first letter is raised with the name after them.
TITLES = ("dr. ", "mr. ", "ms. ", "mrs. ")
#: Characters between a candidate and the word before it, beside white space.
BETWEEN = "<[(:\"'*`.,>])"
_ENDS = re.compile(r"[.!?\n]")
_PARTS_OF_NAME = re.compile(r"[^ \-']+")
_BRACKETS = tuple(zip("[<]>_", "(()) "))

#: start, end, kind, whether its letters are to be raised first.
Candidate = tuple[int, int, str, bool]


def _raised(c: str) -> str:
    up = c.upper()[:1]
    return up if len(up.encode()) == len(c.encode()) else c


def sentence_windows(text: str, candidates: list[Candidate]) -> list[tuple[int, int]]:
    """Windows apart from each other, from left to right; candidates come by start."""
    if not candidates:
        return []
    if len(text.encode("utf-8", "replace")) <= WHOLE:
        return [(0, len(text))]
    ends = [m.end() for m in _ENDS.finditer(text)]
    out: list[tuple[int, int]] = []
    for start, end, *_ in candidates:
        k = bisect_left(ends, start + 1)
        a = ends[k - 1] if k else 0
        k = bisect_left(ends, end + 1)
        b = ends[k] if k < len(ends) else len(text)
        if out and a <= out[-1][1]:
            out[-1] = min(a, out[-1][0]), max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def asked(text: str, start: int, end: int, candidates: list[Candidate]) -> str:
    """The window as it is shown to a model: round brackets, spaces for underscores, and raised letters where a candidate
    has none.  Its characters keep their places."""
    plain = text[start:end]
    for c, d in _BRACKETS:
        plain = plain.replace(c, d)
    raised = [(a, b) for a, b, _, cased in candidates if cased and start <= a and b <= end]
    if not raised:
        return plain
    shown = list(plain)
    for a, b in raised:
        title = next((t for t in TITLES if a - len(t) >= start and text.startswith(t, a - len(t))), None)
        if title:
            at = a - len(title) - start
            shown[at] = shown[at].upper()
        for m in _PARTS_OF_NAME.finditer(text, a, b):
            shown[m.start() - start] = _raised(text[m.start()])
    return "".join(shown)


def _word_before(text: str, at: int) -> str:
    while at and (text[at - 1].isspace() or text[at - 1] in BETWEEN):
        at -= 1
    end = at
    while at and not (text[at - 1].isspace() or text[at - 1] in BETWEEN):
        at -= 1
    return text[at:end].lower()


def _agent_before(text: str, at: int) -> bool:
    while at and text[at - 1] in OPENINGS:
        at -= 1
    return text.endswith(AGENTS, 0, at)


def _introduced(text: str, c: Candidate) -> bool:
    return c[3] or _word_before(text, c[0]) in BEFORE


def _beside(text: str, start: int, end: int) -> Iterator[tuple[bool, int]]:
    """Places where another name of a list would end (True) or start (False)."""
    for j in LISTED:
        if text.endswith(j, 0, start):
            yield True, start - len(j)
        if text.startswith(j, end):
            yield False, end + len(j)


def probes(name: str) -> tuple[str, str]:
    name = name[:1].upper() + name[1:]
    return f"John {name}", f"Doctor {name}"


def questions(text: str, candidates: list[Candidate], words: Words) -> Iterator[tuple[str, int, str]]:
    """(kind, place, what is asked): windows by their starts, and two probes for each candidate that may need them."""
    apart = sentence_windows(text, candidates)
    k = 0
    for a, b in apart:
        inside = []
        while k < len(candidates) and candidates[k][0] < b:
            inside.append(candidates[k])
            k += 1
        yield "window", a, asked(text, a, b, inside)
    for c in candidates:
        if (_introduced(text, c) or any(_beside(text, c[0], c[1]))) and valid(text, c[0], c[1], words):
            for p in probes(text[c[0] : c[1]]):
                yield "probe", c[0], p


def confirmed_by(text: str, candidates: list[Candidate], confirmed: list[tuple[int, int]], said: list, threshold: float, words: Words) -> Iterator[tuple[int, int, str]]:
    """(start, end, rule) of what answers confirm.

    said: (kind, place, entities) of answered questions; an entity is (s, e, label, score) with places in what was asked.
    A probe confirms by any entity of a person or an organisation.
    """
    at = Intervals(confirmed)
    maybe = Intervals((c[0], c[1]) for c in candidates)
    starts, ends = {a for a, _ in confirmed}, {b for _, b in confirmed}

    def add(start: int, end: int) -> None:
        at.add(start, end)
        starts.add(start)
        ends.add(end)

    for place, entities in sorted((p, es) for kind, p, es in said if kind == "window"):
        for s, e, label, score in entities:
            start, end = place + s, place + e
            k = maybe.first(start, end) if 0 <= start < end <= len(text) else None
            if k is None:
                continue
            a, b, _, cased = candidates[k]
            if score < min(threshold, ENOUGH_CASED if cased else ENOUGH) or not label.endswith(("PER", "ORG")):
                continue
            if not (valid(text, a, b, words) and valid(text, start, end, words)):
                continue
            if label.endswith("ORG") and not (cased or at_sentence_start(text, a) or _agent_before(text, a)):
                continue
            start, end = min(start, a), max(end, b)
            if at.first(start, end) is None:
                add(start, end)
                yield start, end, f"ai_hybrid_{label}"
    sure = {p for kind, p, es in said if kind == "probe" and any(x[3] >= min(threshold, ENOUGH) and x[2].endswith(("PER", "ORG")) for x in es)}
    for c in candidates:
        a, b = c[:2]
        if a in sure and at.first(a, b) is None and valid(text, a, b, words):
            if _introduced(text, c) or any(p in (ends if before else starts) for before, p in _beside(text, a, b)):
                add(a, b)
                yield a, b, "ai_hybrid_roster_B-PER"
