"""Name heuristics: certain ones (find_names) and candidates that only a model could settle (find_candidates)."""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from veilframe.operators.intervals import Intervals
from veilframe.sources.rules import Rule
from veilframe.sources.words import Words

# Letter classes and affixes of the name patterns.
CAP = "A-ZΆΈ-ΊΌΎ-ΡΣ-Ω"
GREEK_CAP = "ΆΈ-ΊΌΎ-ΡΣ-ΩΪΫ"
LOW = "α-ωά-ώa-z"
GREEK = "Ά-ώ"
PARTICLES = "da|de|del|della|der|den|di|du|ter|ten|van|von|ibn|bin|al|el|la|le|des"
LATIN_SUFFIXES = "poulos|poulou|poulo|idis|idi|iadis|iadi|akis|aki|oglou|akos|akou|ako|atos|atou|ato|eas|ea|ianni|yianni"
GREEK_SUFFIXES = "πουλος|πουλου|πουλο|ίδης|ίδη|ιάδης|ιάδη|άκης|άκη|όγλου|ογλου|όπουλος|όπουλου|όπουλο|άκος|άκου|άκο|άτος|άτου|άτο|έας|έα|ιδης|ιδη|ιαδης|ιαδη|ακης|ακη|οπουλος|οπουλου|οπουλο|ακος|ακου|ακο|ατος|ατου|ατο|εας|εα"
HONORIFICS = "Mr|Mrs|Ms|Miss|Dr|Prof|Rev|Hon"
ROLE_PREFIXES = "Patient|Per|Attn|Client|Customer"

FULL = re.compile(rf"\b[{CAP}][{LOW}]+(?:[\s\-']+(?:(?:(?i:{PARTICLES})|[{CAP}]\.)[\s\-']+)*[{CAP}][{LOW}]+)+\b")
INITIALS = re.compile(rf"\b(?:[A-Za-z{GREEK}]\.[\s\-']*){{1,3}}([A-Za-z{GREEK}][{LOW}]{{2,}})\b")
TITLED = re.compile(rf"\b(?:{HONORIFICS})\.?[\s\-']+([{CAP}][{LOW}]{{2,}})\b")
GREEK_PAIR = re.compile(rf"(?i)\b[a-z{GREEK}]{{3,}}\s+[a-z{GREEK}]{{3,}}(?:{LATIN_SUFFIXES}|omou|ou|{GREEK_SUFFIXES}|ης|ου|ος|ας|α|ων|η)\b")
PATRONYMIC = re.compile(rf"(?i)\b(?:[a-z]{{3,}}(?:{LATIN_SUFFIXES})|[{GREEK}]{{3,}}(?:{GREEK_SUFFIXES}))\b")
ARABIC = re.compile("(?i)\\b(?:al-|el-|ibn\\s+|bin\\s+)[a-zء-ي]{3,}\\b")
GREEK_CHAIN = re.compile(rf"\b[{GREEK_CAP}][{GREEK}]+(?:[\s\-']+[{GREEK_CAP}][{GREEK}]+)+\b")
ANCHOR = re.compile(rf"\b(?:{ROLE_PREFIXES})[\s\-']+([{CAP}][{LOW}]{{2,}})\b")
CAPITALISED = re.compile(rf"\b[{CAP}][{LOW}]{{2,}}\b")
INFLECTED = re.compile(rf"(?i)\b[{GREEK}]{{3,}}(?:ης|ου|ος|ας|ων|η)\b")
# What introduces a name, and up to three words of any case after it.
_SAID = rf"(['\"]?[a-z{GREEK}]{{2,}}(?:[\s\-']+[a-z{GREEK}]{{2,}}){{0,2}}['\"]?)\b"
_INTRO = (
    r"(?i)(?:\b(?:who\s+(?:is|was|are|were)|who's|tell\s+me\s+about|my\s+name\s+is|i\s+am|i'm|contact|(?:my\s+)?(?:friend|colleague|coworker|partner|brother|sister|wife|husband|boss|manager)"
    r"|(?:email|send|forward)\s+(?:directly\s+)?to|email|ping|dm|ask|cc|attn[:.]?|per|patient|client|mr\.?|mrs\.?|ms\.?|dr\.?|directly\s+to)\s+|@)" + _SAID
)
INTRO = re.compile(_INTRO)
# The introduction with a thing that is sent: "send the <words> to <name>", the last such "to" of the words.
SENDING = re.compile(r"(?i)\b(?:email|send|forward)\s+the(?=\s)")
_RUN = re.compile(r"[\w\s]+")
_TO = re.compile(rf"(?i)(?<=\s)(?=(?:directly\s+)?to\s+{_SAID})")
# Words that end a name after an introduction, at the second and at the third word, and particles that do not.
AFTER_ONE = frozenset("delay delayed complained reported approved rejected urgently immediately called sent said tells asks asked".split())
AFTER_TWO = frozenset("yesterday today tomorrow now urgently immediately delay delayed complained reported".split())
NOBILIARY = frozenset("van von de da del della der den di du al el ibn bin la".split())
_PARTS = re.compile(r"[\s\-']+")
NOT_NAMES = ("My name", "The client")


#: Letters that fold to others, and what is no letter inside the Greek range: texts with them are searched by the patterns.
_ODD = re.compile("[ſKıİµ\u0345\u0387\u038b\u038d\u03a2ϐϑϕϖϰϱϵ\u1fbe]")
_FIRST_OF_PAIR = re.compile(rf"(?i)[a-z{GREEK}]{{3,}}")
_PAIR_SUFFIXES = f"{LATIN_SUFFIXES}|omou|ou|{GREEK_SUFFIXES}|ης|ου|ος|ας|α|ων|η"
_SECOND_OF_PAIR = re.compile(rf"(?i)[a-z{GREEK}]{{3,}}(?:{_PAIR_SUFFIXES})")
#: Letters of a word that is remembered.
LONGEST_WORD = 64
_tails: list = []


def _tail_tables():
    """(number of each character, 0 for none, pairs of numbers that end a suffix, characters that go on a word)."""
    if not _tails:
        import numpy as np

        number, inner = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=bool)
        ids: dict[str, int] = {}
        suffixes = set(_PAIR_SUFFIXES.lower().replace("ς", "σ").split("|"))
        for s in suffixes:
            for c in s[-2:]:
                ids.setdefault(c, len(ids) + 1)
        for c, k in ids.items():
            for x in {c, c.upper(), *("ς" if c == "σ" else "")}:
                number[ord(x)] = k
        ends = np.zeros((64, 64), dtype=bool)
        for s in suffixes:
            ends[ids[s[-2]] if len(s) > 1 else slice(None), ids[s[-1]]] = True
        for i in range(1023):  # the last one stands for all characters beyond
            inner[i] = _word(chr(i))
        _tails.extend((number, ends.ravel(), inner))
    return _tails


@functools.lru_cache(maxsize=1 << 16)
def _inflected(word: str) -> tuple[bool, bool]:
    """Whether a whole word is a PATRONYMIC, and the second of a GREEK_PAIR."""
    return PATRONYMIC.fullmatch(word) is not None, _SECOND_OF_PAIR.fullmatch(word) is not None


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def inflected_names(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Where GREEK_PAIR and PATRONYMIC stand in a text, as ``finditer`` finds them.

    Both end with a whole word that has one of a few endings, so only words whose last two letters end one of these are
    looked at, and these are found for the whole text at once.
    """
    if not text.isascii() and _ODD.search(text):
        return [m.span() for m in GREEK_PAIR.finditer(text)], [m.span() for m in PATRONYMIC.finditer(text)]
    import numpy as np

    number, ends, inner = _tail_tables()
    codes = np.frombuffer(text.encode(), dtype=np.uint8) if text.isascii() else np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), 1023)
    ids = number[codes]
    closing = ends[ids[:-1] * 64 + ids[1:]]
    inside = inner[codes]
    closing[:-1] &= ~inside[2:]
    ends_at = np.flatnonzero(closing) + 2
    begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    whole = text.isascii() or not (codes == 1023).any()  # every character is in the table
    starts_at = begins[np.searchsorted(begins, ends_at - 1, side="right") - 1] if whole else ends_at - 2
    pairs, single, at = [], [], 0
    for s, e in zip(starts_at.tolist(), ends_at.tolist()):
        if not whole:
            if e < len(text) and _word(text[e]):
                continue
            while s and _word(text[s - 1]):
                s -= 1
        alone, second = _inflected(text[s:e]) if e - s <= LONGEST_WORD else (PATRONYMIC.fullmatch(text, s, e), _SECOND_OF_PAIR.fullmatch(text, s, e))
        if alone:
            single.append((s, e))
        if not second:
            continue
        gap = s
        while gap and text[gap - 1].isspace():
            gap -= 1
        if gap == s or gap < 3 or s - 1 < at:
            continue
        first = gap
        while first and _word(text[first - 1]):
            first -= 1
        if first >= at and _FIRST_OF_PAIR.fullmatch(text, first, gap):
            pairs.append((first, e))
            at = e
    return pairs, single


@dataclass
class Found:
    start: int
    end: int
    label: str
    action: str
    category: str
    ascii: bool


def valid(text: str, start: int, end: int, words: Words) -> bool:
    """May this span be a name?  Places, acronyms, commands, roles and stop words are not."""
    if start >= end or end > len(text):
        return False
    span = text[start:end]
    parts = [p for p in _PARTS.split(span) if p]
    if not parts or parts[0] in words.imperatives:
        return False
    for p in parts:
        bare = p.strip(".")
        if len(bare) >= 2 and bare.isascii() and bare.isalpha() and bare.isupper():
            return False
    if len(parts) >= 2 and parts[0] in ROLE_PREFIXES.split("|"):
        parts = parts[1:]
    if any(p in words.roles or p in words.tech or p.lower() in words.stopwords for p in parts):
        return False
    shift = max(0, start - 40)
    if not _any_in(text, words.geographic):
        return True
    near = text[shift : end + 40]
    for geo in words.geographic:
        at = near.find(geo)
        while at >= 0:
            if start < shift + at + len(geo) and end > shift + at:
                return False
            at = near.find(geo, at + len(geo))
    return True


@functools.lru_cache(maxsize=4)
def _any_in(text: str, known: tuple) -> bool:
    """Asked again and again about one text."""
    return any(x in text for x in known)


def at_sentence_start(text: str, at: int) -> bool:
    while at and text[at - 1].isspace():
        at -= 1
    return not at or text[at - 1] in ".!?"


def _without_opening(text: str, start: int, end: int, words: Words) -> int:
    """The start after leading greetings and sentence starters."""
    while True:
        m = re.search(r"[\s\-']", text[start:end])
        if not m or not (text[start : start + m.start()] in words.starters or text[start : start + m.start()] in words.greetings):
            return start
        rest = text[start + m.start() : end].lstrip()
        start = end - len(rest)


#: The patterns of certain names; a text that cannot hold one of them need not be searched for it.
PATTERNS = {"full": FULL, "initials": INITIALS, "titled": TITLED, "pair": GREEK_PAIR, "patronymic": PATRONYMIC, "arabic": ARABIC, "chain": GREEK_CHAIN}


def find_names(unicode: str, ascii_: str, heuristics: list[tuple[Rule, re.Pattern]], words: Words, absent: tuple = ((), ())) -> list[Found]:
    """Certain names, by start, the longer first.  absent: names of patterns (see PATTERNS, and ids of heuristics) that the
    Unicode and the ASCII reading do not hold."""
    out: list[Found] = []
    taken = Intervals()
    plain = {False: unicode.replace("_", " "), True: ascii_.replace("_", " ")}
    source = {False: unicode, True: ascii_}
    same = unicode == ascii_
    known: dict = {}

    def inflected(name: str, is_ascii: bool) -> list[tuple[int, int]]:
        if name in absent[is_ascii]:
            return []
        key = "inflected", is_ascii and not same
        if key not in known:
            known[key] = dict(zip(("pair", "patronymic"), inflected_names(plain[is_ascii])))
        return known[key][name]

    def hits(name: str, pattern: re.Pattern, is_ascii: bool) -> list[re.Match]:
        if name in absent[is_ascii]:
            return []
        key = name, is_ascii and not same
        if key not in known:
            known[key] = list(pattern.finditer(plain[is_ascii]))
        return known[key]

    def add(is_ascii: bool, start: int, end: int, label: str, alone: bool = False) -> None:
        if valid(source[is_ascii], start, end, words) and not (alone and taken.first(start, end) is not None):
            out.append(Found(start, end, label, "Redact", "IndividualName", is_ascii))
            taken.add(start, end)

    for rule, pattern in heuristics:
        for is_ascii in (False, True):
            for m in hits(f"{rule.id} {pattern.pattern}", pattern, is_ascii):
                if rule.kind == "S" and at_sentence_start(source[is_ascii], m.start()):
                    continue
                if valid(source[is_ascii], m.start(), m.end(), words):
                    out.append(Found(m.start(), m.end(), rule.id + "_homoglyph" * is_ascii, rule.action, rule.category, is_ascii))
                    taken.add(m.start(), m.end())
    for m in hits("full", FULL, True):
        start = _without_opening(plain[True], m.start(), m.end(), words)
        span = plain[True][start : m.end()]
        if span not in NOT_NAMES and len([p for p in _PARTS.split(span) if p]) > 1:
            add(True, start, m.end(), "POTENTIAL_GLOBAL_NAME")
    for m in hits("initials", INITIALS, True):
        s = m.start()
        if m[0].lower().startswith(("e.g.", "i.e.")) or "." in ascii_[max(0, s - 2) : s]:
            continue
        last = m[0].split()[-1] if m[0].split() else ""
        if last not in words.starters and last not in words.tech:
            add(True, s, m.end(), "POTENTIAL_INITIAL_NAME")
    for m in hits("titled", TITLED, True):
        add(True, m.start(), m.end(), "POTENTIAL_HONORIFIC_NAME")
    for name, label, alone in (("pair", "POTENTIAL_GREEK_NAME", False), ("patronymic", "POTENTIAL_GREEK_NAME", True), ("arabic", "POTENTIAL_ARABIC_NAME", True)):
        for is_ascii in (True, False):
            for start, end in [m.span() for m in hits(name, ARABIC, is_ascii)] if name == "arabic" else inflected(name, is_ascii):
                add(is_ascii, start, end, label, alone)
    for m in hits("chain", GREEK_CHAIN, False):
        start = _without_opening(plain[False], m.start(), m.end(), words)
        if len([p for p in _PARTS.split(plain[False][start : m.end()]) if p]) > 1:
            add(False, start, m.end(), "POTENTIAL_GREEK_NAME_CHAIN")
    return sorted(out, key=lambda f: (f.start, f.start - f.end))


def _never_a_name(word: str, words: Words) -> bool:
    return word.lower() in words.stopwords or word in words.roles or word in words.tech


def _is_action(word: str, known: frozenset, words: Words) -> bool:
    """A verb or adverb by its ending or from a list, unless it is a surname that looks like one."""
    low = word.lower()
    return (low.endswith(("ed", "ly", "ing")) or low in known) and low not in words.surnames


def _leading_name(parts: list[str], words: Words) -> int:
    """How many of one to three words after an introduction belong to a name."""
    if not 1 <= len(parts) <= 3 or _never_a_name(parts[0], words):
        return 0
    for k, known in ((1, AFTER_ONE), (2, AFTER_TWO)):
        if k == len(parts):
            return k
        particle = k == 1 and parts[k].lower() in NOBILIARY and parts[k] not in words.roles and parts[k] not in words.tech
        if (not particle and _never_a_name(parts[k], words)) or _is_action(parts[k], known, words):
            return k
    return len(parts)


def introductions(text: str) -> Iterator[tuple[int, int]]:
    """What stands after introductions, from left to right.

    The words between "send the" and its "to" are not searched anew for each "send": places where a "to" with a name
    begins, and runs of words, are found once, and each "send" looks up the last such place in its run.
    """
    heads = [(m.start(), m.end()) for m in SENDING.finditer(text)]
    goals: dict[int, tuple[int, int]] = {}
    if heads:
        goals = {m.start(): m.span(1) for m in _TO.finditer(text)}
    places = list(goals)
    runs = [m.span() for m in _RUN.finditer(text)] if places else []
    starts = [a for a, _ in runs]
    sent = []
    for a, b in heads if places else ():
        k = bisect_right(places, runs[bisect_right(starts, b) - 1][1]) - 1
        if k >= 0 and places[k] >= b + 3:  # a space, something, a space
            sent.append((a, goals[places[k]]))
    at, k = 0, 0
    while True:
        while k < len(sent) and sent[k][0] < at:
            k += 1
        m = INTRO.search(text, at)
        if k < len(sent) and (m is None or sent[k][0] <= m.start()):
            span = sent[k][1]
        elif m is None:
            return
        else:
            span = m.span(1)
        yield span
        at = span[1]


#: The patterns of candidates that few texts hold, without what looks ahead.
OF_CANDIDATES = {"anchor": ANCHOR, "intro": re.compile(_INTRO), "sending": re.compile(r"(?i)\b(?:email|send|forward)\s+the"), "inflected": INFLECTED}


def find_candidates(text: str, confirmed: list[tuple[int, int]], words: Words, absent: set | tuple = ()) -> list[tuple[int, int, str, bool]]:
    """Spans that may be names: (start, end, kind, needs casing), none of them over a confirmed span or each other.

    Four passes, the earlier ones first: words after a role, capitalised words that no sentence starts with, up to three
    words of any case after an introduction, and inflected Greek words.  absent: names of patterns (see OF_CANDIDATES) that
    the text does not hold.
    """
    taken = Intervals(confirmed)
    out: list[tuple[int, int, str, bool]] = []

    def add(start: int, end: int, kind: str, casing: bool = False) -> None:
        if taken.first(start, end) is None:
            taken.add(start, end)
            out.append((start, end, kind, casing))

    for m in ANCHOR.finditer(text) if "anchor" not in absent else ():
        if m[1] not in words.roles and m[1] not in words.tech:
            add(m.start(1), m.end(1), "anchor")
    for m in CAPITALISED.finditer(text.replace("_", " ")):
        if not (m[0] in words.tech or m[0] in words.roles or m[0] in words.starters):
            add(m.start(), m.end(), "capitalised")
    for start, end in introductions(text) if not {"intro", "sending"} <= set(absent) else ():
        start += text[start] in "'\""
        end -= end > start and text[end - 1] in "'\""
        parts = [p for p in re.split(r"[\s-]+", text[start:end]) if p]
        kept = _leading_name(parts, words)
        if kept:
            # what is dropped takes the separators before it along
            add(start, end if kept == len(parts) else start + len(" ".join(parts[:kept])), "intro", True)
    for m in INFLECTED.finditer(text) if "inflected" not in absent else ():
        if not _never_a_name(m[0], words):
            add(m.start(), m.end(), "inflected", m[0][0].islower())
    return sorted(out)
