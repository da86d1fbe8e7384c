"""Two readings of a text, with the places each character came from: a compatible Unicode one, and an ASCII one in which
look-alikes of other scripts are spelled in Latin letters."""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass, field

_INVISIBLE = {*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF}
# Latin spellings of Greek and Cyrillic letters.
_GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a v g d e z i th i k l m n x o p r s s t y f ch ps o".split()))
_CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяіїєґ", "a b v g d e zh z i y k l m n o p r s t u f kh ts ch sh shch _ y _ e yu ya i i e g".replace("_", "'").split()))
_SPECIAL = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "þ": "th", "ð": "d", "ı": "i", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "...", "•": "*", "€": "EUR"}
_SYLLABLES = ("HIRAGANA LETTER ", "KATAKANA LETTER ", "HANGUL SYLLABLE ")
_TABLE = {**_GREEK, **_CYRILLIC, **_SPECIAL}


def is_invisible(c: str) -> bool:
    return (unicodedata.category(c) == "Cc" and c not in "\n\r\t") or ord(c) in _INVISIBLE


def to_ascii(c: str) -> str:
    """Latin letters for a character; nothing where the table has none."""
    if c < "\x80":
        return c
    low = c.lower()
    if low in _TABLE:
        out = _TABLE[low]
        return out[:1].upper() + out[1:] if c != low else out
    name = unicodedata.name(c, "")
    for script in _SYLLABLES:  # their names are their sounds
        if name.startswith(script):
            return name[len(script) :].removeprefix("SMALL ").lower()
    base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    if base and base != c:
        return "".join(to_ascii(x) for x in base)
    return ""


@dataclass
class Normalized:
    """unicode/ascii: the readings; from_*: the original index of each of their characters, then the length;
    to_*: where each original character starts in them, then their lengths."""

    unicode: str
    ascii: str
    from_unicode: list[int] = field(repr=False, default_factory=list)
    from_ascii: list[int] = field(repr=False, default_factory=list)
    to_unicode: list[int] = field(repr=False, default_factory=list)
    to_ascii: list[int] = field(repr=False, default_factory=list)

    @functools.cached_property
    def stripped(self) -> str:
        """The letters and digits of the ASCII reading, in lower case."""
        return _STRIP.sub("", self.ascii).lower()


_STRIP = re.compile(r"[\W_]+")
_SPECIAL_CHARS = re.compile(r"[^\x20-\x7e\n\r\t]+")


class _Readings(dict):
    """What a special character reads as, found out once: (Unicode, ASCII)."""

    def __missing__(self, c: str) -> tuple[str, str]:
        x = "" if is_invisible(c) else unicodedata.normalize("NFKC", c)
        y = "".join(z for z in (to_ascii(c) if c >= "\x80" else c) if not is_invisible(z))
        self[c] = x, y
        return x, y


_READINGS = _Readings()


#: Places of characters that read as themselves; lists are cut from it.
_SAME = list(range(1 << 16))


def _places(sizes: list[tuple[int, int]], n: int) -> tuple[list[int], list[int]]:
    """(from, to) for a reading of n characters in which those at some places, by (place, size), read as other than one."""
    import numpy as np

    if not sizes:
        same = _SAME[: n + 1] if n < len(_SAME) else list(range(n + 1))
        return same, same
    lengths = np.ones(n, dtype=np.int64)
    at, size = zip(*sizes)
    lengths[list(at)] = size
    ends = np.cumsum(lengths)
    return [*np.repeat(np.arange(n), lengths).tolist(), n], [0, *ends.tolist()]


#: Different special characters of a text that are replaced one after the other.
FEW = 40


def _few_special(text: str) -> Normalized | None:
    """The readings of a text with few different special characters, each replaced in the whole text at once; None where
    that would replace a character that another one reads as."""
    special = set().union(*_SPECIAL_CHARS.findall(text))
    if len(special) > FEW:
        return None
    n, out = len(text), []
    for which in (0, 1):
        reads = {c: _READINGS[c][which] for c in special}
        changed = {c: x for c, x in reads.items() if x != c}
        if any(d in changed for x in changed.values() for d in x):
            return None
        reading, sizes = text, []
        for c, x in changed.items():
            if len(x) != 1:
                at = text.find(c)
                while at >= 0:
                    sizes.append((at, len(x)))
                    at = text.find(c, at + 1)
            reading = reading.replace(c, x)
        out.append((reading, *_places(sizes, n)))
    (unicode, from_u, to_u), (ascii_, from_a, to_a) = out
    return Normalized(unicode, ascii_, from_u, from_a, to_u, to_a)


def normalize(text: str) -> Normalized:
    return _few_special(text) or _each_special(text)


def _each_special(text: str) -> Normalized:
    u: list[str] = []
    a: list[str] = []
    of_u: list[tuple[int, int]] = []
    of_a: list[tuple[int, int]] = []
    at, known = 0, _READINGS
    for m in _SPECIAL_CHARS.finditer(text):
        i = m.start()
        if i > at:  # a run of plain characters reads as itself
            run = text[at:i]
            u.append(run)
            a.append(run)
        for i, c in enumerate(m[0], i):  # noqa: B020
            x, y = known[c]
            u.append(x)
            a.append(y)
            if len(x) != 1:
                of_u.append((i, len(x)))
            if len(y) != 1:
                of_a.append((i, len(y)))
        at = m.end()
    n = len(text)
    u.append(text[at:])
    a.append(text[at:])
    ascii_ = "".join(a)
    from_u, to_u = _places(of_u, n)
    from_a, to_a = _places(of_a, n)
    return Normalized("".join(u), ascii_, from_u, from_a, to_u, to_a)
