"""Which rows can hold a match of which pattern at all, looked up for whole Arrow columns in linear time.

Each pattern is widened to one that the columnar matcher knows and that matches wherever the pattern does: word
boundaries go, classes take all scripts in.  Only rows that the wide form matches go to the exact one.
"""

from __future__ import annotations

_SPACE = r" \t-\r\x1c-\x1f\x{85}\p{Z}"
_CLASSES = {"d": r"\p{Nd}", "s": _SPACE, "w": r"\p{L}\p{N}\p{M}_"}
#: Letters that fold to i in one matcher and not in the other.
_DOTTED = r"\x{130}\x{131}"


def widened(pattern: str) -> str | None:
    """A pattern of the columnar matcher that matches wherever ``pattern`` does; None where there is no such form."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            d = pattern[i + 1 : i + 2]
            if d == "u":
                out.append(rf"\x{{{pattern[i + 2 : i + 6]}}}")
                i += 6
                continue
            if d in _CLASSES:
                out.append(_CLASSES[d] if inside else f"[{_CLASSES[d]}]")
            elif d == "b" and not inside:
                pass
            elif d.isalnum() and d not in "nrtxAfv":
                return None
            else:
                out.append(c + d)
            i += 2
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            if pattern[i + 1 : i + 2] == "^":
                return None
        elif c == "(" and pattern[i + 1 : i + 2] == "?" and pattern[i + 2 : i + 3] not in (":", "i"):
            return None
        out.append(c)
        i += 1
    return f"(?:{''.join(out)})|[{_DOTTED}]"


#: Patterns that are looked for in one scan; more of them make an automaton that no longer fits its cache.
GROUP = 8


class Prefilter:
    def __init__(self, patterns: dict[str, str]):
        self.wide = {}
        for name, pattern in patterns.items():
            # the matcher may not know the pattern: its rows are all looked at
            if (wide := widened(pattern)) is not None and self._known(wide):
                self.wide[name] = wide
        names = list(self.wide)
        parts = [names[k : k + GROUP] for k in range(0, len(names), GROUP)]
        joined = [("|".join(dict.fromkeys(self.wide[n] for n in part)), part) for part in parts]
        self.groups = [x for any_, part in joined for x in ([(any_, part)] if self._known(any_) else [(self.wide[n], [n]) for n in part])]

    @staticmethod
    def _known(pattern: str) -> bool:
        import pyarrow as pa
        import pyarrow.compute as pc

        try:
            pc.match_substring_regex(pa.array([""]), pattern)
        except pa.ArrowInvalid:
            return False
        return True

    def absent(self, texts: list[str]) -> list[set[str]]:
        """For each text the patterns that it cannot hold: a group's patterns are looked for one by one only in texts that
        hold any of them."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        column = pa.array(texts, pa.large_string())
        out: list[set[str]] = [set(self.wide) for _ in texts]
        for any_, names in self.groups:
            held = np.flatnonzero(pc.match_substring_regex(column, any_).to_numpy(zero_copy_only=False))
            if not len(held):
                continue
            rows = column.take(pa.array(held)) if len(names) > 1 else None
            for name in names:
                hit = held if rows is None else held[pc.match_substring_regex(rows, self.wide[name]).to_numpy(zero_copy_only=False)]
                for i in hit.tolist():
                    out[i].discard(name)
        return out
