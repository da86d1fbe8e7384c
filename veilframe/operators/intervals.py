"""Spans indexed by where they lie, so that looking for an overlap does not look at all of them."""

from __future__ import annotations

from bisect import bisect_right, insort

#: Characters of one cell (a power of two).
CELL = 6


class Intervals:
    """Numbered spans in cells of 64 characters.  Two spans overlap when each starts before the other ends."""

    __slots__ = ("cells", "spans")

    def __init__(self, spans=()):
        self.cells: dict[int, list[int]] = {}
        self.spans: list[tuple[int, int]] = []
        for a, b in spans:
            self.add(a, b)

    def add(self, start: int, end: int) -> None:
        k = len(self.spans)
        self.spans.append((start, end))
        for c in range(start >> CELL, (max(start, end - 1) >> CELL) + 1):
            self.cells.setdefault(c, []).append(k)

    def widen(self, k: int, start: int, end: int) -> None:
        a, b = self.spans[k]
        self.spans[k] = min(a, start), max(b, end)
        old = range(a >> CELL, (max(a, b - 1) >> CELL) + 1)
        for c in range(min(a, start) >> CELL, (max(a, b - 1, end - 1) >> CELL) + 1):
            if c not in old:
                insort(self.cells.setdefault(c, []), k)

    def first(self, start: int, end: int) -> int | None:
        """The number of the first added span that overlaps this one."""
        best = None
        for c in range(start >> CELL, (max(start, end - 1) >> CELL) + 1):
            for k in self.cells.get(c, ()):
                if best is not None and k >= best:
                    break
                a, b = self.spans[k]
                if start < b and end > a:
                    best = k
                    break
        return best


class Cover:
    """The union of spans: is a place inside?"""

    __slots__ = ("ends", "starts")

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if b <= a:
                continue
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def holds(self, at: int) -> bool:
        k = bisect_right(self.starts, at) - 1
        return k >= 0 and at < self.ends[k]
