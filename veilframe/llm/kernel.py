"""Words of Arrow string columns as 64-bit hashes, a few array operations for a whole chunk of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are looked at together; one longer text is a chunk of its own.
CHUNK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The hash that stands for the end of a text.
END = np.uint64(0x5851F42D4C957F2D)


def table_for(lower: bool) -> np.ndarray:
    """The random value of each byte; with lower, A-Z have those of a-z."""
    out = _TABLE.copy()
    if lower:
        out[65:91] = out[97:123]
    return out


_TABLES = {False: table_for(False), True: table_for(True)}


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads each bit over the whole number."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _pow(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _STEP, dtype=np.uint64)]), dtype=np.uint64)
    return _powers[:n]


def chunks(column, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets of the rows in them) of a string column; nulls are empty texts."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        to = min(to, n)
        yield at, to - at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths (bytes) of the words, which end with their text."""
    inside = ~_SPACE[buf]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(buf)]
    before[firsts] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return starts, starts
    # words of adjacent texts may touch: a word ends at white space, or where the next one starts
    stops = np.append(starts[1:], len(buf))
    gaps = np.add.reduceat(~inside, starts)
    return starts, stops - starts - gaps


def word_hashes(buf: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, words of each text, starts of the words)."""
    starts, lengths = word_bounds(buf, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64), starts
    ends = np.cumsum(lengths)
    firsts = ends - lengths
    place = np.arange(ends[-1]) - np.repeat(firsts, lengths)
    values = _TABLES[lower][buf[place + np.repeat(starts, lengths)]] * _pow(int(lengths.max()))[place]
    hashes = mix(np.add.reduceat(values, firsts) + lengths.astype(np.uint64))
    counts = np.diff(np.searchsorted(starts, offsets))
    return hashes, counts, starts


def rows_of(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def windows(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of width words inside each text, and their number in each text."""
    n = np.maximum(counts - (width - 1), 0)
    if not n.sum():
        return np.zeros(0, np.uint64), n
    total = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + len(total)]
    row = rows_of(counts)
    same = row[: len(total)] == row[width - 1 :]
    return mix(total[same]), n
