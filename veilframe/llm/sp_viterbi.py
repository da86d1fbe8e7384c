"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search walks a text position by position.  A piece may end at a position if it stands in the vocabulary and the
model would keep it beside the piece that the best path to its start ends with; for byte-pair models exactly one piece
passes at each position, so the path found is the model's own segmentation (two neighbours that the model's merges keep
apart when encoded together are kept apart in any context).  Only the last ``window`` positions (the longest piece) can
still be the start of a piece; whenever the paths from all of them share a boundary, the ids before it are committed
and forgotten.  Memory is bounded by the window, not by the text.

Some boundaries are shared by all paths whatever the text: before a space mark, beside a line feed, between a word
character and another one, so far as the vocabulary has no piece across them.  At such a boundary all surviving paths
have converged, so the search commits there without waiting for its window to fill; in stretches without one (long runs
of letters, or of other characters) it commits when the paths of the window do.  What stands between two committed
boundaries always gives the same ids, so these are remembered (a bounded memory for each worker) and the search only
runs on stretches not seen before.

Defined cases: null and empty texts have no ids; characters outside the vocabulary become their UTF-8 bytes; the mark
U+2581 in a text reads as a space when decoded (``decoded_ok`` is false there); repeated rows give a row each; an
empty table gives no rows; a very long text is searched in its window like any other; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.util import ship, table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
NEVER = float("-inf")
#: Parts remembered by a worker before it starts afresh.
REMEMBERED = 700_000


class Model:
    """Pieces and scores of a model file, with the model's own merging for pairs of pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes_: dict[int, int] = {}
        self.raw: list[bytes] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.bytes_[value] = i
                self.raw.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.raw.append(b"")
            else:
                self.ids[piece] = i
                self.score[piece] = sp.get_score(i)
                self.raw.append(piece.replace(MARK, " ").encode("utf-8"))
        self.window = max(map(len, self.ids))
        self.feed = any("\n" in p and len(p) > 1 for p in self.ids)
        #: Every beginning of a piece, and whether it is one; a single character always is.
        self.starts = {p[:k]: False for p in self.ids for k in range(1, len(p))}
        self.starts |= dict.fromkeys((p for p in self.starts if len(p) == 1), True) | dict.fromkeys(self.ids, True)
        self.known = _Apart(self).__getitem__

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging: the best-scored neighbours first, the leftmost among equals."""
        parts, score = list(text), self.score.get
        pairs = [score(text[k : k + 2], NEVER) for k in range(len(parts) - 1)]
        while pairs and (best := max(pairs)) > NEVER:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], NEVER)
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], NEVER)
        return parts

    def apart(self, left: str, right: str) -> bool:
        """Does the model keep these two as they are when they are neighbours?"""
        return self.merge(left + right) == [left, right]

    def id_list(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.bytes_[b] for b in piece.encode("utf-8", "replace")]


class _Apart(dict):
    """Model.apart(), remembered."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, pair: tuple[str, str]) -> bool:
        if len(self) > 1_000_000:
            self.clear()
        out = self[pair] = self.model.apart(*pair)
        return out


class StreamingViterbi:
    """Feeds characters in, gives committed ids out."""

    def __init__(self, model: Model):
        self.model, self.window = model, model.window
        self.commits = 0
        self._start("")

    def _start(self, before: str) -> None:
        self.before = before  # the piece that ends at the last committed boundary
        self.tail = ""  # the characters from there on
        self.last: list[str | None] = [before]  # the piece that the path to each position of the tail ends with
        self.grown = 0  # positions of the tail from which all pieces have been tried

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        for at in range(0, len(text), 64):
            more = text[at : at + 64]
            self.tail += more
            self.last += [None] * len(more)
            if len(self.tail) >= self.window:
                self._grow(len(self.tail) - self.window + 1)
                if self.grown > 3 * self.window:
                    out += self._commit()
        return out

    def _grow(self, upto: int) -> None:
        """Tries all pieces from the positions before upto, which have a whole window of characters after them."""
        tail, last, starts, known, n = self.tail, self.last, self.model.starts.get, self.model.known, len(self.tail)
        for start in range(self.grown, upto):
            left, end = last[start], start
            while end < n:
                end += 1
                piece = tail[start:end]
                whole = starts(piece)
                if whole is None:
                    if end == start + 1:
                        last[end] = piece  # a character that no piece has
                    break
                if whole and (not left or known((left, piece))):
                    last[end] = piece
        self.grown = max(self.grown, upto)

    def _path(self, at: int) -> list[int]:
        pieces = []
        while at > 0:
            pieces.append(self.last[at])
            at -= len(pieces[-1])
        return [i for p in reversed(pieces) for i in self.model.id_list(p)]

    def _commit(self) -> list[int]:
        """Ids up to the last boundary that the paths from all live positions share."""
        shared: set[int] | None = None
        for at in range(self.grown, min(self.grown + self.window, len(self.tail)) + 1):
            if self.last[at] is not None:
                ends, p = set(), at
                while p > 0:
                    ends.add(p)
                    p -= len(self.last[p])
                shared = ends if shared is None else shared & ends
        upto = max((p for p in shared or () if p <= self.grown), default=0)
        if not upto:
            return []
        out = self._path(upto)
        self.commits += 1
        tail, last, grown = self.tail, self.last, self.grown
        self._start(last[upto])
        self.tail, self.last, self.grown = tail[upto:], last[upto:], grown - upto
        return out

    def close(self) -> list[int]:
        """At a boundary that no piece crosses, or the end: its position is the only one alive, so all paths converge there."""
        self._grow(len(self.tail))
        out = self._commit()
        self._start("")
        return out


class Codec:
    def __init__(self, path: str):
        self.model = Model(path)
        self.parts: dict[str, bytes] = _Remembered(self.model)
        feed = "" if self.model.feed else "\n"
        self.coarse = re.compile(f"{MARK}*[^{MARK}{feed}]+|{MARK}+|\n").findall
        # Where no piece joins a word character and another one, their border is a boundary of every path too.
        self.fine = re.compile(f"{MARK}*\\w+|{MARK}*[^\\w{MARK}{feed}]+|{MARK}+|\n").findall
        odd = [p for p in self.model.ids if re.search(f"\\w[^\\w{MARK}]|[^\\w{MARK}]\\w", p)]
        #: Characters of which every piece across such a border has one; texts with them are cut coarsely.
        self.across: list[str] = []
        overall = Counter(c for p in self.model.ids for c in set(p))
        while odd:
            counts = Counter(c for p in odd for c in set(p))
            most = max(counts, key=lambda c: (counts[c], -overall[c]))
            self.across.append(most)
            odd = [p for p in odd if most not in p]

    def encode_bytes(self, text: str) -> bytes:
        """The ids as 32-bit numbers."""
        if not text:
            return b""
        cut = self.coarse if any(c in text for c in self.across) else self.fine
        return b"".join(map(self.parts.__getitem__, cut(MARK + text.replace(" ", MARK))))

    def decode_ids(self, ids) -> str:
        raw = b"".join(map(self.model.raw.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


class _Remembered(dict):
    def __init__(self, model: Model):
        self.search = StreamingViterbi(model)

    def __missing__(self, part: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        out = array("i", self.search.feed(part) + self.search.close()).tobytes()
        if len(part) <= 64:
            self[part] = out
        return out


_codecs: dict[str, Codec] = {}


def codec(path: str | None = None) -> Codec:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _encode(batches: Iterator, path: str | None) -> Iterator:
    import numpy as np
    import pyarrow as pa

    c = codec(path)
    names = ["doc_id", "ids", "n_ids", "ids_crc32", "decoded_sha256", "decoded_ok"]
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            coded, sha, ok = [], [], []
            for text in batch.column("text").to_pylist():
                b = c.encode_bytes(text or "")
                back = c.decode_ids(np.frombuffer(b, "<i4").tolist())
                coded.append(b)
                sha.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                ok.append(back == (text or ""))
            offsets = np.cumsum([0, *(len(b) // 4 for b in coded)]).astype("<i4")
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            cols = [batch.column("doc_id"), ids, pa.array(np.diff(offsets).astype("<i8")), pa.array([zlib.crc32(b) for b in coded], pa.int64()), pa.array(sha, pa.string()), pa.array(ok, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=names)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, ids, n_ids, ids_crc32 and, decoded again, decoded_sha256 and decoded_ok."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: _encode(it, path), "doc_id long, ids array<int>, n_ids long, ids_crc32 long, decoded_sha256 string, decoded_ok boolean")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """coded with ``text``, decoded from ``ids`` (null ids: null)."""
    ship(coded.sparkSession)

    @F.pandas_udf("string")
    def run(ids):
        c = codec(path)
        return ids.map(lambda x: None if x is None else c.decode_ids(x.tolist()))

    return coded.withColumn("text", run("ids"))


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
