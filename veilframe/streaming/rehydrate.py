"""Restoring placeholders in streams of chunks that may cut them anywhere."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilframe.ship import ship

DONE = "[DONE]"
_OUT = "stream_id string, seq long, text string"


class Trie:
    """Placeholders by their letters: the longest one that begins at a place is found in as many steps as it has letters,
    however many placeholders there are."""

    __slots__ = ("begins", "root")

    def __init__(self, tokens: dict[str, str]):
        self.root: dict = {}
        for token, value in tokens.items():
            node = self.root
            for c in token:
                node = node.setdefault(c, {})
            if token:
                node[""] = value
        self.begins = re.compile("[" + re.escape("".join(self.root)) + "]") if self.root else None

    def restore(self, text: str, last: bool) -> tuple[str, str]:
        """(text with values in place, what may be the beginning of a placeholder); with last, nothing is kept back.

        Leftmost placeholders first, of those the longest; values are not looked at again.
        """
        if self.begins is None:
            return text, ""
        out, at, look, size = [], 0, 0, len(text)
        while m := self.begins.search(text, look):
            start = place = m.start()
            node, best = self.root, None
            while place < size and (below := node.get(text[place])) is not None:
                node, place = below, place + 1
                if "" in node:
                    best = place, node[""]
            if place == size and not last and len(node) > ("" in node):
                return "".join([*out, text[at:start]]), text[start:]
            if best:
                out += [text[at:start], best[1]]
                at = look = best[0]
            else:
                look = start + 1
        return "".join([*out, text[at:]]), ""


class Rehydrator:
    """Holds back what may be the beginning of a placeholder; gives the rest with values in place, in one pass."""

    def __init__(self, tokens: dict[str, str] | Trie, held: str = ""):
        self.trie, self.held = tokens if isinstance(tokens, Trie) else Trie(tokens), held

    def feed(self, chunk: str) -> str:
        out, self.held = self.trie.restore(self.held + chunk, False)
        return out

    def close(self) -> str:
        out, self.held = self.trie.restore(self.held, True)[0], ""
        return out


def delta(line: Column) -> Column:
    """The text of a server-sent line: either shape of delta; null for other lines."""
    body = F.regexp_extract(line, r"^data:\s*(.*)$", 1)
    return F.when(body == DONE, DONE).otherwise(F.coalesce(F.get_json_object(body, "$.choices[0].delta.content"), F.get_json_object(body, "$.delta.text")))


class _Maps:
    """Token maps from JSON, as tries; one that comes again right away, as within a stream, is not made again."""

    def __init__(self):
        self.text, self.trie = "", Trie({})

    def of(self, text: str | None) -> Trie:
        if text != self.text:
            self.text, self.trie = text, Trie(json.loads(text or "{}"))
        return self.trie


class _Stream(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held, self.maps = handle.getValueState("held", "held string"), _Maps()

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - Spark's names
        import pandas as pd

        held = self.held.get()[0] if self.held.exists() else ""
        out = []
        for pdf in rows:
            for seq, chunk, tokens in sorted(zip(pdf["seq"], pdf["chunk"], pdf["tokens"])):
                r = Rehydrator(self.maps.of(tokens), held)
                out.append((key[0], seq, r.close() if chunk == DONE else r.feed(chunk or "")))
                held = r.held
        self.held.update((held,))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "text"])

    def close(self) -> None:
        pass


def rehydrate_stream(chunks: DataFrame) -> DataFrame:
    """A streaming frame (stream_id, seq, chunk, tokens as JSON) to restored pieces; needs the RocksDB state store."""
    ship(chunks.sparkSession)
    return chunks.groupBy("stream_id").transformWithStateInPandas(_Stream(), _OUT, "Append", "none")


def rehydrate_batch(chunks: DataFrame) -> DataFrame:
    """The same over a finished table: sorted partitions are streamed, one held tail at a time."""
    ship(chunks.sparkSession)
    rows = chunks.select("stream_id", "seq", "chunk", "tokens").repartition("stream_id").sortWithinPartitions("stream_id", "seq")

    def run(frames):
        import pandas as pd

        current, held, maps = object(), "", _Maps()
        for pdf in frames:
            out = []
            for sid, seq, chunk, tokens in zip(pdf["stream_id"], pdf["seq"], pdf["chunk"], pdf["tokens"]):
                if sid != current:
                    current, held = sid, ""
                r = Rehydrator(maps.of(tokens), held)
                out.append((sid, seq, r.close() if chunk == DONE else r.feed(chunk or "")))
                held = r.held
            yield pd.DataFrame(out, columns=["stream_id", "seq", "text"])

    return rows.mapInPandas(run, _OUT)
