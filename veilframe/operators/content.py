"""Texts inside request bodies, however deep: found, and rewritten in place with one numbering for the whole body."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from veilframe.operators.engine import Engine
from veilframe.operators.sessions import SessionTokens
from veilframe.ship import ship
from veilframe.sources.rules import RuleSet
from veilframe.sources.words import Words

#: Where bodies have content beside their messages: completions, system prompts, queued and tool queries.
FIELDS = ("system", "prompt", "query", "input")
#: A surrogate as JSON names it, and one that is left alone once pairs were joined.
LONE, LONE_CHAR = re.compile(r"\\u[dD][89a-fA-F]"), re.compile("[\ud800-\udfff]")


def walk(content, each: Callable[[str], str]):
    """content with every text replaced: a string, the items of an array, and of an object its text and its content.

    Nesting is followed with a list of what is left, so that hostile depth is no recursion.
    """
    out = [content]
    left: list[tuple] = [(out, 0)]
    while left:
        holder, at = left.pop()
        value = holder[at]
        if isinstance(value, str):
            holder[at] = each(value)
        elif isinstance(value, list):
            holder[at] = copy = list(value)
            left += [(copy, i) for i in reversed(range(len(copy)))]
        elif isinstance(value, dict):
            holder[at] = copy = dict(value)
            left += [(copy, k) for k in ("content", "text") if k in copy]
    return out[0]


def rewrite(body, each: Callable[[str], str]):
    """A body (an object) with the contents of its messages, then its own fields, rewritten."""
    if not isinstance(body, dict):
        return body
    out = dict(body)
    if isinstance(out.get("messages"), list):
        out["messages"] = [m | {"content": walk(m["content"], each)} if isinstance(m, dict) and "content" in m else m for m in out["messages"]]
    return out | {k: walk(out[k], each) for k in FIELDS if k in out}


def texts_of(body) -> list[str]:
    found: list[str] = []
    rewrite(body, lambda t: found.append(t) or t)
    return found


def scrub_bodies(df: DataFrame, rules: RuleSet, column: str = "body", words: Words | None = None) -> DataFrame:
    """df with ``texts`` (what was found, in order), ``clean`` (the body as JSON, rewritten) and ``token_map``.

    A body that is no JSON object, or too deep to be read, has nulls.  Numbers are those of one session for the whole body.
    Half of a surrogate pair, which JSON can name and no text can hold, is read as U+FFFD.
    """
    ship(df.sparkSession)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]

    def run(frames):
        engine = Engine(rules, words)
        for pdf in frames:
            texts, clean, maps = [], [], []
            for raw in pdf[column]:
                try:
                    body = json.loads(raw) if raw is not None else None
                    if raw is not None and LONE.search(raw):
                        body = json.loads(LONE_CHAR.sub("\ufffd", json.dumps(body, ensure_ascii=False)))
                except (ValueError, RecursionError):
                    body = None
                if not isinstance(body, dict):
                    texts.append(None), clean.append(None), maps.append(None)
                    continue
                tokens, known = SessionTokens(), {}

                def each(text: str) -> str:
                    report = engine.report(text, tokens)  # noqa: B023
                    known.update(report["token_map"])  # noqa: B023
                    return report["sanitized_text"]

                texts.append(texts_of(body))
                clean.append(json.dumps(rewrite(body, each), ensure_ascii=False, separators=(",", ":")))
                maps.append(known)
            yield pdf.assign(texts=texts, clean=clean, token_map=maps)

    return df.mapInPandas(run, ", ".join([*fields, "texts array<string>", "clean string", "token_map map<string,string>"]))
