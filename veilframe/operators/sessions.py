"""Session tokens: one numbering for each user, kept over turns, with people linked by the parts of their names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilframe.functions.crypto import seal, unseal
from veilframe.operators.engine import Engine, Span, placeholder_prefix
from veilframe.ship import ship
from veilframe.sources.rules import RuleSet
from veilframe.sources.tables import Tables
from veilframe.sources.words import Words

PERSONS = ("IndividualName", "HighConfidenceAi")
#: Turns that a task prepares together and gives out, so that its memory does not grow with the batches that Spark hands in.
TURNS = 500


def standalone(text: str, sub: str) -> bool:
    return bool(sub) and re.search(rf"(?<![^\W_]){re.escape(sub)}(?![^\W_])", text) is not None


class SessionTokens:
    """A person is looked up as a whole, then as a part of a known name, then as a longer form of one (the earliest
    known wins); everything else, and new people, by category and text."""

    def __init__(self):
        self.tokens: dict[str, str] = {}
        self.people: dict[str, str] = {}
        self.values: dict[str, str] = {}

    def of(self, text: str, span: Span) -> str:
        low = text.lower()
        person = span.category in PERSONS
        if person:
            if low in self.people:
                return self.people[low]
            if len(low) > 3:
                for known, token in self.people.items():
                    if standalone(known, low):
                        return token
            for known, token in self.people.items():
                if len(known) > 3 and standalone(low, known):
                    self.people[low] = token
                    return token
        key = f"{span.category}:{low}"
        if key not in self.tokens:
            token = self.tokens[key] = f"[{placeholder_prefix(span.rule, span.category)}_{len(self.tokens) + 1}]"
            self.values[token] = text
            if person:
                self.people[low] = token
        return self.tokens[key]

    def size(self) -> tuple[int, int]:
        """Changes with every change of the state: entries are only added."""
        return len(self.tokens), len(self.people)

    def state(self) -> dict:
        return {"tokens": self.tokens, "people": self.people, "values": self.values}

    @classmethod
    def from_state(cls, state: dict) -> SessionTokens:
        out = cls()
        out.tokens, out.people, out.values = dict(state["tokens"]), dict(state["people"]), dict(state["values"])
        return out


def scrub_sessions(df: DataFrame, user: str, order: str, rules: RuleSet, column: str = "text", words: Words | None = None) -> DataFrame:
    """df's user, order and ``sanitized_text``, in order of each user's turns."""
    return _scrubbed(df, user, order, rules, column, words, None, False).drop("state")


def session_batch(df: DataFrame, user: str, order: str, rules: RuleSet, states: DataFrame | None = None, column: str = "text", words: Words | None = None) -> DataFrame:
    """The turns of a batch, and the states that it leaves: rows with ``state`` (JSON) instead of a turn, for users whose
    session has new tokens or names.  Turns without a user are one session that leaves no state.

    states: (the user's column, state), one row a user, of earlier batches; users without turns in this one are left as
    they are and not read.
    """
    return _scrubbed(df, user, order, rules, column, words, states, True)


def _scrubbed(df: DataFrame, user: str, order: str, rules: RuleSet, column: str, words: Words | None, states: DataFrame | None, keep: bool) -> DataFrame:
    """Partitions are sorted by user and turn, a user's earlier state first, and streamed, so a task holds the state of
    one session, not its rows."""
    ship(df.sparkSession)
    kinds = dict(df.dtypes)
    schema = f"`{user}` {kinds[user]}, `{order}` {kinds[order]}, sanitized_text string, n_redactions int, state string"
    rows = df.select(user, order, F.col(column).alias("_text"), F.lit(1).alias("_turn"))
    if states is not None:
        mine = states.join(df.select(user).distinct(), user, "left_semi")
        rows = rows.unionByName(mine.select(F.col(user).cast(kinds[user]).alias(user), F.lit(None).cast(kinds[order]).alias(order), F.col("state").alias("_text"), F.lit(0).alias("_turn")))
    rows = rows.repartition(user).sortWithinPartitions(user, "_turn", order, "_text")

    def run(frames):
        import json

        import pandas as pd

        engine, current, tokens, before = Engine(rules, words), object(), SessionTokens(), (0, 0)

        def left():
            if keep and not pd.isna(current) and tokens.size() != before:
                yield current, None, None, None, json.dumps(tokens.state(), ensure_ascii=False)

        for pdf in (whole.iloc[at : at + TURNS] for whole in frames for at in range(0, len(whole), TURNS)):
            out = []
            texts = [t or "" for t in pdf["_text"]]
            known = iter(engine.prepared([t for t, turn in zip(texts, pdf["_turn"]) if turn]))
            for u, o, text, turn in zip(pdf[user], pdf[order], texts, pdf["_turn"]):
                if u != current and not (pd.isna(u) and pd.isna(current)):
                    out += left()
                    current, tokens, before = u, SessionTokens(), (0, 0)
                if turn:
                    r = engine.report(text, tokens, next(known))
                    out.append((u, o, r["sanitized_text"], len(r["redactions"]), None))
                else:
                    tokens = SessionTokens.from_state(json.loads(text))
                    before = tokens.size()
            yield frame(out)
        yield frame(list(left()))

    def frame(out):
        import pandas as pd

        return pd.DataFrame(out, columns=[user, order, "sanitized_text", "n_redactions", "state"], dtype=object)

    return rows.mapInPandas(run, schema)


SESSION_INFO = "session-state"
IDLE = 3600


def seal_sessions(states: DataFrame, pepper: bytes) -> DataFrame:
    """states (username, state as JSON, updated_at) as they are stored: sealed for their user."""
    return states.select("username", seal(F.col("state"), F.col("username"), pepper, SESSION_INFO).alias("session_data"), "updated_at")


def open_sessions(stored: DataFrame, pepper: bytes) -> DataFrame:
    """The latest state of each user; null where it was altered or sealed for another."""
    now = latest(stored.withColumn("_tie", F.xxhash64("session_data")), "username", "updated_at", "_tie")
    return now.select("username", unseal(F.col("session_data"), F.col("username"), pepper, SESSION_INFO).cast("string").alias("state"), "updated_at")


def resume(store: Tables, turns: DataFrame, user: str, order: str, rules: RuleSet, pepper: bytes, app: str, batch: int, now: str, column: str = "text", words: Words | None = None, idle: int | None = IDLE) -> bool:
    """Sessions go on by a batch of turns: ``session_turns`` gets its rewritten turns, ``sessions`` the sealed states that it
    changed, in one transaction; False where this writer's batch was there already.

    now: "yyyy-MM-dd HH:mm:ss".  A session whose state was last written over ``idle`` seconds before begins anew (None:
    never).  A state that cannot be opened stops the job, as its numbers would be given out twice.
    """
    if (change := store.begin(app, batch)) is None:
        return False
    stored = change.read("sessions")
    if idle is not None:
        stored = stored.filter(F.unix_timestamp("updated_at") >= F.unix_timestamp(F.lit(now)) - idle)
    opened = open_sessions(stored, pepper)
    states = opened.select(F.col("username").alias(user), F.coalesce("state", F.raise_error(F.lit("a session's state cannot be opened")).cast("string")).alias("state"))
    named = turns.withColumn(user, F.col(user).cast("string"))
    out = session_batch(named, user, order, rules, states, column, words)
    sealed = F.when(F.col("state").isNotNull(), seal(F.col("state"), F.col(user), pepper, SESSION_INFO))
    rows = change.append(out.select(F.col(user).alias("username"), F.col(order).alias("seq"), "sanitized_text", "n_redactions", sealed.alias("session_data")), "session_turns")
    left = rows.filter("session_data IS NOT NULL").select("username", "session_data", F.lit(now).alias("updated_at"))
    change.merge(left, "sessions", lambda t: latest(t.withColumn("_tie", F.xxhash64("session_data")), "username", "updated_at", "_tie"))
    change.commit()
    return True


def turns_of(store: Tables) -> DataFrame:
    """The rewritten turns of all batches."""
    return store.read("session_turns").filter("session_data IS NULL").drop("session_data")


def session_stream(turns: DataFrame, rules: RuleSet, words: Words | None = None, idle: int | None = IDLE) -> DataFrame:
    """A streaming frame (username, seq, text) scrubbed with session tokens; the state of a user who is silent for
    ``idle`` seconds is dropped (None: kept; queries that stop once their input is read need that).  Needs the RocksDB
    state store."""
    ship(turns.sparkSession)
    return turns.groupBy("username").transformWithStateInPandas(_Sessions(rules, words, idle), "username string, seq long, sanitized_text string", "Append", "ProcessingTime" if idle else "None")


class _Sessions(StatefulProcessor):
    def __init__(self, rules: RuleSet, words: Words | None, idle: int | None):
        self.rules, self.words, self.idle = rules, words, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("session", "state string", *([self.idle * 1000] if self.idle else []))
        self.engine = Engine(self.rules, self.words)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - Spark's names
        import json

        import pandas as pd

        tokens = SessionTokens.from_state(json.loads(self.kept.get()[0])) if self.kept.exists() else SessionTokens()
        turns = sorted((seq, text or "") for pdf in rows for seq, text in zip(pdf["seq"], pdf["text"]))
        out = [(key[0], seq, self.engine.report(text, tokens)["sanitized_text"]) for seq, text in turns]
        self.kept.update((json.dumps(tokens.state(), ensure_ascii=False),))
        yield pd.DataFrame(out, columns=["username", "seq", "sanitized_text"])

    def close(self) -> None:
        pass


def latest(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Upsert by key: the last row wins (map-side, no window)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("v")).select(key, "v.*")


def first_k(df: DataFrame, owner: str | list[str], order: str | list[str], k: int) -> DataFrame:
    w = Window.partitionBy(owner).orderBy(order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
