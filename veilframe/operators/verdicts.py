"""Spans that only a model can settle: questions about them as rows, answers as a table that grows, names confirmed by it.

A question is a window of sentences, or a probe of one name (``windows``), and is known by the hash of what is asked, so
that one which stands in many texts, or came in an earlier batch, is asked once.  A scorer takes a frame of (hash, asked)
and returns a row for each: hash and entities, an empty list where it sees none.

Texts are read where they lie and known by their hash, so equal ones share their answers; repeated questions go before the
shuffle.  A question or a text that a third of all rows hold is a skewed key of a join with one row, which adaptive
execution splits.  Null texts have no
questions and a null report; empty ones no questions; a question that no row of the table answers confirms nothing; of
several answers to one question the first in order of their values counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType, _parse_datatype_string

from veilframe.operators.engine import ROWS, Engine, packed, scrub
from veilframe.operators.spans import matches
from veilframe.operators.windows import questions as asked_of
from veilframe.ship import ship
from veilframe.sources.rules import RuleSet
from veilframe.sources.tables import Tables
from veilframe.sources.words import Words

ENTITIES = "array<struct<s:int,e:int,label:string,score:double>>"
SAID = f"array<struct<kind:string,place:int,entities:{ENTITIES}>>"
Scorer = Callable[[DataFrame], DataFrame]


def studied(df: DataFrame, rules: RuleSet, column: str = "text", words: Words | None = None) -> DataFrame:
    """df with what one reading of each text gives: _t (the text's hash), _found (see ``engine.packed``) and _asked, its
    questions; nulls for a null text."""
    import pyarrow as pa

    ship(df.sparkSession)
    fields = [pa.field("kind", pa.string()), pa.field("place", pa.int32()), pa.field("asked", pa.string()), pa.field("hash", pa.string())]

    def run(batches: Iterator) -> Iterator:
        engine = Engine(rules, words)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(column).to_pylist()
                found, rows, ends = [], [], [0]
                for text, (n, absent, names, more) in zip(texts, engine.prepared(texts, True)):
                    if text is None:
                        found.append(None)
                    else:
                        confirmed, potential = engine.detect(n, absent, names)
                        candidates = engine.candidates(n, confirmed, more)
                        found.append(packed(confirmed, potential, candidates))
                        rows += ((*q, sha256(q[2].encode()).hexdigest()) for q in asked_of(n.unicode, candidates, engine.words))
                    ends.append(len(rows))
                cols = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, fields)]
                asked = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(cols, fields=fields), mask=pa.array([t is None for t in texts], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary()), asked], names=[*part.schema.names, "_found", "_asked"])

    keyed = df.withColumn("_t", F.sha2(F.col(f"`{column}`"), 256))
    kinds = "array<struct<kind:string,place:int,asked:string,hash:string>>"
    return keyed.mapInArrow(run, StructType([*keyed.schema.fields, StructField("_found", BinaryType()), StructField("_asked", _parse_datatype_string(kinds))]))


def asked_in(known: DataFrame) -> DataFrame:
    """A row for each question about each of the texts that were ``studied``: _t, kind, place, asked, hash."""
    return known.select("_t", F.explode("_asked").alias("q")).select("_t", "q.kind", "q.place", "q.asked", "q.hash")


def questions(df: DataFrame, rules: RuleSet, column: str = "text", words: Words | None = None) -> DataFrame:
    """A row for each question about each text: _t (the text's hash), kind, place, asked, hash."""
    return asked_in(studied(df.select(F.col(f"`{column}`").alias("text")), rules, "text", words))


def unseen(asked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(hash, asked) of each different question that the table does not answer."""
    return asked.select("hash", "asked").dropDuplicates(["hash"]).join(verdicts.select("hash"), "hash", "left_anti")


def said(asked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Answers by text: _t and an array of ``SAID``; texts without any entity have no row."""
    one = verdicts.groupBy("hash").agg(F.min(F.col("entities").cast(ENTITIES)).alias("entities")).where(F.size("entities") > 0)
    found = asked.select("_t", "kind", "place", "hash").distinct().join(one, "hash")
    return found.groupBy("_t").agg(F.sort_array(F.collect_list(F.struct("kind", "place", "entities"))).cast(SAID).alias("_said"))


def scrub_with(df: DataFrame, rules: RuleSet, verdicts: DataFrame, column: str = "text", words: Words | None = None, threshold: float = 0.85, asked: DataFrame | None = None) -> DataFrame:
    """df with ``report``, candidates that the table of verdicts confirms redacted too.

    asked: the questions about these texts, where they have been made already.
    """
    asked = questions(df, rules, column, words) if asked is None else asked
    keyed = df.withColumn("_t", F.sha2(F.col(f"`{column}`"), 256)).join(said(asked, verdicts), "_t", "left").drop("_t")
    return scrub(keyed, rules, column, words, "_said", threshold)


def scrub_studied(known: DataFrame, rules: RuleSet, verdicts: DataFrame, column: str = "text", words: Words | None = None, threshold: float = 0.85) -> DataFrame:
    """scrub_with for texts that were ``studied``, and best kept since: nothing is looked for in them again."""
    keyed = known.drop("_asked").join(said(asked_in(known), verdicts), "_t", "left").drop("_t")
    return scrub(keyed, rules, column, words, "_said", threshold, "_found")


def settle(tables: Tables, df: DataFrame, rules: RuleSet, scorer: Scorer, column: str = "text", words: Words | None = None, threshold: float = 0.85, app: str | None = None, batch: int | None = None) -> DataFrame:
    """scrub_with, after the scorer has been asked what the table ``verdicts`` does not answer yet.

    Its answers, and which questions the texts have (by their hashes; what was asked is not kept), are one transaction; a
    batch that was committed before asks nothing anew.
    """
    if (change := tables.begin(app, batch)) is None:
        return scrub_with(df, rules, tables.read("verdicts"), column, words, threshold)
    asked = questions(df, rules, column, words).persist()
    try:
        change.append(scorer(unseen(asked, change.read("verdicts"))), "verdicts")
        held = change.replace(asked, "questions")
        change.commit()
    finally:
        asked.unpersist()
    return scrub_with(df, rules, tables.read("verdicts"), column, words, threshold, held)


def by_function(score: Callable[[list[str]], list[list[tuple[int, int, str, float]]]], schema: str = f"hash string, entities {ENTITIES}") -> Scorer:
    """A scorer from a function over a batch of questions, such as a model's session that each worker opens once."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("label", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = [[dict(zip(("s", "e", "label", "score"), x)) for x in xs] for xs in score(part.column("asked").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("hash"), pa.array(found, kind)], names=["hash", "entities"])

    return lambda asked: asked.select("hash", "asked").mapInArrow(run, schema)


def casing(texts: DataFrame, column: str = "text", least: int = 3) -> DataFrame:
    """How often each word has a capital first letter where no sentence starts: word (lower case), n, share.

    Words seen less than ``least`` times there, or never with a capital, are left out.
    """
    inside = F.regexp_extract_all(F.col(column), F.lit(r" (?<=[^.!?\s] )(\p{L}+)"), 1)
    seen = texts.select(F.explode(inside).alias("w")).groupBy("w").agg(F.count("*").alias("n"))  # each spelling is looked at once
    counts = seen.groupBy(F.lower("w").alias("word")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("w").rlike(r"^\p{Lu}"), F.col("n")).otherwise(0)).alias("raised"))
    return counts.where((F.col("n") >= least) & (F.col("raised") > 0)).select("word", "n", (F.col("raised") / F.col("n")).alias("share"))


def by_casing(shares: DataFrame) -> Scorer:
    """A scorer without a model: a word that has a capital is a person with the share that ``casing`` found."""

    def score(asked: DataFrame) -> DataFrame:
        raised = r"(?=\p{Lu})(?<!\p{L})\p{Lu}\p{L}*"
        spots = F.arrays_zip(matches(F.col("asked"), raised).alias("spot"), F.regexp_extract_all("asked", F.lit(raised), 0).alias("said"))
        words = asked.select("hash", F.explode_outer(spots).alias("m")).select("hash", "m.spot.s", "m.spot.e", F.lower("m.said").alias("word"))
        entity = F.struct("s", "e", F.lit("B-PER").alias("label"), F.col("share").alias("score"))
        known = words.join(shares, "word", "left").groupBy("hash").agg(F.collect_list(F.when(F.col("share").isNotNull(), entity)).alias("entities"))
        return known.select("hash", F.sort_array("entities").cast(ENTITIES).alias("entities"))

    return score
