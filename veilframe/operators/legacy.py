"""The older, simpler shield: number shapes first, then terms, each match of the first kind with a token of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.text import visible
from veilframe.operators.spans import let

# The shape and the tokens of the older shield.
SSN = r"\d{3}-\d{2}-\d{4}"
REPORT = "sanitized_text, token_map"


def _tokens(text: Column, pattern: str, kind: str, once: bool) -> Column:
    """text with every match replaced by [kind_n], and the map back; once: equal matches share a token.

    The distinct matches are found once a text, and a match looks its number up among them.
    """
    token = lambda n: F.concat(F.lit(f"[{kind}_"), n.cast("string"), F.lit("]"))

    def rewritten(p: Column) -> Column:
        number = (lambda m, i: F.array_position(p["k"], m).cast("int") - 1) if once else (lambda m, i: i)
        marks = F.transform(p["m"], lambda m, i: F.get(p["t"], number(m, i)))
        parts = F.flatten(F.zip_with(p["g"], marks, lambda g, t: F.array(g, F.coalesce(t, F.lit("")))))
        return F.struct(F.array_join(parts, "").alias("text"), F.map_from_arrays(p["t"], p["k"]).alias("map"))

    def named(p: Column) -> Column:
        tokens = F.transform(p["k"], lambda _, i: token(i + 1))
        return let(F.struct(p["g"].alias("g"), p["m"].alias("m"), p["k"].alias("k"), tokens.alias("t")), rewritten)

    def keyed(p: Column) -> Column:
        keys = F.array_distinct(p["m"]) if once else p["m"]
        return let(F.struct(p["g"].alias("g"), p["m"].alias("m"), keys.alias("k")), named)

    return let(F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("m")), keyed)


def shield(df: DataFrame, terms: list[str], column: str = "text") -> DataFrame:
    """df with sanitized_text and token_map; terms match anywhere, ASCII case ignored; null stays null."""
    quoted = ["".join(c if c.isalnum() else f"\\x{{{ord(c):X}}}" for c in t) for t in terms if t]

    def both(a: Column) -> Column:
        if not quoted:
            return a
        second = _tokens(a["text"], "(?i)(?:" + "|".join(quoted) + ")", "TERM", once=True)
        return let(second, lambda b: F.struct(b["text"].alias("text"), F.map_concat(a["map"], b["map"]).alias("map")))

    found = let(_tokens(visible(F.col(column)), SSN, "SSN", once=False), both)
    out = df.withColumn("_b", F.when(F.col(column).isNotNull(), found))
    return out.withColumn("sanitized_text", F.col("_b.text")).withColumn("token_map", F.col("_b.map")).drop("_b")
