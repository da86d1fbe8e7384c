"""Large dictionaries by joins against a loop over terms and places."""

import random

import pytest

from veilframe.operators import dictionary

TERMS = ["ab", "Ab c", "b", "a-b", "#ab", "ab!", "...", "..", "b. ", "- a", "é", "É", "a  b", "", "?!", "c a b a", " ", "!", "the a", "the b", "the"]


def lower(text):
    return "".join(c.lower() if c < "\x80" else c for c in text)


def by_hand(text, terms):
    low, out = lower(text), []
    for t in filter(None, terms):
        want = lower(t)
        for i in range(len(low) - len(want) + 1):
            end = i + len(want)
            if low.startswith(want, i) and not (i and low[i - 1].isalnum()) and not low[end : end + 1].isalnum():
                out.append((t, i, end))
    return sorted(out)


@pytest.mark.parametrize("limit", [dictionary.BROADCAST_BYTES, -1])
def test_places_are_those_of_a_loop(spark, limit):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "b", "c", "A", " ", " ", "-", "é", "É", ".", "!", "?", "#", "ab", "the"]) for _ in range(rng.randrange(0, 25))) for _ in range(300)] + [""]
    df = spark.createDataFrame([(*x, 1, "z") for x in enumerate(texts)] + [(-1, None, 1, "z")], "id int, text string, s int, rule string")
    terms = spark.createDataFrame([(t,) for t in TERMS] + [(None,)], "term string")
    got = {i: [] for i in range(-1, len(texts))}
    for r in dictionary.match_terms(df.select("id", "text"), terms, broadcast_bytes=limit).collect():
        got[r.id].append((r.term, r.s, r.e))
    assert {i: sorted(v) for i, v in got.items()} == {-1: [], **{i: by_hand(t, TERMS) for i, t in enumerate(texts)}}


def test_no_terms_and_no_texts(spark):
    df = spark.createDataFrame([(1, "a b")], "id int, text string")
    terms = spark.createDataFrame([("a",)], "term string")
    assert dictionary.match_terms(df, terms.limit(0)).count() == 0 and dictionary.match_terms(df.limit(0), terms).count() == 0


def test_the_plan_does_not_grow_with_the_terms(spark):
    df = spark.createDataFrame([(1, "w7 x9 w8")], "id int, text string")
    size = lambda n: len(dictionary.match_terms(df, spark.range(n).selectExpr("concat('w', id) AS term"))._jdf.queryExecution().optimizedPlan().toString())
    assert size(100_000) < 1.1 * size(10)
    assert dictionary.match_terms(df, spark.range(100_000).selectExpr("concat('w', id) AS term")).count() == 2


def test_a_large_dictionary_is_joined_once(spark):
    """Words that no term can be are not shuffled, and rows grouped by core and more columns lie where they were joined."""
    df = spark.createDataFrame([(1, "abcdefg bc abcdefg hi"), (2, "hi Bc abcdefh")], "id int, text string")
    terms = spark.createDataFrame([("abcdefg",), ("bc abcdefg",), ("BC ABCDEFH",)], "term string")
    hits = dictionary.match_terms(df, terms, broadcast_bytes=-1, core="core")
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    each = hits.groupBy("id", "core", "term").count()
    exchanges = lambda x: x._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(each) == exchanges(hits)
    assert sorted(map(tuple, each.collect())) == [(1, "abcdefg", "abcdefg", 2), (1, "bc abcdefg", "bc abcdefg", 1), (2, "bc abcdefh", "BC ABCDEFH", 1)]


def test_places_beyond_ascii_and_over_chunks(spark, monkeypatch):
    """Places are counted in characters, and do not depend on how many texts and rows are looked at together."""
    import pyarrow as pa

    rng = random.Random(2)
    texts = ["".join(rng.choice(["ab", "c", "é", "日本", "\U0001d4b3", "\U0001f600", "٣", "Ⅷ", "²", " ", " ", "  ", "-", "\u2003", "Ab"]) for _ in range(rng.randrange(0, 30))) for _ in range(200)]
    terms = ["ab", "c ab", "日本", "\U0001d4b3", "é  c", "\U0001f600ab", "ab-", "٣", "AB c", "Ⅷ²"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for some in (terms, ["ab", "c ab", "日本", "AB c"]):  # the second has only single spaces between words and no marks around them
        got = sorted((r.id, r.term, r.s, r.e) for r in dictionary.match_terms(df, spark.createDataFrame([(t,) for t in some], "term string")).collect())
        assert got == sorted((i, *x) for i, t in enumerate(texts) for x in by_hand(t, some))
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], names=["id", "text"])
    edges, shapes = tuple(dictionary._edges(spark)), [(1, 1, 9, True), (2, 1, 9, True), (3, 2, 20, False)]
    cut = lambda: sorted(tuple(r.values()) for b in dictionary._cut(iter([batch.slice(3, 190)]), edges, shapes, True) for r in b.to_pylist())
    whole = cut()
    for chunk, rows in ((1, 1), (16, 3), (1 << 10, 1 << 10)):
        monkeypatch.setattr(dictionary, "CHUNK", chunk)
        monkeypatch.setattr(dictionary, "ROWS", rows)
        assert cut() == whole


def test_letters_and_digits_are_those_of_the_patterns(spark):
    import itertools

    edges = dictionary._edges(spark)
    assert edges == sorted(edges) and len(edges) % 2 == 0
    inside = set(itertools.chain.from_iterable(range(a, b) for a, b in zip(edges[::2], edges[1::2])))
    some = [*range(1, 0x3000), 0x1D4B3, 0x1F600, 0x10FFFF, 0x24B6, 0x0E31]
    rows = spark.createDataFrame([(c, chr(c)) for c in some], "c int, x string").filter(f"x rlike '^{dictionary.WORD.replace(chr(92), chr(92) * 2)}$'").collect()
    assert {r.c for r in rows} == inside & set(some)


def test_many_words_and_terms_take_little_time(spark):
    """Six million words and as many places: each took microseconds of all cores where lists of places were folded row by row."""
    import time

    from pyspark.sql import functions as F

    df = spark.range(3000).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda k: F.concat(F.lit("wording"), (k * 7919 + F.col("id") * 104729) % 200_003)), " ").alias("text")).repartition(4).cache()
    terms = spark.range(200_003).select(F.concat(F.lit("wording"), "id").alias("term")).cache()
    assert df.count() == 3000 and terms.count() == 200_003
    assert dictionary.match_terms(df.limit(1), terms).count() == 2000
    began = time.time()
    assert dictionary.match_terms(df, terms).count() == 6_000_000
    took = time.time() - began
    assert took < 10, took


def test_invalid_utf8_is_a_gap(spark):
    df = spark.sql("SELECT 1 AS id, CAST(X'616220FFC3206162' AS STRING) AS text")
    rows = dictionary.places(df, "text", [(1, 1, 9, True)]).collect()
    assert [(r["_core"], r["_start"]) for r in rows] == [("ab", 0), ("ab", 6)]
