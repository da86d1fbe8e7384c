"""Line dedup: repeated runs of lines by distributed prefix doubling over line ids.

The corpus is one sequence of line ids, document after document; blank lines are left out of it.  Suffixes are ranked by
their first 2^k lines, for k = 0, 1, 2, ...: each round sorts the pairs of ranks at p and p + 2^k by range, which gives
the ranks at 2^(k+1).  Suffixes whose run is unique have their place then and leave, so each round only holds what
repeats; after the last round the ranks (``suffix_array``) order all suffixes that share lines with another one.

Suffixes of equal rank at a length are one interval of the suffix array whose members have a common prefix of that length.
The way down finds, for every suffix, the longest prefix that an earlier suffix shares (the greatest depth of a
longest-common-prefix interval with an earlier member), adding powers of two: at length c, the members of an interval
split by their ranks at p + c.  In each part with several members, all but the first go on to c + 2^k; the first stays,
stands there for the whole part, and a witness of it goes along.  Runs that lie within a longer one are left out; the
remaining maximal runs of ``MIN_WORDS`` words or more are deleted, as there is an earlier copy of each.

Ranks compare line ids, not texts: a line id is a 128-bit hash of the line without white space at its ends.

Defined cases: null text is empty text and stays null; rows are taken in order of ``doc_id`` where those are unique and
fit, else in the order read; a run never reaches into the next row; equal rows beyond the first lose all their lines
that make up runs long enough; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from veilframe.llm.util import NON_WS, WS_CLASS, fingerprint, kept_lines, materialize, remove, salted_join, table

MIN_WORDS = 20
#: No text has more lines than characters, and a string is shorter than 2^31 bytes.
LINE_BITS = 31
#: White space: the space and the ASCII controls from tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs with a unique ``row`` that keeps their order, and the bits that hold the number of a line in a row."""
    n, distinct, low, high = docs.agg(F.count("*"), F.countDistinct("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    numbers = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    if n == 0 or (n == distinct and numbers and low >= 0 and int(high).bit_length() + LINE_BITS < 63):
        return docs.withColumn("row", F.col("doc_id").cast("long")), LINE_BITS
    most = docs.agg(F.max(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0]
    bits = max(1, int(most or 1).bit_length())
    kept, _ = materialize(docs.withColumn("_at", F.monotonically_increasing_id()), "rows")
    width = (kept.agg(F.max(F.col("_at").bitwiseAND((1 << 33) - 1))).first()[0] or 0) + 1
    return kept.withColumn("row", F.shiftright("_at", 33) * width + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at"), bits


def line_table(docs: DataFrame, bits: int) -> DataFrame:
    """Every non-blank line: pos (row and number among them), idx (number in the text), its 128-bit id, its words."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("idx"), F.btrim(x, F.lit(WHITE)).alias("line")))
    rows = docs.select("row", F.posexplode(F.filter(lines, lambda x: x["line"] != "")).alias("s", "x"))
    h1, h2 = fingerprint(F.col("x.line"))
    return rows.select((F.shiftleft("row", bits) + F.col("s")).alias("pos"), F.col("x.idx").alias("idx"), h1.alias("h1"), h2.alias("h2"), F.size(F.split(F.col("x.line"), WS_CLASS)).alias("w"))


def _repeated(named: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of named whose keys occur several times, with ``name``: the rank of the keys among those that do.

    Keys are sorted by range, so the number of a partition and the place in it are a rank; ranks are in order, with gaps.
    """
    groups = named.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    ranked = groups.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())
    return salted_join(named, ranked, keys, F.col("pos"))


def _same_row(a: Column, b: Column, bits: int) -> Column:
    return F.shiftright(a, bits) == F.shiftright(b, bits)


def ascend(first: DataFrame, bits: int) -> tuple[list[DataFrame], list[str]]:
    """Names at lengths 1, 2, 4, ...: tables (pos, name) of the suffixes whose run of that length repeats."""
    levels, paths = [first], []
    while True:
        step = 1 << (len(levels) - 1)
        names = levels[-1].select("pos", "name")
        after = names.select((F.col("pos") - step).alias("pos"), F.col("pos").alias("next"), F.col("name").alias("name2"))
        pairs = names.join(after, "pos").filter(_same_row(F.col("pos"), F.col("next"), bits)).select("pos", F.col("name").alias("name1"), "name2")
        found, path = materialize(_repeated(pairs, ["name1", "name2"]).select("pos", "name"), "names")
        paths.append(path)
        if found.isEmpty():
            return levels, paths
        levels.append(found)


def suffix_array(levels: list[DataFrame]) -> DataFrame:
    """(pos, ranks): ranks, compared as lists, put the suffixes that repeat at all in order; a list ends where the run is
    unique or its row ends."""
    every = [n.select("pos", F.struct(F.lit(k).alias("k"), F.col("name").alias("name")).alias("r")) for k, n in enumerate(levels)]
    rows = functools.reduce(DataFrame.unionByName, every)
    return rows.groupBy("pos").agg(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["name"]).alias("ranks"))


def longest_earlier(levels: list[DataFrame], bits: int) -> tuple[DataFrame, str]:
    """(pos, c): for suffixes that share lines with an earlier one, how many at most."""
    rows: DataFrame | None = None
    path = ""
    for k in reversed(range(len(levels))):
        names = levels[k].select("pos", "name")
        if rows is None:
            at_root, here = names, None
        else:
            gone = rows.filter("seeks").select("pos")
            at_root = names.join(gone, "pos", "left_anti")
            at = names.select(F.col("pos").alias("at"), "name")
            here = rows.withColumn("at", F.col("pos") + F.col("c")).join(at, "at", "left")
            inside = F.col("name").isNotNull() & _same_row(F.col("pos"), F.col("at"), bits)
            here = here.select("pos", "c", "q", "seeks", F.when(inside, F.col("name")).alias("name"))
        root = at_root.select("pos", F.lit(0).cast("long").alias("c"), F.lit(-1).cast("long").alias("q"), F.lit(True).alias("seeks"), "name")
        everyone = root if here is None else root.unionByName(here)
        parts = everyone.filter("name IS NOT NULL").groupBy("c", "q", "name").agg(F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        joined = salted_join(everyone, parts, ["c", "q", "name"], F.col("pos"), "left")
        goes = F.col("first").isNotNull() & (F.col("pos") > F.col("first"))
        moved = joined.select("pos", F.when(goes, F.col("c") + (1 << k)).otherwise(F.col("c")).alias("c"), F.when(goes, F.col("first")).otherwise(F.col("q")).alias("q"), "seeks").filter("c > 0")
        witnesses = parts.select(F.col("first").alias("pos"), (F.col("c") + (1 << k)).alias("c"), F.col("first").alias("q"), F.lit(False).alias("seeks"))
        old = path
        rows, path = materialize(moved.unionByName(witnesses), "runs")
        if old:
            remove(rows.sparkSession, old)
    return rows.filter("seeks").select("pos", "c"), path


def maximal_runs(found: DataFrame, bits: int) -> DataFrame:
    """Runs (pos, c) that do not lie within the run of an earlier line of the same row."""
    w = Window.partitionBy(F.shiftright("pos", bits)).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.col("pos") + F.col("c")).over(w)
    return found.withColumn("before", before).filter(F.col("before").isNull() | (F.col("pos") + F.col("c") > F.col("before"))).drop("before")


def repeated_lines(docs: DataFrame, bits: int, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (row, text) to (row, idx, w): the lines to delete."""
    spark = docs.sparkSession
    lines, lines_path = materialize(line_table(docs, bits), "lines")
    first, first_path = materialize(_repeated(lines, ["h1", "h2"]).select("pos", "name", "idx", "w"), "names")
    remove(spark, lines_path)
    levels, paths = ascend(first, bits)
    found, runs_path = longest_earlier(levels, bits)
    runs = maximal_runs(found, bits).select(F.col("pos").alias("run"), F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("c") - 1)).alias("pos"))
    covered = runs.join(first.select("pos", "idx", "w"), "pos")
    long_enough = covered.groupBy("run").agg(F.sum("w").alias("words")).filter(F.col("words") >= min_words).select("run")
    gone = covered.join(long_enough, "run").groupBy("pos").agg(F.first("idx").alias("idx"), F.first("w").alias("w"))
    out, _ = materialize(gone.select(F.shiftright("pos", bits).alias("row"), "idx", "w"), "deleted")
    for p in [first_path, runs_path, *paths]:
        remove(spark, p)
    return out


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each row of docs: doc (the row as a struct), text without the later copies, removed_lines,
    removed_words, and emptied (this left the text without a word)."""
    rows, bits = numbered(docs.select("doc_id", "text", F.struct("*").alias("doc")))
    gone = repeated_lines(rows.select("row", "text"), bits, min_words).groupBy("row").agg(F.collect_list("idx").alias("idx"), F.count("*").alias("n"), F.sum("w").alias("words"))
    joined = rows.join(gone, "row", "left")
    kept = kept_lines(F.col("text"), F.col("idx"))
    text = F.when(F.col("idx").isNull(), F.col("text")).otherwise(kept)
    emptied = F.col("idx").isNotNull() & ~F.coalesce(kept, F.lit("")).rlike(NON_WS)
    zero = F.lit(0).cast("long")
    return joined.select("doc_id", "doc", text.alias("text"), F.coalesce("n", zero).alias("removed_lines"), F.coalesce("words", zero).alias("removed_words"), emptied.alias("emptied"))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("doc")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline form: later copies leave the texts; documents that this leaves without a word go.

    ``n_chars``, where there is such a column, follows a text that changed.
    """
    out = dedup(docs).filter(~F.col("emptied"))
    n_chars = F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None
    own = {"text": F.col("text"), "n_chars": n_chars}
    return out.select(*[own[c].alias(c) if c in own else F.col(f"doc.`{c}`") for c in docs.columns])
