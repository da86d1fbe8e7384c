"""Quality rules: base statistics of each text and cross-document line frequency within a host.

Lines are normalised (lower case, white space collapsed) and hashed.  For each host, the number of distinct documents
that hold a line is counted; exact copies of a text are one document, so that a page stored a thousand times is not
taken for boilerplate (``copies=True`` counts every row).  A line is above its limit when more than ``max(min_docs, max_share * documents of the host)`` documents
hold it.  Such lines are removed, and a document is rejected (depleted) when less than ``min_left`` of its words remain.

Defined cases: null text is empty text; a null host is a host of its own; empty texts fail the base rule (fewer than
20 words); a very long text is a row like any other, its lines each a row; a count at its limit is not above it; repeated
rows and repeated ids each give a row; an empty table gives no rows; other columns of the input are not looked at,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.util import NON_WS, fingerprint, kept_lines, let, materialize, salted_join, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Production limits of the line rule.
MIN_DOCS = 10
MAX_SHARE = 0.02
MIN_LEFT = 0.3


def repeated_words(w: Column) -> Column:
    """Words inside windows of eight words that occur twice or more in the text, given its array of words."""

    def covered(positions: Column) -> Column:
        k = F.size(positions)
        gaps = F.zip_with(F.slice(positions, 1, k - 1), F.slice(positions, 2, k - 1), lambda a, b: F.least(F.lit(WINDOW), b - a))
        return F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda acc, x: acc + x)

    def again(win: Column) -> Column:
        placed = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def pairs(s: Column) -> Column:
            m = F.size(s)
            both = F.zip_with(
                F.slice(s, 1, m - 1),
                F.slice(s, 2, m - 1),
                lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
            )
            return let(F.sort_array(F.array_distinct(F.flatten(both))), covered)

        return let(placed, pairs)

    def of_windows(win: Column) -> Column:
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(again(win))

    hashed = F.transform(w, lambda x: F.xxhash64(x))

    def windows(hs: Column, width: int, then) -> Column:
        """then(hashes of the windows of eight), from those of windows half as wide: no window is made as a list."""
        if width == WINDOW:
            return then(hs)
        n = F.size(hs) - width
        wider = F.zip_with(F.slice(hs, F.lit(1), n), F.slice(hs, F.lit(width + 1), n), lambda a, b: F.xxhash64(a, b))
        return let(wider, lambda x: windows(x, 2 * width, then))

    long_enough = let(hashed, lambda hs: windows(hs, 1, of_windows))
    return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(long_enough)


def base_stats(text: Column) -> Column:
    """A struct of the base statistics of a text without nulls."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NON_WS))
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[ \x09-\x0D]+", " ")))


def line_table(docs: DataFrame) -> DataFrame:
    """One row for each non-blank line of each distinct text of a host: host, f1, f2, idx, h, w."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("source").alias("host"), *[c.alias(n) for c, n in zip(fingerprint(text), ("f1", "f2"))], F.posexplode(F.split(text, "\n")).alias("idx", "line"))
    rows = rows.filter(F.col("line").rlike(NON_WS)).select("host", "f1", "f2", "idx", F.xxhash64(normalised(F.col("line"))).alias("h"), F.size(words(F.col("line"))).alias("w"))
    return rows.groupBy("host", "f1", "f2", "idx").agg(F.first("h").alias("h"), F.first("w").alias("w"), F.count("*").alias("rows"))


def frequent_lines(lines: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, copies: bool = False) -> DataFrame:
    """The lines above the limit of their host: host, h."""
    one = (F.first("rows") if copies else F.lit(1)).alias("one")
    lines = lines.withColumn("host", F.struct("host"))  # a struct equals itself even where the host is null
    per_host = lines.groupBy("host", "f1", "f2").agg(one).groupBy("host").agg(F.sum("one").alias("n_docs"))
    per_line = lines.groupBy("host", "h", "f1", "f2").agg(one).groupBy("host", "h").agg(F.sum("one").alias("n")).filter(F.col("n") > min_docs)
    return per_line.join(per_host, "host").filter(F.col("n") > F.greatest(F.lit(float(min_docs)), F.col("n_docs") * max_share)).select("host", "h")


def removed_lines(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, copies: bool = False) -> DataFrame:
    """For each host and text that loses lines: host (struct), f1, f2, removed_words, removed (line numbers)."""
    lines, _ = materialize(line_table(docs), "lines")
    above = frequent_lines(lines, min_docs, max_share, copies)
    hit = salted_join(lines.withColumn("host", F.struct("host")), above, ["host", "h"], F.col("f1"))
    return hit.groupBy("host", "f1", "f2").agg(F.sum("w").alias("removed_words"), F.collect_list("idx").alias("removed"))


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, with_text: bool = False, copies: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, the base statistics, base_failed, kept and removed_words.

    with_text also carries the input row (``doc``) and its text without the removed lines (``clean_text``).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    f1, f2 = fingerprint(text)
    stats = docs.select("doc_id", F.struct(F.col("source").alias("host")).alias("host"), f1.alias("f1"), f2.alias("f2"), base_stats(text).alias("s"), *([F.struct("*").alias("doc")] if with_text else []))
    found = removed_lines(docs, min_docs, max_share, copies)
    if not with_text:
        found = found.drop("removed")
    # a text with very many copies makes a skewed partition, which adaptive execution splits
    out = stats.join(found, ["host", "f1", "f2"], "left")
    n, again = F.col("s.n_words"), F.col("s.n_repeat_words")
    gone = F.coalesce(F.col("removed_words"), F.lit(0)).cast("long")
    failed = (n < MIN_WORDS) | (100 * again > MAX_REPEAT_PERCENT * n)
    cols = ["doc_id", *[F.col(f"s.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]]
    # one comparison over both sides of the join, which says nothing on nulls: a filter on it is not taken apart and pushed
    # to where it would have the statistics of each text made twice
    kept = F.coalesce((n - gone) >= F.when(failed, n + 1).otherwise(min_left * n), F.lit(False))
    cols += [failed.alias("base_failed"), kept.alias("kept"), gone.alias("removed_words")]
    if with_text:
        cols += ["doc", F.when(F.col("removed").isNull(), F.col("doc.text")).otherwise(kept_lines(F.col("doc.text"), F.col("removed"))).alias("clean_text")]
    return out.select(*cols)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline form: rejected documents go, lines above the limit leave the text; the input's columns stay.

    ``n_chars``, where there is such a column, follows the text.
    """
    kept = judge(docs, with_text=True).filter("kept")
    return kept.select(*[_column(c, "clean_text") for c in docs.columns])


def _column(name: str, text: str) -> Column:
    if name == "text":
        return F.col(text).alias("text")
    if name == "n_chars":
        return F.length(text).cast("long").alias("n_chars")
    return F.col(f"doc.`{name}`").alias(name)


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
wd AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, text FROM d),
wn AS (SELECT doc_id, w, i, array_to_string(w[i : i + 7], ' ') AS win FROM wd, unnest(range(1, len(w) - 6)) AS r(i)),
rp AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wn) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rp) GROUP BY doc_id),
ln AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY doc_id),
host AS (SELECT source, count(DISTINCT text) AS nd FROM lw GROUP BY source),
freq AS (SELECT source, norm, count(DISTINCT text) AS n FROM lw GROUP BY source, norm),
above AS (SELECT source, norm FROM freq JOIN host USING (source) WHERE n > greatest(10, 0.02 * nd)),
gone AS (SELECT doc_id, sum(w) AS removed_words FROM lw JOIN above USING (source, norm) GROUP BY doc_id),
st AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
       FROM wd LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND (n_words - removed_words) >= 0.3 * n_words) AS kept,
  CAST(removed_words AS BIGINT) AS removed_words
FROM st
"""


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    from veilframe.llm.util import table

    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
