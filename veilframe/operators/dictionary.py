"""Large dictionaries: terms as a table, joined to the places of texts where they may begin.

A term stands in a text with no letter or digit beside it, ASCII case ignored, so each run of letters and digits in a term
is a whole such run (a word) in the text.  Texts give a row for each run of as many words as some term has, if it is as long as
such terms are (``places``), and one join on its whole text is exact.  So no row meets more than one term but for those that
differ in case or in the marks around them, however many terms begin with a frequent word, and the plan is the same for three
terms and for a hundred thousand.  (Inside the Arrow kernel of ``engine`` terms are one automaton in each task; this is for
dictionaries that no task should hold.)

The term table is broadcast while it is at most ``BROADCAST_BYTES`` of text.  Beyond that texts of words are shuffled, with what
stands beside them only if a term begins or ends with such marks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.text import visible
from veilframe.operators.spans import MARK, let, placed
from veilframe.ship import ship

WORD = r"[\p{IsAlphabetic}\p{N}]+"
GAP = r"[^\p{IsAlphabetic}\p{N}]"
BROADCAST_BYTES = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text cut together (one longer text is cut alone), and rows given out together.
CHUNK, ROWS = 1 << 20, 1 << 15
#: Beyond the longest text.
ANY = 2**31 - 1


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def prepared(terms: DataFrame, term: str = "term") -> DataFrame:
    """terms with core (from the first letter or digit to the last), lead and trail (what is before and after it), words (how
    many) and spaced (whether nothing but single spaces is between them).  Terms without a letter or digit have one of their
    own, see ``match_terms``.  Patterns look only at terms that need them: most begin and end with an ASCII letter or digit."""
    low = F.col("_low")
    plain = lambda c: c.between("a", "z") | c.between("0", "9")
    lead = F.when(plain(F.substring(low, 1, 1)), "").otherwise(F.regexp_extract(low, f"^{GAP}*", 0))
    trail = F.when(plain(F.substring(low, -1, 1)) | (F.length("_lead") >= F.length(low)), "").otherwise(F.regexp_extract(low, f"{GAP}*$", 0))
    rows = terms.filter(F.length(term) > 0).withColumn("_low", F.when(F.col(term).rlike("[A-Z]"), ascii_lower(F.col(term))).otherwise(F.col(term)))
    rows = rows.withColumn("_lead", lead).withColumn("_trail", trail)
    core = F.when((F.col("_lead") == "") & (F.col("_trail") == ""), low).otherwise(F.substring(low, F.length("_lead") + 1, F.length(low) - F.length("_lead") - F.length("_trail")))
    rows = rows.withColumn("_core", F.coalesce(core, F.lit(""))).withColumn("_list", F.regexp_extract_all("_core", F.lit(WORD), 0))
    return rows.select("*", F.size("_list").alias("_words"), (F.col("_core") == F.array_join("_list", " ")).alias("_spaced")).drop("_list")


def _edges(spark) -> list[int]:
    """The code points where letters and digits, as Java's patterns have them, begin and end by turns."""
    known = getattr(spark.sparkContext, "_veilframe_edges", None)
    if known is None:
        points = [*range(0xD800), *range(0xE000, 0x110000)]
        kept = spark.sparkContext._jvm.java.util.regex.Pattern.compile(GAP).matcher("".join(map(chr, points))).replaceAll(" ")
        inside = [p for p, c in zip(points, kept) if c != " "]
        known = [p for k, p in enumerate(inside) if not k or inside[k - 1] != p - 1], [p + 1 for k, p in enumerate(inside) if k + 1 == len(inside) or inside[k + 1] != p + 1]
        known = spark.sparkContext._veilframe_edges = [x for pair in zip(*known) for x in pair]
    return known


@cache
def _table(edges: tuple[int, ...]):
    """Whether a code point is a letter or digit."""
    import numpy as np

    flips = np.zeros(0x110001, dtype=np.int8)
    flips[list(edges[::2])], flips[list(edges[1::2])] = 1, -1
    return np.cumsum(flips, dtype=np.int8).astype(bool)


def _cut(batches: Iterator, edges: tuple[int, ...], shapes: list[tuple[int, int, int, bool]], beside: bool) -> Iterator:
    """Runs of words of the last column of each batch, found in a chunk of texts at once."""
    import numpy as np
    import pyarrow as pa

    table = _table(edges)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32

    def strings(data, first, last):
        """Byte ranges of data as an Arrow column."""
        size = last - first
        ends = np.cumsum(size)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        at = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], size)
        return pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])

    for batch in batches:
        keep, texts = batch.columns[:-1], batch.columns[-1].cast(pa.large_string())
        if not len(texts) or texts.buffers()[2] is None:
            continue
        all_ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        # texts are looked at together up to so many bytes
        part = (all_ends[:-1] - all_ends[0]) // CHUNK
        for at, to in zip(cut := np.flatnonzero(np.diff(part, prepend=-1)), np.append(cut[1:], len(texts))):
            offsets = all_ends[at : to + 1] - all_ends[at]
            data = lower[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[all_ends[at] : all_ends[to]]]
            if not len(data):
                continue
            wide = bool((data > 127).any())
            points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4") if wide else data
            spots = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data)) if wide else np.arange(len(data) + 1)  # where characters begin
            bounds = np.searchsorted(spots, offsets) if wide else offsets
            inside = table[points]
            firsts = bounds[:-1][bounds[:-1] < len(points)]
            before, after = np.roll(inside, 1), np.roll(inside, -1)
            before[firsts] = after[firsts - 1] = after[-1] = False
            starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
            rows = np.searchsorted(bounds, starts, side="right") - 1
            single = (starts[1:] - ends[:-1] == 1) & (points[ends[:-1]] == 32)  # a space alone before the next word
            for words, least, most, spaced in shapes:
                if len(starts) < words:
                    continue
                size = ends[words - 1 :] - starts[: len(starts) - words + 1]
                fits = (rows[words - 1 :] == rows[: len(size)]) & (size >= least) & (size <= most)
                for k in range(words - 1 if spaced else 0):
                    fits &= single[k : k + len(fits)]
                found = np.flatnonzero(fits)
                for k in range(0, len(found), ROWS):
                    i = found[k : k + ROWS]
                    j, row = i + words - 1, rows[i]
                    take = pa.array(at + row)
                    first, last = starts[i], ends[j]
                    out = [*(c.take(take) for c in keep), strings(data, spots[first], spots[last]), *(pa.array(x.astype(np.int32)) for x in (first - bounds[row], ends[i] - first, last - starts[j]))]
                    if beside:
                        begins, stops = (i == 0) | (rows[i - 1] != row), (j + 1 == len(rows)) | (rows[(j + 1) % len(rows)] != row)
                        left, right = np.where(begins, bounds[row], ends[i - 1]), np.where(stops, bounds[row + 1], starts[(j + 1) % len(rows)])
                        out += [strings(data, spots[left], spots[first]), pa.array(begins), strings(data, spots[last], spots[right]), pa.array(stops)]
                    yield pa.RecordBatch.from_arrays(out, names=[str(c) for c in range(len(out))])


def places(df: DataFrame, column: str, shapes: list[tuple[int, int, int, bool]], beside: bool = False) -> DataFrame:
    """A row for each run of words of a text with a shape (words, least and most characters from its first to its last, whether
    only single spaces may be between them): the other columns, _core (the run in lower case, with what is between its words),
    _start, _head and _tail (how long its first and its last word are), and with beside _before, _at_start, _after and _at_end (what stands between it and the word before, whether that
    begins the text; the same behind)."""
    spark, others = df.sparkSession, [c for c in df.columns if c != column]
    ship(spark)
    rows = df.select(*[F.col(f"`{c}`") for c in others], F.make_valid_utf8(F.coalesce(F.col(f"`{column}`"), F.lit(""))))
    more = "_core string, _start int, _head int, _tail int" + ", _before string, _at_start boolean, _after string, _at_end boolean" * beside
    schema = T.StructType(rows.schema.fields[:-1] + T.StructType.fromDDL(more).fields)
    numbered = T.StructType([T.StructField(str(k), f.dataType, True) for k, f in enumerate(schema.fields)])
    edges = tuple(_edges(spark))
    return rows.mapInArrow(lambda it: _cut(it, edges, shapes, beside), numbered).toDF(*schema.names)


def match_terms(df: DataFrame, terms: DataFrame, column: str = "text", term: str = "term", broadcast_bytes: int = BROADCAST_BYTES, core: str | None = None) -> DataFrame:
    """A row for each place of each term: df's other columns, those of terms, s and e (code points of the visible text, e
    exclusive).

    Overlapping places all count; terms that differ in ASCII case alone are each found.  Null and empty terms are found
    nowhere, null texts hold nothing.

    core: the name of one more column, by which the rows of a large dictionary lie (what a term has from its first letter or
    digit to its last one, in lower case); rows grouped by it and other columns are not shuffled again.
    """
    df, known = df.withColumn(column, visible(F.col(f"`{column}`"))), prepared(terms, term)
    least, most, beside_, spaced = F.min(F.length("_core")), F.max(F.length("_core")), F.max(F.length("_lead") + F.length("_trail")) > 0, F.min("_spaced")
    sizes = known.groupBy("_words").agg(least.alias("least"), most.alias("most"), spaced.alias("spaced"), beside_.alias("beside"), F.sum(F.octet_length(term)).alias("bytes")).collect()
    small, marks = sum(x["bytes"] for x in sizes) <= broadcast_bytes, any(not x["_words"] for x in sizes)
    sent = F.broadcast if small else (lambda x: x)
    keep, of_terms = [f"`{c}`" for c in df.columns if c != column], [F.col(f"_t.`{c}`").alias(c) for c in terms.columns]
    row = F.struct(*[F.col(f"`{c}`") for c in terms.columns]).alias("_t")
    shapes = sorted((x["_words"], x["least"], x["most"], x["spaced"]) for x in sizes if x["_words"])
    beside = any(x["beside"] for x in sizes if x["_words"])
    rows = places(df, column, shapes, beside)
    if not beside:
        rows = rows.withColumns({"_before": F.lit(""), "_at_start": F.lit(True), "_after": F.lit(""), "_at_end": F.lit(True)})
    # a term without a word has an empty core, which no place has; a filter here would work out all cores once more
    found = rows.join(sent(known.select("_core", "_lead", "_trail", row)), "_core")
    # a lead must fit between this word and the one before, with something else between, or begin the text
    before = (F.col("_lead") == "") | (F.endswith("_before", F.col("_lead")) & (F.col("_at_start") | (F.length("_before") > F.length("_lead"))))
    after = (F.col("_trail") == "") | (F.startswith("_after", F.col("_trail")) & (F.col("_at_end") | (F.length("_after") > F.length("_trail"))))
    s = F.col("_start") - F.length("_lead")
    by_core = [F.col("_core").alias(core)] if core else []
    out = found.filter(before & after).select(*keep, *of_terms, *by_core, s.alias("s"), (F.col("_start") + F.length("_core") + F.length("_trail")).alias("e"))
    if marks:
        out = out.unionByName(_marks(df, known.filter("_words = 0").select(ascii_lower(F.col(term)).alias("_core"), row), column, sent, keep, of_terms, by_core))
    return out


def _marks(df: DataFrame, marks: DataFrame, column: str, sent, keep: list[str], of_terms: list[Column], by_core: list[Column]) -> DataFrame:
    """Places of terms without a letter or digit: inside what stands between two words, by their lengths."""
    text = F.coalesce(F.col(column), F.lit(""))
    marked = F.split(F.regexp_replace(text, f"({GAP}+)", f"{MARK}$1{MARK}"), MARK)  # words and gaps by turns
    runs = let(marked, lambda p: F.transform(p, lambda x: F.struct(x.alias("x"), F.length(x).alias("len"))))
    starts = let(runs, lambda r: F.zip_with(r, placed(F.transform(r, lambda x: F.struct(F.lit(0).alias("gap"), x["len"].alias("len"))), skip=True), lambda x, at: x.withField("s", at["s"])))
    gaps = df.select(*keep, F.length(text).alias("_size"), F.explode(F.filter(starts, lambda x: x["x"].rlike(f"^{GAP}"))).alias("_g"))
    lengths = marks.select(F.substring("_core", 1, 1).alias("_char"), F.length("_core").alias("_len")).groupBy("_char").agg(F.collect_set("_len").alias("_lens"))
    chars = gaps.select(*keep, "_size", "_g", F.posexplode(F.split("_g.x", "")).alias("_i", "_char")).join(sent(lengths), "_char").select(*keep, "_size", "_g", "_i", F.explode("_lens").alias("_len"))
    # one more character must stand on either side, unless the text begins or ends there
    inside = ((F.col("_i") > 0) | (F.col("_g.s") == 0)) & ((F.col("_i") + F.col("_len") < F.col("_g.len")) | ((F.col("_g.s") + F.col("_i") + F.col("_len") == F.col("_size"))))
    s = F.col("_g.s") + F.col("_i")
    rows = chars.filter(inside).withColumn("_core", F.substring(F.col("_g.x"), F.col("_i") + 1, F.col("_len")))
    return rows.join(sent(marks), "_core").select(*keep, *of_terms, *by_core, s.alias("s"), (s + F.col("_len")).alias("e"))
