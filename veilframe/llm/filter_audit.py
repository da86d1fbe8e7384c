"""Filter interaction audit: what each of several filters removes, in every order, from a packed bitmap index.

Each document has one bit for each filter that it fails and for each label that it has.  ``bitmap_index`` packs these bits
into NumPy bitsets, a row for each part and block of documents, where they lie.  ``subset_counts`` takes, for each set of
filters applied before and each filter applied next, the popcounts of AND and AND-NOT of bitsets, and sums them over the
blocks; ``audit`` reads every order of the filters off those sums, of which there are 2^(n-1) n for a part, whatever the
number of documents.

That a text repeats an earlier one is settled without gathering copies: the least id of each text is aggregated, and a
document passes where its own id and text are among those.

Defined cases: null text is empty text; a null part is the empty string; a null doc_id is not larger than any other and
repeats nothing, and is not the smaller id of others; rows of one id and one text are no copies of one another; several
labels of one id count as 1 where any is 1, and ids without labels have none; a very long text is a row like any other; an
empty table gives no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.util import fingerprint, let, materialize, ship, table, words

#: Failure conditions of the five filters, and the labels whose documents are counted.
FILTERS = "ABCDE"
LABELS = ("good", "toxic")
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 3
SYMBOLS = r"[#$%&*|]"


def text_fails(text: Column) -> Column:
    """The bits of A to D of a text without nulls."""
    bit = lambda cond, k: F.when(cond, F.lit(1 << k)).otherwise(F.lit(0))
    counts = lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    of_words = let(let(words(text), counts), lambda c: bit(c["n"] < MIN_WORDS, 0) + bit(100 * c["d"] < MIN_DISTINCT_PERCENT * c["n"], 1))
    return of_words + bit(100 * capitals > MAX_CAPITAL_PERCENT * F.length(text), 2) + bit(text.rlike(SYMBOLS), 3)


def facts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part and bits of each document: five bits of filters, then one for each label."""
    text = F.coalesce(F.col("text"), F.lit(""))
    f1, f2 = fingerprint(text)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), f1.alias("f1"), f2.alias("f2"), text_fails(text).alias("bits"))
    rows, _ = materialize(rows, "audit-facts")
    firsts = rows.filter("id IS NOT NULL").groupBy("f1", "f2").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id"))
    marks = marks.agg((F.max(F.when(F.col("quality") == 1, 32).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, 64).otherwise(0))).alias("marks"))
    repeats = F.when(F.col("id").isNull() | F.col("first"), 0).otherwise(16)
    out = rows.join(firsts, ["id", "f1", "f2"], "left").join(marks, "id", "left")
    return out.select("part", (F.col("bits") + repeats + F.coalesce("marks", F.lit(0))).cast("int").alias("bits"))


def bitmap_index(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """part, n and one packed bitset for each name, from rows of part and bits (bit k belongs to names[k])."""
    ship(rows.sparkSession)

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("part").dictionary_encode()
            at, bits = codes.indices.to_numpy(zero_copy_only=False), batch.column("bits").to_numpy(zero_copy_only=False)
            found = np.unique(at)
            blocks = [bits[at == k] for k in found]
            sets = [pa.array([np.packbits(b >> k & 1).tobytes() for b in blocks], pa.binary()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(found)), pa.array([len(b) for b in blocks], pa.int64()), *sets], names=["part", "n", *(f"b_{x}" for x in names)])

    return rows.select("part", "bits").mapInArrow(pack, "part string, n long, " + ", ".join(f"b_{x} binary" for x in names))


_COUNTS = ("kept", "removed", "redundant", "unique_fails", *(f"{x}_lost" for x in LABELS))


def subset_counts(index: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, subset (bits of the filters applied before), filter and the counts of the documents."""
    ship(index.sparkSession)

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        pop = lambda x: int(np.bitwise_count(x).sum())
        n = len(filters)
        for batch in batches:
            total: dict[tuple, np.ndarray] = {}
            for row in batch.to_pylist():
                fails = [np.frombuffer(row[f"b_{x}"], np.uint8) for x in filters]
                marks = [np.frombuffer(row[f"b_{x}"], np.uint8) for x in LABELS]
                union = [np.zeros_like(fails[0])]
                for s in range(1, 1 << n):
                    low = (s & -s).bit_length() - 1
                    union.append(union[s & (s - 1)] | fails[low])
                gone = [pop(u) for u in union]
                for k, fail in enumerate(fails):
                    alone = pop(fail & ~union[((1 << n) - 1) ^ (1 << k)])
                    for s in range(1 << n):
                        if s >> k & 1:
                            continue
                        here = fail & ~union[s]
                        out = np.array([row["n"] - gone[s | 1 << k], pop(here), pop(fail & union[s]), alone, *(pop(here & m) for m in marks)], np.int64)
                        key = (row["part"], s, k)
                        total[key] = total[key] + out if key in total else out
            if total:
                parts, subset, which = zip(*total)
                sums = np.array(list(total.values()))
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(subset, pa.int32()), pa.array(which, pa.int32()), *(pa.array(sums[:, j]) for j in range(len(_COUNTS)))], names=["part", "subset", "which", *_COUNTS])

    got = index.mapInArrow(count, "part string, subset int, which int, " + ", ".join(f"{c} long" for c in _COUNTS))
    return got.groupBy("part", "subset", "which").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from the sums of ``subset_counts``."""
    n, steps = len(filters), []
    for order in permutations(range(n)):
        before = 0
        for step, k in enumerate(order):
            steps.append(("".join(filters[j] for j in order), step + 1, before, k))
            before |= 1 << k
    plan = counts.sparkSession.createDataFrame(steps, "filter_order string, step int, subset int, which int")
    times = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.bit_count("subset") + 1)
    shapley = counts.groupBy("part", "which").agg(F.sum(F.col("removed") * times).alias("shapley"))
    # as many rows as orders times steps, whatever the input
    return counts.join(shapley, ["part", "which"]).join(F.broadcast(plan), ["subset", "which"]).select("part", "filter_order", "step", *_COUNTS, "shapley")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS t FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(q, 0) AS q, coalesce(t, 0) AS t, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
        100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS f
      FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, f, q, t, count(*) AS n FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || e.c || h.c || i.c AS filter_order FROM x a, x b, x e, x h, x i
      WHERE len(list_distinct([a.c, b.c, e.c, h.c, i.c])) = 5),
s AS (SELECT filter_order, step, instr('ABCDE', substr(filter_order, step, 1)) AS k,
        list_transform(range(1, step), lambda j: instr('ABCDE', substr(filter_order, j, 1))) AS before
      FROM o, unnest(range(1, 6)) AS r(step)),
c AS (SELECT part, filter_order, step, k, n, q, t, f[k] AS fails, len(list_filter(before, lambda j: f[j])) > 0 AS gone,
        len(list_filter(f, lambda y: y)) AS many FROM g, s),
a AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, k,
        CAST(sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS BIGINT) AS kept,
        CAST(sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS BIGINT) AS removed,
        CAST(sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS BIGINT) AS redundant,
        CAST(sum(CASE WHEN fails AND many = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
        CAST(sum(CASE WHEN NOT gone AND fails AND q = 1 THEN n ELSE 0 END) AS BIGINT) AS good_lost,
        CAST(sum(CASE WHEN NOT gone AND fails AND t = 1 THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
      FROM c GROUP BY part, filter_order, step, k)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM a
"""


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    rows = facts(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    index, _ = materialize(bitmap_index(rows, (*FILTERS, *LABELS)), "audit-index")
    return audit(subset_counts(index))
