"""Detection quality by group, slices, counters and latencies."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVAL_SCHEMA = "text string, category string, entities array<struct<token:string,start:long,end:long,label:string>>"


def read_eval(spark, path: str) -> DataFrame:
    """JSON lines; lines that are not records are left out."""
    rows = spark.read.schema(EVAL_SCHEMA + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter("_bad IS NULL AND text IS NOT NULL").drop("_bad")


def confusion(df: DataFrame, predicted: Column, actual: Column, group: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, recall, precision, f1; nothing to find is full recall, nothing found full precision."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    sums = df.groupBy(*(group or [])).agg(count(predicted & actual).alias("tp"), count(predicted & ~actual).alias("fp"), count(~predicted & actual).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = sums.withColumn("recall", F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)).withColumn("precision", F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0))
    both = F.col("recall") + F.col("precision")
    return out.withColumn("f1", F.when((both > 0) & (tp > 0), 2 * F.col("recall") * F.col("precision") / both).otherwise(0.0))


def entity_recall(df: DataFrame, sanitized: str, entities: str = "entities", group: list[str] | None = None) -> DataFrame:
    """An entity is found when its text is no longer in the output."""
    rows = df.select(*(group or []), F.col(sanitized).alias("_out"), F.explode(entities).alias("e"))
    return confusion(rows, ~F.contains("_out", F.col("e.token")), F.lit(True), group)


def slices(df: DataFrame) -> DataFrame:
    """df (slice_id, sanitized, target_entity?, prefix?, suffix?, n_redactions): scores by slice.

    A target is found if it is gone; lost context around it, or any redaction in a control, is a false positive.
    """
    gone = ~F.contains("sanitized", F.col("target_entity"))
    intact = F.contains("sanitized", F.coalesce("prefix", F.lit(""))) & F.contains("sanitized", F.coalesce("suffix", F.lit("")))
    control = F.col("target_entity").isNull()
    return df.groupBy("slice_id").agg(
        F.sum(F.when(~control & gone, 1).otherwise(0)).cast("long").alias("tp"),
        F.sum(F.when(~control & ~gone, 1).otherwise(0)).cast("long").alias("fn"),
        F.sum(F.when(control, F.col("n_redactions")).otherwise(F.when(~intact, 1).otherwise(0))).cast("long").alias("fp"),
    )


def counters(df: DataFrame, kind: Column) -> DataFrame:
    """Requests by kind, with their line in the text exposition format."""
    n = df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    return n.withColumn("line", F.format_string('requests_total{kind="%s"} %d', "kind", "n"))


def guard_counters(df: DataFrame, status: Column, redactions: Column) -> DataFrame:
    """Guarded requests and redacted entities, with their lines in the text exposition format."""
    sums = df.agg(F.sum(F.when(status != "ok", 1).otherwise(0)).cast("long").alias("injections_blocked_total"), F.coalesce(F.sum(redactions), F.lit(0)).cast("long").alias("pii_entities_redacted_total"))
    names = ("injections_blocked_total", "pii_entities_redacted_total")
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(k, F.lit(0)).alias("n")) for k in names])).alias("r")
    return sums.select(rows).select("r.name", "r.n", F.format_string("%s %d", "r.name", "r.n").alias("line"))


#: Binary digits that a pass over the values tells apart.
DIGIT = 16


def ordered_bits(value: Column) -> Column:
    """A double's 64 bits as a whole number in the same order; both zeros are one."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def from_ordered_bits(key: int) -> float:
    bits = key if key >= 0 else key ^ ((1 << 63) - 1)
    return struct.unpack(">d", struct.pack(">q", bits))[0]


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """For each share the value at place floor(n * share) of the sorted ones, at most the last; None where there are none.

    Radix selection: a pass counts values by the next ``DIGIT`` bits of their ordered bits, among those that agree with a
    wanted place so far, so four passes find all shares exactly, whatever the values; a task holds counts, the driver at
    most 2**DIGIT of them for each share.  Nulls and NaN are no numbers and left out; infinities are.
    """
    v = F.col(value).cast("double")
    keys = df.select(v.alias("v")).filter("v IS NOT NULL AND NOT isnan(v)").select(ordered_bits(F.col("v")).alias("k"))
    found: list[int | None] = [None] * len(shares)
    ranks: list[int] = []
    for left in range(64 - DIGIT, -1, -DIGIT):
        digit = F.shiftright("k", left)
        wanted = keys if left == 64 - DIGIT else keys.filter(F.shiftright("k", left + DIGIT).isin(*sorted(set(found))))
        counts = sorted((r["d"], r["n"]) for r in wanted.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect())
        if not counts:
            return [None] * len(shares)
        if not ranks:
            n = sum(c for _, c in counts)
            ranks = [min(n - 1, int(n * s)) for s in shares]
        for i, prefix in enumerate(found):
            for d, c in counts:
                if prefix is not None and d >> DIGIT != prefix:
                    continue
                if ranks[i] < c:
                    found[i] = d
                    break
                ranks[i] -= c
    return [from_ordered_bits(k) for k in found]


def latencies(df: DataFrame, value: str) -> DataFrame:
    """min, mean, median, p95, p99 and max, as ``quantiles`` has them; nulls and NaN are left out."""
    v = F.col(value).cast("double")
    low, high, mean = df.filter(~F.isnan(v)).agg(F.min(v), F.max(v), F.avg(v)).first()
    row = (low, mean, *quantiles(df, value, [0.5, 0.95, 0.99]), high)
    return df.sparkSession.createDataFrame([row], "min double, mean double, median double, p95 double, p99 double, max double")
