"""Reading tables, cutting lineage in the shared folder, and a few expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.kept import expire, materialize, scratch, shared_dir, shuffles_removed
from veilframe.ship import ship

#: The word separators of all contracts: space and the five ASCII controls from tab to carriage return.
WS_CLASS = r"[ \x09-\x0D]+"
NON_WS = r"[^ \x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that no returned DataFrame reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


__all__ = ["NON_WS", "WS_CLASS", "expire", "fingerprint", "kept_lines", "let", "materialize", "remove", "salted_join", "scratch", "shared_dir", "ship", "shuffles_removed", "table", "words"]


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, even where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The maximal runs of non-white-space of a text (no nulls in)."""
    return F.array_remove(F.split(text, WS_CLASS), "")


def fingerprint(*cols: Column) -> list[Column]:
    """128 bits of a value, as two longs."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("veilframe"), *cols)]


#: Tasks that the rows of one key are dealt to.
SALTS = 16


def kept_lines(text: Column, removed: Column) -> Column:
    """The text without the lines whose numbers are in removed."""

    def rest(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
        return F.array_join(F.transform(stay, lambda i: lines[i]), "\n")

    return let(F.split(text, "\n"), rest)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """big joined with small, whose keys are unique, so that a key with a third of all rows fills no single task."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
