import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Names that the operators use inside.
CLASHING = ("row", "pos", "idx", "host", "h", "s", "w", "name", "c", "q", "band", "label", "rep", "blob", "found", "doc", "f1", "f2", "item", "removed", "clean_text", "kept")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, equal rows and columns with names of our own."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
    line = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone"
    texts = [None, "", " \n\t\n", "a", "a b c d", line, line, line + "\nplus a tail of words", long, long, "password = hunter22 token: abc", "\n".join([line, "x", line]), "é" * 300, "x " * 5000]
    rows = [(i, t, "en", "h1" if i % 3 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [(3, "a", "en", "h1", 1), (None, "null id", None, None, None), (None, "null id", None, None, None), (-5, line.upper(), "en", "h1", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(k).alias(k) for k in CLASHING])


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
