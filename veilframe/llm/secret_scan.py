r"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of its UTF-8 bytes).  The ledger is a table of (blob, rule
version) pairs already scanned and a table of their findings.  A scan takes the distinct blobs of its input, leaves out
the pairs that the ledger has, finds spans in the rest and appends both tables; findings are joined back to all paths
that hold the blob.

Kinds, in order: ``assign`` (a keyword, ``:`` or ``=``, a value of six or more characters), ``access`` (AKIA and 16 or
more), ``hex`` (24 or more), and beyond these base kinds ``jwt`` (three base64url parts), ``pem`` (a private key's
opening line) and ``vendor`` (tokens with a well-known prefix).  Matches of a kind are leftmost and do not overlap;
failing ones (too short) are dropped after matching, so they still use up their characters.

Defined cases: null text is empty text and has no spans; equal texts share one scan; a very long text is scanned whole;
empty tables give empty results; other columns are not looked at, whatever their names; ties in start are ordered by kind as listed; positions are code points, the end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.util import expire, let, remove, salted_join, scratch, table
from veilframe.operators.spans import placed

#: Fixed by the contract: (kind, pattern, least length, group that the length is of).
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]+", 24, 0),
)
MORE = (
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, 0),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("vendor", r"(?:gh[pousr]_|xox[abprs]-|sk_live_|rk_live_|glpat-|AIza)[A-Za-z0-9_-]+", 20, 0),
)
KINDS = BASE + MORE
#: Names the patterns above; any change of them needs another name, so that old pairs of the ledger do not count.
RULE_VERSION = "base3+more3/1"
#: A run this long is needed for hex to match at all; cheaper to look for than every run.
_PRESENT = {"assign": KINDS[0][1], "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}", "jwt": "eyJ[A-Za-z0-9_-]+[.]", "pem": "-----BEGIN ", "vendor": "(?:gh[pousr]_|xox[abprs]-|sk_live_|rk_live_|glpat-|AIza)"}
SPAN = "array<struct<s:int,k:int,e:int>>"


def spans_of(text: Column, order: int) -> Column:
    """The spans of one kind: the texts between matches give the starts, the matches the lengths."""
    kind, pattern, least, group = KINDS[order]
    pattern_col = F.lit(pattern)

    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    lens = F.transform(F.regexp_extract_all(text, pattern_col, 0), lambda g: F.length(g))
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), lens.alias("len")), lambda x: x["len"].isNotNull())
    vals = lens if group == 0 else F.transform(F.regexp_extract_all(text, pattern_col, group), lambda g: F.length(g))
    fits = F.filter(F.arrays_zip(placed(pairs, skip=True).alias("at"), vals.alias("val")), lambda x: x["val"] >= least)
    found = F.transform(fits, lambda x: F.struct(x["at"]["s"].alias("s"), F.lit(order).alias("k"), x["at"]["e"].alias("e")))
    # a kind that is nowhere in the text costs one search only
    return F.when(text.rlike(_PRESENT[kind]), found).otherwise(F.array().cast(SPAN))


def all_spans(text: Column) -> Column:
    """Spans of all kinds by start, then kind."""
    return F.sort_array(F.concat(*[spans_of(text, k) for k in range(len(KINDS))]))


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _join(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


class Ledger:
    """The two tables of the ledger under one folder, in storage that all executors share."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", "blob string, rule_version string")

    def findings(self) -> DataFrame:
        return self._read("findings", f"blob string, rule_version string, found {SPAN}")

    def scan(self, versions: DataFrame, rule_version: str = RULE_VERSION) -> int:
        """Scans the texts of ``versions`` (column text) that this ledger has not yet seen under rule_version."""
        seen = self.scanned().filter(F.col("rule_version") == rule_version).select("blob")
        text = F.coalesce(F.col("text"), F.lit(""))
        # Equal blobs are equal texts, so whichever copy comes first will do; copies merge before the shuffle.
        blobs = versions.select(blob_id(text).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
        done = blobs.join(seen, "blob", "left_anti").select("blob", F.lit(rule_version).alias("rule_version"), all_spans(F.col("text")).alias("found"))
        batch = scratch(self.spark, "ledger-batch")
        done.write.option("compression", "zstd").parquet(batch)
        fresh = self.spark.read.parquet(batch)
        # Findings first: a job lost in between leaves unscanned pairs, which the next scan takes again.
        fresh.filter(F.size("found") > 0).write.mode("append").parquet(f"{self.path}/findings")
        fresh.select("blob", "rule_version").write.mode("append").parquet(f"{self.path}/scanned")
        remove(self.spark, batch)
        return 0

    def findings_of(self, rule_version: str = RULE_VERSION) -> DataFrame:
        # a scan that was repeated after a loss may have left a finding twice
        return self.findings().filter(F.col("rule_version") == rule_version).groupBy("blob").agg(F.first("found").alias("found"))


def scan_documents(docs: DataFrame, ledger_path: str | None = None, whole: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id and ``found``, the spans of its text by the ledger at ledger_path (or a new
    one); with ``whole`` also ``doc``, the row as a struct."""
    spark = docs.sparkSession
    path = ledger_path or scratch(spark, "ledger")
    ledger = Ledger(spark, path)
    ledger.scan(docs.select("text"))
    if ledger_path is None:
        expire(spark, path)
    paths = docs.select("doc_id", *([F.struct("*").alias("doc")] if whole else []), blob_id(F.col("text")).alias("blob"))
    joined = salted_join(paths, ledger.findings_of(), ["blob"], F.col("doc_id"), "left").drop("blob")  # copies of one blob may be many
    return joined.withColumn("found", F.coalesce("found", F.array().cast(SPAN)))


def op10_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("found", lambda x: x["k"] < len(BASE))
    count = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{BASE[k][0]}") for k in range(len(BASE))],
        F.sha2(_join(base), 256).alias("base_sha256"),
        _join(F.col("found")).alias("spans"),
    )


def masked(text: Column, found: Column) -> Column:
    """The text with every span replaced by ``[kind]``; overlapping spans become one, named by the first of them."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])

    def step(acc: Column, x: Column) -> Column:
        over = x["s"] < acc["at"]
        return F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.when(over, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["at"].alias("a"), x["s"].alias("b"), names[x["k"]].alias("n"))))).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int,n:string>>").alias("out"))
    parts = F.aggregate(found, zero, step)
    return let(parts, lambda p: F.concat(F.array_join(F.transform(p["out"], lambda x: F.concat(F.substring(text, x["a"] + 1, x["b"] - x["a"]), F.lit("["), x["n"], F.lit("]"))), ""), F.substring(text, p["at"] + 1, F.length(text))))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline form: spans are masked in the texts; every row and the input's columns stay."""
    out, text = scan_documents(docs, whole=True), F.col("doc.text")
    new = F.when(F.size("found") > 0, masked(text, F.col("found"))).otherwise(text)
    n_chars = F.when(F.size("found") > 0, F.length(new).cast("long")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None
    own = {"text": new, "n_chars": n_chars}
    return out.select(*[own[c].alias(c) if c in own else F.col(f"doc.`{c}`") for c in docs.columns])


def _sql() -> str:
    """The same in SQL: gaps between matches give the starts."""
    parts = []
    for order, (_, pattern, least, group) in enumerate(KINDS):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"SELECT doc_id, {order} AS k, string_split_regex(text, {p}) AS g, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {group}) AS v, {least} AS least FROM d")
    names = "[" + ", ".join(f"'{k[0]}'" for k in KINDS) + "]"
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{BASE[k][0]}" for k in range(len(BASE)))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), a AS ({' UNION ALL '.join(parts)}),
s AS (SELECT doc_id, k, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s, length(m[i]) AS n FROM a, unnest(range(1, len(m) + 1)) AS r(i) WHERE length(v[i]) >= least),
t AS (SELECT doc_id, k, s, ({names})[k + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS span FROM s)
SELECT doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY s, k) FILTER (k < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY s, k), '') AS spans
FROM d LEFT JOIN t USING (doc_id) GROUP BY doc_id"""


SQL = _sql()
