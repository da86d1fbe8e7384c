"""N-gram Jaccard join with Bayesian candidate pruning.

Two texts are linked when the Jaccard similarity of their sets of five-word shingles (words are split at white space,
lower-cased A-Z) is at least 0.8.  Texts with equal sets are copies; one of them stands for all.

1. Each text gets MinHash values in one pass; copies merge by a fingerprint of the set (map-side first).
2. Bands of MinHash values make buckets; each bucket links its members to its smallest one, which is linear in the
   bucket's size.  The components of these links hold every pair that shares a bucket.
3. Each component is dealt into blocks by hash, and every pair of blocks is compared on its own: a task never holds more
   than two blocks, however large the component.  MinHash values are compared step by step; a pair is dropped once the
   posterior probability (uniform prior) that its similarity reaches the threshold is below ``TOLERANCE``.  What is left
   is verified exactly on the shingle sets.  A pair of blocks returns a number of links and a label for each member, not
   pairs, so that a group of n near copies costs rows in proportion to n (times its blocks), not to n squared.
4. Labels merge into classes (connected components of the exact links).

The chance that a pair at the threshold shares no bucket is (1 - 0.8^4)^24 = 3e-6, and less for closer pairs.

Defined cases: null text is empty text; a text of fewer than five words has one shingle, all its words; texts without
words have no links and are classes of their own; a very long text makes its block smaller; a pair at exactly 0.8 is
linked; other columns are not looked at, whatever their names; an empty table gives no rows; a text's row counts its copies (other rows with the same set) and the
rows linked to it as ``n_links``; null and repeated ids are kept, and the class id is the least row id of the class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.util import materialize, remove, salted_join, ship, table

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
#: Texts of a block, and the words they may have together on average: long texts make smaller blocks.
BLOCK = 256
#: Texts that a task compares, on average; two blocks of a large component may make it more.
TASK_ROWS = 1024


def _multipliers():
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(7))
    return rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def shingles(buf, offsets):
    """(shingle hashes, how many of each text), with repeats."""
    import numpy as np

    from veilframe.llm import kernel as K

    hashes, counts, _ = K.word_hashes(buf, offsets, lower=True)
    win, n = K.windows(hashes, counts, WIDTH)
    short = (counts > 0) & (counts < WIDTH)
    if not short.any():
        return win, n
    # texts of one to four words: a single shingle of all of them
    firsts = np.cumsum(counts) - counts
    whole = np.zeros(len(counts), np.uint64)
    for k in range(WIDTH - 1):
        more = short & (counts > k)
        whole[more] = whole[more] * np.uint64(0x2545F4914F6CDD1D) + hashes[firsts[more] + k] + np.uint64(1)
    whole = K.mix(whole)
    at = np.cumsum(n) - n
    return np.insert(win, at[short], whole[short]), n + short


def signatures(sh, n):
    """MinHash values (texts x HASHES, 32 bits) of the texts with shingles."""
    import numpy as np

    mult, add = _multipliers()
    has = n > 0
    firsts = (np.cumsum(n) - n)[has]
    out = np.empty((int(has.sum()), HASHES), np.uint32)
    if len(firsts):
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(((sh ^ add[k]) * mult[k]) >> np.uint64(32), firsts)
    return out, has


def set_fingerprints(sh, n):
    """128 bits of each text's set of shingles: two sums over its distinct shingles."""
    import numpy as np

    from veilframe.llm import kernel as K

    row = K.rows_of(n)
    order = np.lexsort((sh, row))
    s, r = sh[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    s, r = s[new], r[new]
    out = np.zeros((2, len(n)), np.uint64)
    if len(s):
        firsts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        for k, salt in enumerate((0x1234567, 0x89ABCDEF01)):
            out[k, r[firsts]] = np.add.reduceat(K.mix(s ^ np.uint64(salt)), firsts)
    return out.view(np.int64)


def _sign(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    from veilframe.llm import kernel as K

    for batch in batches:
        for at, rows, buf, offsets in K.chunks(batch.column("text")):
            sh, n = shingles(buf, offsets)
            sig, has = signatures(sh, n)
            low = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
            h = np.zeros(low.shape[:2], np.uint64)
            for k in range(ROWS):
                h = h * np.uint64(0x9FB21C651E98DF25) + low[:, :, k] + np.uint64(k + 1)
            bands = K.mix(h + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            f = set_fingerprints(sh, n)
            lens = np.where(has, BANDS, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lens)].astype(np.int32)), pa.array(bands.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, rows), pa.array(f[0]), pa.array(f[1]), pa.array(n.astype(np.int64)), lists], names=["row", "f1", "f2", "n", "bands"])


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest matches among n hashes with which a pair stays.

    With a uniform prior the posterior is Beta(m+1, n-m+1); its mass above t is P(Binomial(n+1, t) <= m).
    """
    mass = 0.0
    for m in range(n + 1):
        mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if mass >= tolerance:
            return m
    return n


def _components(n: int, a, b):
    """The least member of each one's component, for pairs a, b."""
    import numpy as np

    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _exact(sh, n, a, b, threshold: float):
    """Which of the pairs (a, b) of texts reach the threshold, by their sets."""
    import numpy as np

    firsts = np.cumsum(n) - n
    sets = {}

    def of(k):
        if k not in sets:
            sets[k] = np.unique(sh[firsts[k] : firsts[k] + n[k]])
        return sets[k]

    used = np.unique(np.r_[a, b])
    sizes = np.zeros(len(n), np.int64)
    for k in used:
        sizes[k] = len(of(int(k)))
    if len(a) <= 8 * len(used):
        both = np.array([len(np.intersect1d(of(int(x)), of(int(y)), assume_unique=True)) for x, y in zip(a, b)], np.int64)
    else:  # many pairs: intersections of all, by slices of the shingles that two texts or more have
        at = {int(k): i for i, k in enumerate(used)}
        values = np.concatenate([of(int(k)) for k in used])
        owner = np.repeat(np.arange(len(used)), [len(of(int(k))) for k in used])
        distinct, code, times = np.unique(values, return_inverse=True, return_counts=True)
        rank = np.cumsum(times > 1) - 1
        keep = times[code] > 1
        code, owner = rank[code[keep]], owner[keep]
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        total = np.zeros((len(used), len(used)), np.float32)
        slice_ = 4096
        for lo in range(0, int(rank[-1]) + 1 if len(rank) else 0, slice_):
            i, j = np.searchsorted(code, [lo, lo + slice_])
            part = np.zeros((len(used), slice_), np.float32)
            part[owner[i:j], code[i:j] - lo] = 1
            total += part @ part.T
        both = np.rint(total[[at[int(x)] for x in a], [at[int(y)] for y in b]]).astype(np.int64)
    # as integers where the threshold is a fraction of ten, so that a pair at exactly 0.8 is in
    union = sizes[a] + sizes[b] - both
    return both * 10_000 >= round(threshold * 10_000) * union


def compare_blocks(texts, own, other, threshold: float = THRESHOLD):
    """Links between own and other texts (masks; equal masks: all pairs): (a, b) with a < b."""
    import numpy as np
    import pyarrow as pa

    from veilframe.llm import kernel as K

    parts = [shingles(buf, offsets) for _, _, buf, offsets in K.chunks(pa.array(texts, pa.string()))]
    sh, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    sig, has = signatures(sh, n)
    assert has.all()
    left, right = np.flatnonzero(own), np.flatnonzero(other)
    a, b = np.repeat(left, len(right)), np.tile(right, len(left))
    first = a < b if (own == other).all() else a != b
    a, b = a[first], b[first]
    # the set sizes bound the similarity: |A| / |B| >= threshold is needed, and shingles with repeats bound |A|
    matched = np.zeros(len(a), np.int32)
    for at in range(0, HASHES, STEP):
        matched += (sig[a, at : at + STEP] == sig[b, at : at + STEP]).sum(axis=1)
        stay = matched >= least_matches(at + STEP, threshold)
        a, b, matched = a[stay], b[stay], matched[stay]
    if len(a):
        ok = _exact(sh, n, a, b, threshold)
        a, b = a[ok], b[ok]
    return np.minimum(a, b), np.maximum(a, b)


def _pair_of_blocks(threshold: float):
    def run(pdf):
        import numpy as np
        import pandas as pd

        p, q = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
        block, copies, rep = pdf["block"].to_numpy(), pdf["copies"].to_numpy(), pdf["rep"].to_numpy()
        order = np.argsort(rep, kind="stable")
        block, copies, rep = block[order], copies[order], rep[order]
        a, b = compare_blocks(pdf["text"].fillna("").to_numpy()[order].tolist(), block == p, block == q, threshold)
        links, others = np.zeros(len(rep), np.int64), np.zeros(len(rep), np.int64)
        for x, y in ((a, b), (b, a)):
            np.add.at(links, x, copies[y])
            np.add.at(others, x, 1)
        label = rep[_components(len(rep), a, b)]
        return pd.DataFrame({"rep": rep, "label": label, "links": links, "texts": others})

    return run


def components(edges: DataFrame, nodes_tag: str = "cc") -> DataFrame:
    """Connected components of edges (a, b): node, label (the least node), for nodes with an edge.

    Each round takes every node to the least label of its neighbours, then to that label's own label, and writes the
    result to the shared folder, until nothing changes.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both, both_path = materialize(both, nodes_tag)
    labels, path = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), nodes_tag)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = low.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
        step, step_path = materialize(jump.select("node", F.least("label", F.coalesce("next", "label")).alias("label"), (F.col("old") != F.least("label", F.coalesce("next", "label"))).alias("moved")), nodes_tag)
        remove(spark, path)
        labels, path = step.select("node", "label"), step_path
        if step.filter("moved").isEmpty():
            remove(spark, both_path)
            return labels


def classes(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """For each row of docs (columns row: a unique long, text): row, class_row, copies, links, texts.

    copies: rows with the same set of shingles, itself included; links: rows of other sets that are linked to it;
    texts: how many other sets these are.
    """
    spark = docs.sparkSession
    ship(spark)
    signed, _ = materialize(docs.select("row", "text").mapInArrow(_sign, "row long, f1 long, f2 long, n long, bands array<long>"), "signed")
    some = signed.filter("n > 0")
    sets, _ = materialize(some.groupBy("f1", "f2").agg(F.min("row").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n")), "sets")
    placed = some.join(sets.select("rep"), some["row"] == sets["rep"], "left_semi").select(F.col("row").alias("rep"), F.explode("bands").alias("band"))
    buckets = placed.groupBy("band").agg(F.count("*").alias("m"), F.min("rep").alias("first")).filter("m > 1").select("band", "first")
    edges = salted_join(placed, buckets, ["band"], F.col("rep")).filter("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct()
    near, _ = materialize(components(edges, "near"), "near")

    members = near.withColumnRenamed("node", "rep").join(sets.select("rep", "copies", "n"), "rep")
    sizes = members.groupBy("label").agg(F.count("*").alias("members"), F.ceil(F.greatest(F.count("*") / block, F.sum("n") / (block * 2000))).cast("int").alias("blocks"))
    dealt = salted_join(members, sizes.drop("members"), ["label"], F.col("rep")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    with_text = dealt.join(docs.select(F.col("row").alias("rep"), "text"), "rep")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = with_text.select("label", "rep", "copies", "text", "block", other).select("label", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "rep", "copies", "text", "block")
    # by range, as a hash would put several pairs of large blocks into one task; by number, as comparing costs more than its bytes say
    rows = sizes.agg(F.coalesce(F.sum(F.col("members") * F.col("blocks")), F.lit(0))).first()[0]
    by_size = pairs.repartitionByRange(max(1, math.ceil(rows / TASK_ROWS)), "label", "p", "q")
    compared, _ = materialize(by_size.groupBy("label", "p", "q").applyInPandas(_pair_of_blocks(threshold), "rep long, label long, links long, texts long"), "compared")

    linked = compared.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    final = components(compared.filter("rep <> label").select(F.col("rep").alias("a"), F.col("label").alias("b")), "final")
    of_set = sets.join(linked, "rep", "left").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    of_set = of_set.select("f1", "f2", F.coalesce("label", "rep").alias("class_row"), "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts"))
    alone = signed.filter("n = 0").select("row", F.col("row").alias("class_row"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("links"), F.lit(0).cast("long").alias("texts"))
    # a set with very many copies makes a skewed partition of narrow rows, which adaptive execution splits
    return some.select("row", "f1", "f2").join(of_set, ["f1", "f2"]).drop("f1", "f2").unionByName(alone)


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with a unique ``row``, and whether that is doc_id itself; else numbers, in written form so that they stay."""
    n, distinct = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if n == distinct:
        return docs.withColumn("row", F.col("doc_id").cast("long")), True
    return materialize(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")[0], False


def join_documents(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: doc_id, class_id (doc_id of the class's first row), n_links, copies, linked_texts."""
    rows, same = numbered(docs.select("doc_id", "text"))
    out = classes(rows, threshold, block)
    if same:
        named = out.withColumn("doc_id", F.col("row")).withColumn("class_id", F.col("class_row"))
    else:
        ids = rows.select("row", "doc_id")
        named = out.join(ids, "row").join(ids.select(F.col("row").alias("class_row"), F.col("doc_id").alias("class_id")), "class_row")
    return named.select("doc_id", "class_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"), "copies", F.col("texts").alias("linked_texts"))


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline form: of each class one document stays, that with the least row id; the input's columns stay."""
    rows, _ = numbered(docs.select("doc_id", "text", F.struct("*").alias("doc")))
    keep = classes(rows.select("row", "text")).filter("row = class_row").select("row")
    return rows.join(keep, "row", "left_semi").select(*[F.col(f"doc.`{c}`") for c in docs.columns])


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM w, unnest(range(1, greatest(2, len(w) - 3))) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS fp FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, x.fp AS fa, y.fp AS fb FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
e AS (SELECT a, b, fa, fb FROM l UNION ALL SELECT b, a, fb, fa FROM l),
reach AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node),
cls AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node),
deg AS (SELECT a, count(*) AS n_links, 1 + count(*) FILTER (fa = fb) AS copies, count(DISTINCT fb) FILTER (fa <> fb) AS linked_texts FROM e GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(copies, 1) AS copies, coalesce(linked_texts, 0) AS linked_texts
FROM documents LEFT JOIN cls ON node = doc_id LEFT JOIN deg ON a = doc_id
"""
