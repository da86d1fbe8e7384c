"""LM scoring: a Katz back-off model with Good-Turing discounts at both orders.

Tokens are the words of a text (A-Z lower-cased), then one end.  Every word of the training texts is a unit of its own,
however rare it is and however large the corpus; what training has not shares CLASSES slots.

    P(b | a) = s(a) * d2(r) * r / c(a)      where the pair (a, b) occurs r > 0 times in training
             = alpha(a) * P(b)              else
    P(b)     = s * d1(c) * c / N            where b occurs c > 0 times in training
             = left / CLASSES               else

d1 and d2 are Katz's Good-Turing discounts for counts up to 5.  alpha(a) gives exactly what the discounts leave to the
units not seen after a, and left is exactly what they leave of P(b), so each context sums to one.  s is 1 except where no
discount leaves anything; there it sets 1/(count + 1) aside.

Training
    1. words are counted; the frequent ones (at least N / UNITS occurrences: at most UNITS) become a broadcast cache, and
       a word's code is its place there or else its 63-bit hash;
    2. each chunk of CHUNK tokens sends its distinct pairs, packed, to the bucket of the second word, where counts of pairs
       and of rare second words are sums; the table (first, second, pair's count, second's count) is written in packed
       parts, each of one bucket of first words;
    3. the sums over the pairs of each frequent first word, and the most frequent pairs (at least N / PAIRS occurrences),
       join the cache.
Scoring
    1. each chunk of the texts sends its distinct pairs with the documents they stand in to the bucket of the first word
       (of a frequent first word: of the second, or of the pair), where the table's parts of that bucket wait; pairs found
       there are done, the others take alpha(a), and P(b) from the cache where b is frequent;
    2. rare words after which neither holds go on, as rows, to a join with the table of words;
    3. sums come back to the chunk, in an order that does not depend on who came first.

Nothing holds more than a bucket's table and one chunk's part of it; no key of a bucket has more than N / UNITS tokens.
No probability depends on the cache or on the sizes of chunks and buckets.  A message has about CHUNK * BUCKET / N tokens:
both are to grow with an executor's memory on very large corpora.

Defined cases: null text is empty text (one token, the end); a null doc_id counts as held out; repeated rows are each
scored, and each counted in training; a very long text is a chunk of its own; without training tokens every word has the
same probability; an empty table gives no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.util import materialize, ship, table

FOLDS = 10
ADD = 0.1
#: Bounds of what is broadcast, whatever the corpus.
UNITS = 1 << 20
PAIRS = 1 << 18
#: Slots of the words that training has not.
CLASSES = 1 << 16
#: Counts up to this are discounted.
GOOD_TURING = 5
#: Tokens looked at together, and tokens of a bucket.
CHUNK = 1 << 20
BUCKET = 3_000_000
#: Pairs of a part of the table.
PART = 200_000
#: Bytes of text hashed together.
FLUSH = 1 << 20
#: Codes from here on are hashes of rare words; the begin of a text has the place after the frequent words.
RARE = 1 << 63


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(True))


# ---- tokens


def _chunks(column):
    """(first row, rows, word hashes with an end after each text, tokens of each text) of about CHUNK tokens."""
    import numpy as np

    from veilframe.llm import kernel as K

    first, held, sizes = 0, [], []
    for at, rows, buf, offsets in K.chunks(column, FLUSH):
        hashes, counts, _ = K.word_hashes(buf, offsets, lower=True)
        held.append(np.insert(hashes, np.cumsum(counts), K.END))
        sizes.append(counts + 1)
        if sum(map(len, held)) >= CHUNK:
            yield first, at + rows - first, np.concatenate(held), np.concatenate(sizes)
            first, held, sizes = at + rows, [], []
    if held:
        yield first, sum(map(len, sizes)), np.concatenate(held), np.concatenate(sizes)


def _mix_pair(a, b):
    import numpy as np

    from veilframe.llm import kernel as K

    return K.mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def _bucket(a, b, n: int, by_second: bool = False):
    """Where a pair goes: by its first word (or its second), by the other one where that is frequent, by the pair where
    both are.  Pairs with one rare word are thus in the same bucket either way."""
    import numpy as np

    from veilframe.llm import kernel as K

    keys = _mix_pair(a, b)
    for word in (a, b) if by_second else (b, a):
        rare = word >= np.uint64(RARE)
        keys[rare] = K.mix(word[rare])
    return (keys % np.uint64(n)).astype(np.int64)


def _firsts(keys):
    """Places of the first of each run of equal keys."""
    import numpy as np

    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def _find(known, keys):
    """(which keys are among the sorted known ones, their places there)."""
    import numpy as np

    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, at


class Cache:
    """The frequent words and the totals of the training texts."""

    def __init__(self, words, counts, n: int, v: int):
        import numpy as np

        order = np.argsort(words)
        self.words, self.counts, self.n, self.v = words[order], counts[order], n, v

    def codes(self, hashes):
        """(ascending codes of the distinct words, for each token its place among them)."""
        import numpy as np

        words, of = np.unique(hashes, return_inverse=True)
        hit, at = _find(self.words, words)
        codes = np.where(hit, at.astype(np.uint64), words | np.uint64(RARE))
        order = np.argsort(codes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return codes[order], place[of]

    def pairs(self, hashes, counts):
        """(codes and, last, that of the begin; for each token a number of its pair: place of the first word, then of the second)."""
        import numpy as np

        codes, of = self.codes(hashes)
        before = np.empty_like(of)
        before[1:] = of[:-1]
        before[np.cumsum(counts) - counts] = len(codes)
        return np.append(codes, np.uint64(len(self.words))), before << 32 | of


# ---- packed arrays


def _pack(codec, *arrays) -> bytes:
    """Whole numbers, byte plane after byte plane, compressed; the first array is ascending and kept as steps."""
    import numpy as np

    first, *rest = arrays
    planes = [np.diff(first, prepend=first.dtype.type(0)), *rest]
    return codec.compress(np.concatenate([x.view(np.uint8).reshape(len(x), -1).T.ravel() for x in planes]), asbytes=True)


def _unpack(codec, body: bytes, *layout):
    """The arrays of _pack, from (type, length) of each."""
    import numpy as np

    widths = [np.dtype(t).itemsize * n for t, n in layout]
    raw = np.frombuffer(codec.decompress(body, sum(widths)), np.uint8)
    out, at = [], 0
    for (kind, n), width in zip(layout, widths):
        out.append(np.ascontiguousarray(raw[at : at + width].reshape(-1, n).T).view(kind).ravel() if n else np.zeros(0, kind))
        at += width
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def _codec():
    return pa.Codec("zstd", compression_level=1)


def _pieces(bucket, n: int):
    """(bucket, places of its keys, in order) for each bucket that has keys."""
    import numpy as np

    order = np.argsort(bucket.astype(np.uint16) if n <= 1 << 16 else bucket, kind="stable")
    sorted_ = bucket[order]
    firsts = _firsts(sorted_)
    for k, i in zip(sorted_[firsts].tolist(), np.split(order, firsts[1:])):
        if len(i):
            yield k, i


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=list(names))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of packed messages, one after the other."""
    for batch in batches:
        columns = [batch.column(c) for c in range(batch.num_columns)]
        for i in range(batch.num_rows):
            yield {name: c[i].as_py() for name, c in zip(batch.schema.names, columns)}


# ---- training


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        for _, _, hashes, _ in _chunks(batch.column("text")):
            words, counts = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64))], names=["word", "c"])


_COUNTED = "bucket long, n int, body binary"
#: A part of the table: pairs of one bucket, and how many of them occur once, twice, ...
_TABLE = "bucket long, n int, body binary, " + ", ".join(f"r{r} long" for r in range(1, GOOD_TURING + 2))


def _count_pairs(shared, n_buckets: int):
    """Texts to their distinct pairs, packed, by the second word (by the pair where that word is frequent)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        cache, codec = shared.value, _codec()
        for batch in batches:
            for _, _, hashes, counts in _chunks(batch.column("text")):
                codes, pairs = cache.pairs(hashes, counts)
                pairs.sort()
                firsts = _firsts(pairs)
                c = np.diff(np.append(firsts, len(pairs))).astype(np.uint32)
                a, b = codes[pairs[firsts] >> 32], codes[pairs[firsts] & 0xFFFFFFFF]
                for k, i in _pieces(_bucket(a, b, n_buckets, True), n_buckets):
                    yield _batch([(k, len(i), _pack(codec, a[i], b[i], c[i]))], _COUNTED)

    return run


class _Sums:
    """Counts of the pairs of one bucket, merged whenever as many have come as it has."""

    def __init__(self):
        self.parts, self.held, self.known = [], 0, 1_000_000

    def add(self, a, b, c):
        self.parts.append((a, b, c))
        self.held += len(a)
        if self.held > 2 * self.known:
            self.merge()
            self.known = max(self.known, self.held)

    def merge(self):
        import numpy as np

        a, b, c = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        keys = _mix_pair(a, b)
        order = np.argsort(keys)
        firsts = _firsts(keys[order])
        at = order[firsts]
        self.parts = [(a[at], b[at], np.add.reduceat(c[order], firsts))]
        self.held = len(at)
        return self.parts[0]


def _sum_pairs(shared, n_buckets: int):
    """Packed pairs in order of their buckets to parts of the table, by the first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        cache, codec = shared.value, _codec()

        def give(sums):
            a, b, c = sums.merge()
            order = np.lexsort((b, a))
            a, b, c = a[order], b[order], c[order]
            rare = b >= np.uint64(RARE)
            cb = np.empty(len(b), np.int64)
            cb[~rare] = cache.counts[b[~rare].astype(np.int64)]
            _, of = np.unique(b[rare], return_inverse=True)
            cb[rare] = np.bincount(of, c[rare]).astype(np.int64)[of]  # exact: counts are far below 2**53
            for k, i in ((k, part) for k, i in _pieces(_bucket(a, b, n_buckets), n_buckets) for part in np.split(i, range(PART, len(i), PART))):
                few = np.bincount(np.minimum(c[i], GOOD_TURING + 2), minlength=GOOD_TURING + 3)[1 : GOOD_TURING + 2]
                yield _batch([(k, len(i), _pack(codec, a[i], b[i], c[i], cb[i]), *few.tolist())], _TABLE)

        current, sums = None, _Sums()
        for row in _rows(batches):
            if row["bucket"] != current and sums.parts:
                yield from give(sums)
                sums = _Sums()
            current = row["bucket"]
            a, b, c = _unpack(codec, row["body"], ("<u8", row["n"]), ("<u8", row["n"]), ("<u4", row["n"]))
            sums.add(a, b, c.astype(np.int64))
        if sums.parts:
            yield from give(sums)

    return run


def discounts(n_r: dict[int, int], k: int = GOOD_TURING) -> list[float]:
    """d(0..k): Katz's discounts from the numbers of units seen r times; where those are too few to give a value
    between 0 and 1, half a count is taken off."""
    out = [1.0]
    n1 = n_r.get(1, 0)
    common = (k + 1) * n_r.get(k + 1, 0) / n1 if n1 else 1.0
    for r in range(1, k + 1):
        n = n_r.get(r, 0)
        d = ((r + 1) * n_r.get(r + 1, 0) / n / r - common) / (1 - common) if n and common < 1 else -1.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


class Rates:
    """What holds for all contexts: the discounts of both orders and what P(b) leaves to unknown words."""

    def __init__(self, d1: list[float], d2: list[float], n: int, kept: float):
        """kept: the sum of d1(c) * c over all words."""
        import numpy as np

        self.d1, self.d2, self.n = np.array(d1), np.array(d2), n
        share, least = (kept / n, 1 / (n + 1)) if n else (0.0, 1.0)
        self.scale = (1 - least) / share if n and 1 - share < least else 1.0
        self.slot = (1 - self.scale * share) / CLASSES

    @staticmethod
    def kept(d, c):
        import numpy as np

        return c * np.where(c < len(d), d[np.minimum(c, len(d) - 1)], 1.0)

    def word(self, c):
        """P(b) from the count of b."""
        import numpy as np

        return np.where(c > 0, self.scale * self.kept(self.d1, c) / max(self.n, 1), self.slot)

    def context(self, total, kept, seen):
        """(log10 of alpha(a), log10 of s(a) / c(a)); seen: the sum of P(b) over the units seen after a."""
        import numpy as np

        share, least = kept / total, 1 / (total + 1)
        scale = np.where(1 - share < least, (1 - least) / share, 1.0)
        return np.log10((1 - scale * share) / np.maximum(1 - seen, 1e-12)), np.log10(scale / total)


_PART = ["<u8", "<u8", "<i8", "<i8"]
_SUMMED = "hot boolean, a long, b long, c double, x double, y double"


def _contexts(shared, rates: Rates):
    """Parts of the table to sums over the pairs of each frequent first word, and to the most frequent pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        cache, codec = shared.value, _codec()
        sums = np.zeros((3, len(cache.words) + 1))
        for row in _rows(batches):
            a, b, c, cb = _unpack(codec, row["body"], *((t, row["n"]) for t in _PART))
            often = np.flatnonzero(a < np.uint64(RARE))
            a, b, c, cb = a[often].astype(np.int64), b[often], c[often], cb[often]
            for s, w in zip(sums, (c, rates.kept(rates.d2, c), rates.word(cb))):
                s += np.bincount(a, w, len(s))
            hot = np.flatnonzero((c * PAIRS >= rates.n) & (b < np.uint64(RARE)))
            yield _batch([(True, *x, 0.0, 0.0) for x in zip(a[hot].tolist(), b[hot].astype(np.int64).tolist(), c[hot].tolist())], _SUMMED)
        k = np.flatnonzero(sums[0])
        yield _batch([(False, *x) for x in zip(k.tolist(), [0] * len(k), *(s[k].tolist() for s in sums))], _SUMMED)

    return run


class Katz:
    """All of the model that is bounded by constants."""

    def __init__(self, cache: Cache, rates: Rates, place, total, kept, seen, hot_a, hot_b, hot_c):
        import numpy as np

        self.cache, self.rates = cache, rates
        self.log_count, self.log_word = np.log10(cache.counts + ADD), np.log10(rates.word(cache.counts))
        self.log_alpha, self.log_share = np.zeros(len(cache.words) + 1), np.zeros(len(cache.words) + 1)
        self.log_alpha[place], self.log_share[place] = rates.context(total, kept, seen)
        keys = _mix_pair(hot_a.astype(np.uint64), hot_b.astype(np.uint64))
        order = np.argsort(keys)
        self.hot = keys[order]
        self.hot_value = (self.log_share[hot_a] + np.log10(rates.kept(rates.d2, hot_c)))[order]


def _by_bucket(df: DataFrame, *then: str) -> DataFrame:
    """Rows of a bucket one after the other in one task, which streams them."""
    return df.repartition("bucket").sortWithinPartitions("bucket", *then)


def train(docs: DataFrame):
    """The model of docs (column text): (Katz, table of pairs, table of words, number of buckets)."""
    import numpy as np

    spark = docs.sparkSession
    sc = spark.sparkContext
    words, _ = materialize(docs.select("text").mapInArrow(_count_words, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    few = {r["c"]: r["n"] for r in words.filter(F.col("c") <= GOOD_TURING + 1).groupBy("c").agg(F.count("*").alias("n")).collect()}
    d1 = discounts(few)
    top = words.filter(F.col("c") * UNITS >= n).toPandas()  # at most UNITS rows
    cache = Cache(top["word"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64), n, v)
    shared = sc.broadcast(cache)
    n_buckets = max(1, math.ceil(n / BUCKET))
    counted = _by_bucket(docs.select("text").mapInArrow(_count_pairs(shared, n_buckets), _COUNTED))
    pairs, _ = materialize(counted.mapInArrow(_sum_pairs(shared, n_buckets), _TABLE), "pairs")
    seen = pairs.agg(*[F.coalesce(F.sum(f"r{r}"), F.lit(0)) for r in range(1, GOOD_TURING + 2)]).first()
    rates = Rates(d1, discounts(dict(enumerate(seen, 1))), n, n - sum((1 - d1[r]) * r * few.get(r, 0) for r in range(1, GOOD_TURING + 1)))
    sums = pairs.select("n", "body").mapInArrow(_contexts(shared, rates), _SUMMED).groupBy("hot", "a", "b").agg(*[F.sum(x).alias(x) for x in "cxy"]).toPandas()  # at most UNITS + PAIRS + 1 rows
    ctx, hot = (x.sort_values(["a", "b"]) for x in (sums[~sums["hot"].astype(bool)], sums[sums["hot"].astype(bool)]))
    model = Katz(cache, rates, ctx["a"].to_numpy(np.int64), *(ctx[x].to_numpy(float) for x in "cxy"), *(hot[x].to_numpy(np.int64) for x in "abc"))
    return model, pairs, words, n_buckets


# ---- scoring

#: Kinds: parts of the table, pairs of a chunk with their documents, what a chunk knows of its documents.
_TABLE_PART, _ASKED, _KNOWN = 0, 1, 2
_MESSAGE = "bucket long, kind int, chunk long, n int, m int, body binary"
#: What buckets return: sums of a chunk's documents, what the chunk knew of them, or a rare word still to be looked up.
_ANSWER = "kind int, chunk long, n int, body binary, word long, doc int, k int"
_DOC = [("id", "<i8"), ("null", "?"), ("held", "?"), ("tokens", "<i8"), ("known", "<i8"), ("base", "<f8"), ("score", "<f8")]
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _ask(shared, n_buckets: int):
    """Texts to messages for the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        model, codec = shared.value, _codec()
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, held = batch.column("doc_id"), np.asarray(batch.column("held_out").to_pylist(), bool)
            for at, rows, hashes, counts in _chunks(batch.column("text")):
                codes, pairs = model.cache.pairs(hashes, counts)
                doc = np.repeat(np.arange(rows, dtype=np.uint32), counts)
                known, base, score = (np.zeros(rows) for _ in range(3))
                second = codes[pairs & 0xFFFFFFFF]
                often = np.flatnonzero(second < np.uint64(RARE))
                known += np.bincount(doc[often], minlength=rows)
                base += np.bincount(doc[often], model.log_count[second[often].astype(np.int64)], rows)
                order = np.argsort(pairs)
                pairs, doc = pairs[order], doc[order]
                firsts = _firsts(pairs)
                k = np.diff(np.append(firsts, len(pairs)))
                a, b = codes[pairs[firsts] >> 32], codes[pairs[firsts] & 0xFFFFFFFF]
                hot, place = _find(model.hot, _mix_pair(a, b))
                done = np.repeat(hot, k)
                score += np.bincount(doc[done], np.repeat(model.hot_value[place[hot]], k[hot]), rows)
                a, b, k, doc = a[~hot], b[~hot], k[~hot], doc[~done]
                starts = np.cumsum(k) - k
                for to, i in _pieces(_bucket(a, b, n_buckets), n_buckets):
                    n = k[i]
                    docs = doc[np.repeat(starts[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    yield _batch([(to, _ASKED, chunk, len(i), len(docs), _pack(codec, a[i], b[i], n.astype(np.uint32), docs))], _MESSAGE)
                some = ids.slice(at, rows)
                own = np.rec.fromarrays([some.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(some.is_null()), held[at : at + rows], counts, known, base, score], dtype=_DOC)
                yield _batch([(chunk % n_buckets, _KNOWN, chunk, rows, 0, own.tobytes())], _MESSAGE)
                chunk += 1

    return run


class _Table:
    """The pairs of a bucket: the value of each, and alpha of its rare first words."""

    def __init__(self, model: Katz, parts: list):
        import numpy as np

        self.model, rates = model, model.rates
        a, b, c, cb = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, t) for t in _PART)
        order = np.argsort(a, kind="stable")
        rare = order[np.searchsorted(a[order], np.uint64(RARE)) :]
        firsts = _firsts(a[rare])
        kept = rates.kept(rates.d2, c)
        self.words = a[rare[firsts]]
        self.log_alpha, share = np.zeros(0), np.zeros(len(a))
        if len(firsts):
            self.log_alpha, log_share = rates.context(*(np.add.reduceat(x[rare].astype(float), firsts) for x in (c, kept, rates.word(cb))))
            share[rare] = np.repeat(log_share, np.diff(np.append(firsts, len(rare))))
        often = a < np.uint64(RARE)
        share[often] = model.log_share[a[often].astype(np.int64)]
        keys = _mix_pair(a, b)
        order = np.argsort(keys)
        self.keys, self.value, self.second = keys[order], (share + np.log10(kept))[order], cb[order]

    def alpha(self, a):
        """log10 of alpha of each first word; a first word that training has not backs off for nothing."""
        import numpy as np

        out = np.zeros(len(a))
        often = a < np.uint64(RARE)
        out[often] = self.model.log_alpha[a[often].astype(np.int64)]
        hit, at = _find(self.words, a[~often])
        out[np.flatnonzero(~often)[hit]] = self.log_alpha[at[hit]]
        return out


def _meet(shared):
    """Messages in order of bucket and kind to answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        model, codec = shared.value, _codec()
        current, parts, table = None, [], None
        for row in _rows(batches):
            if row["bucket"] != current:
                current, parts, table = row["bucket"], [], None
            if row["kind"] == _TABLE_PART:
                parts.append(_unpack(codec, row["body"], *((t, row["n"]) for t in _PART)))
                continue
            if row["kind"] == _KNOWN:
                yield _batch([(_KNOWN, row["chunk"], row["n"], row["body"], None, None, None)], _ANSWER)
                continue
            if table is None:
                table, parts = _Table(model, parts), []
            a, b, k, docs = _unpack(codec, row["body"], ("<u8", row["n"]), ("<u8", row["n"]), ("<u4", row["n"]), ("<u4", row["m"]))
            found, at = _find(table.keys, _mix_pair(a, b))
            at = at[found]
            rare = b >= np.uint64(RARE)
            value, base, known = np.empty(len(a)), np.zeros(len(a)), np.zeros(len(a))
            value[found] = table.value[at]
            base[found], known[found] = np.log10(table.second[at] + ADD), 1
            base[~rare], known[~rare] = 0, 0  # the chunk has these
            value[~found] = table.alpha(a[~found])
            off = np.flatnonzero(~found & ~rare)
            value[off] += model.log_word[b[off].astype(np.int64)]
            many = int(docs.max()) + 1
            sums = [np.bincount(docs, np.repeat(x, k), many) for x in (known, base, value)]
            seen = np.flatnonzero(np.bincount(docs, minlength=many))
            body = _pack(codec, seen.astype("<u4"), sums[0][seen].astype("<u4"), sums[1][seen], sums[2][seen])
            yield _batch([(_ASKED, row["chunk"], len(seen), body, None, None, None)], _ANSWER)
            if len(open_ := np.flatnonzero(np.repeat(~found & rare, k))):
                keys = np.repeat(b, k)[open_].view(np.int64)
                order = np.lexsort((docs[open_], keys))
                keys, of = keys[order], docs[open_][order]
                firsts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])])
                n = len(firsts)
                columns = [pa.array(np.full(n, 3, np.int32)), pa.array(np.full(n, row["chunk"])), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(keys[firsts]), pa.array(of[firsts].astype(np.int32)), pa.array(np.diff(np.append(firsts, len(keys))).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _ANSWER.split(", ")])

    return run


def _add_up(rates: Rates):
    """One chunk: what it knew, the sums from the buckets and the counts of words looked up, in one order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        codec = _codec()
        docs, parts, counts = None, [], []
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            for i in np.flatnonzero(kinds != 3).tolist():
                n, body = batch.column("n")[i].as_py(), batch.column("body")[i].as_py()
                if kinds[i] == _KNOWN:
                    docs = np.frombuffer(body, _DOC)
                else:
                    parts.append((n, body))
            looked = batch.filter(pa.array(kinds == 3))
            counts.append(np.stack([looked.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc", "c", "k")]))
        sums = [docs[c].astype(float) for c in ("known", "base", "score")]
        for n, body in sorted(parts):
            at, *add = _unpack(codec, body, ("<u4", n), ("<u4", n), ("<f8", n), ("<f8", n))
            for s, x in zip(sums, add):
                s[at] += x
        doc, c, k = (x := np.concatenate(counts, axis=1))[:, np.lexsort(x[::-1])]
        for s, x in zip(sums, ((c > 0) * k, np.log10(c + ADD) * k, np.log10(rates.word(c)) * k)):
            s += np.bincount(doc, x, len(docs))
        ids = pa.array(docs["id"].copy(), mask=docs["null"].copy())
        columns = [ids, pa.array(docs["held"].copy()), pa.array(docs["tokens"].copy()), pa.array(np.rint(sums[0]).astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SCORED.split(", ")])

    return run


def score(docs: DataFrame, trained) -> DataFrame:
    """docs (doc_id, text, held_out) scored."""
    model, pairs, words, n_buckets = trained
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    n, v = model.cache.n, model.cache.v
    parts = pairs.select("bucket", F.lit(_TABLE_PART).alias("kind"), F.lit(0).cast("long").alias("chunk"), "n", F.lit(0).alias("m"), "body")
    messages = _by_bucket(docs.mapInArrow(_ask(shared, n_buckets), _MESSAGE).union(parts), "kind")
    answers, _ = materialize(messages.mapInArrow(_meet(shared), _ANSWER), "answers")
    # codes of rare words are their hashes with the first bit set
    by_code = words.select(F.col("word").bitwiseOR(F.lit(-(1 << 63))).alias("word"), "c").groupBy("word").agg(F.sum("c").alias("c"))
    looked = answers.filter("kind = 3").select("word", "chunk", "doc", "k").join(by_code, "word", "left").groupBy("chunk", "doc", "c").agg(F.sum("k").alias("k"))
    looked = looked.select(F.lit(3).alias("kind"), "chunk", F.lit(0).alias("n"), F.lit(None).cast("binary").alias("body"), "doc", "c", "k")
    known = answers.filter("kind <> 3").select("kind", "chunk", "n", "body", F.lit(None).cast("int").alias("doc"), F.lit(None).cast("long").alias("c"), F.lit(None).cast("long").alias("k"))
    out = known.union(looked).groupBy("chunk").applyInArrow(_add_up(model.rates), _SCORED)
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * math.log10(n + ADD * (v + 1))).alias("base_score"), "score",
    )


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return score(docs, train(docs.filter(~F.col("held_out"))))


SQL = None
