"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

    score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

The pairwise term is read off in time linear in the features that a text has.  Features come from the whole text alone:
words hashed to ``BUCKETS`` (log counts, scaled to length one), and numbers about its structure and size (shares of
byte classes, word and line lengths, repetition), standardised with the training sample's means.

The machine is fitted on the driver on at most ``TRAIN_ROWS`` labelled ids of the training fold (those whose crc32 of
the id, as text, is not 1 mod 3), taken in the order of a hash of the ids; of rows with the same id the one whose text
has the least hash counts.  Only features are collected, at most ``BUCKETS`` of twelve bytes for a row.

Defined cases: null text is empty text, whose score is that of a text without words; a null doc_id is not held out and
never labelled; several labels of one id are averaged, and a tie counts as 1; without labels of both kinds every score
is the prior; repeated rows are each scored; a very long text is a chunk of its own and its features are no more than
any other's; an empty table gives no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.util import ship, table

FOLDS, HELD = 3, 1
TRAIN_ROWS = 6000
BUCKETS = 1 << 15
FACTORS = 8
EPOCHS = 8
BATCH = 128
#: Small samples are gone over more often.
LEAST_STEPS = 300
RATE = 0.1
DECAY = 1e-4

#: Byte classes whose shares are features.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:", b"!?", b"#*$%&<>@^~", b"|\t", b"\"'`()[]{}", b"-_/\\=+", b"\n")
NUMBERS = len(CLASSES) + 9


def fold(doc_id) -> "F.Column":
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def _classes():
    import numpy as np

    out = np.full(256, len(CLASSES), np.uint8)
    for k, chars in enumerate(CLASSES):
        out[list(chars)] = k
    out[128:] = len(CLASSES) + 1
    return out


def features(buf, offsets):
    """(row, bucket, value) of the words and a table of numbers, for a chunk of texts."""
    import numpy as np

    from veilframe.llm import kernel as K

    rows = len(offsets) - 1
    size = np.diff(offsets)
    hashes, counts, _ = K.word_hashes(buf, offsets, lower=True)
    row = K.rows_of(counts)
    _, lengths = K.word_bounds(buf, offsets)
    # words: buckets of each text with log counts, of length one
    key, times = np.unique(row * BUCKETS + (hashes & np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
    at, bucket, value = key // BUCKETS, key % BUCKETS, 1 + np.log(times)
    norm = np.sqrt(np.bincount(at, value**2, minlength=rows))
    value = value / np.maximum(norm, 1e-9)[at]
    # numbers
    kinds = len(CLASSES) + 2
    byte_row = np.repeat(np.arange(rows), size)
    shares = np.bincount(byte_row * kinds + _classes()[buf], minlength=rows * kinds).reshape(rows, kinds)
    whole = np.maximum(size, 1)
    n = np.maximum(counts, 1)
    word_sum = np.bincount(row, lengths, minlength=rows)
    word_sq = np.bincount(row, lengths.astype(float) ** 2, minlength=rows)
    distinct = np.unique(K.mix(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    kept = np.bincount(row[distinct], minlength=rows)
    pair, pairs = K.windows(hashes, counts, 2)
    pair_row = K.rows_of(pairs)
    pair_at = np.unique(K.mix(pair + pair_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    lines = shares[:, len(CLASSES) - 1] + 1
    numbers = np.column_stack([
        shares[:, : len(CLASSES)] / whole[:, None], shares[:, -1] / whole, np.log1p(size), np.log1p(counts),
        word_sum / n, np.sqrt(np.maximum(word_sq / n - (word_sum / n) ** 2, 0)), kept / n, np.bincount(pair_row[pair_at], minlength=rows) / np.maximum(pairs, 1), np.log1p(size / lines), np.log1p(lines),
    ])
    return at, bucket, value, numbers


class Machine:
    """Weights over BUCKETS words, then NUMBERS numbers."""

    def __init__(self, w0, w, v, mean, scale):
        self.w0, self.w, self.v, self.mean, self.scale = w0, w, v, mean, scale

    def numbers(self, raw):
        import numpy as np

        return np.clip((raw - self.mean) / self.scale, -4, 4) / NUMBERS**0.5

    def score(self, at, bucket, value, raw):
        """Scores of a chunk's texts, by the sum-of-squares identity."""
        import numpy as np

        rows, x = len(raw), self.numbers(raw)
        dense_w, dense_v = self.w[BUCKETS:], self.v[BUCKETS:]
        linear = self.w0 + np.bincount(at, self.w[bucket] * value, minlength=rows) + x @ dense_w
        sums, squares = x @ dense_v, (x**2) @ (dense_v**2)
        for f in range(self.v.shape[1]):
            p = self.v[bucket, f] * value
            sums[:, f] += np.bincount(at, p, minlength=rows)
            squares[:, f] += np.bincount(at, p * p, minlength=rows)
        z = linear + 0.5 * (sums**2 - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(words: list[tuple], raw, y, seed: int = 11) -> Machine:
    """words: (buckets, values) of each text; raw: their numbers; y: 0 or 1.  Logistic loss, Adagrad."""
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(seed))
    size = BUCKETS + NUMBERS
    mean, scale = (raw.mean(axis=0), np.maximum(raw.std(axis=0), 1e-6)) if len(raw) else (np.zeros(NUMBERS), np.ones(NUMBERS))
    share = (y.sum() + 1) / (len(y) + 2)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)), mean, scale)
    if len(set(y.tolist())) < 2:
        m.v[:] = 0
        return m
    x = m.numbers(raw)
    gw, gv, g0 = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    weight = np.sqrt(weight)  # between the raw shares and equal ones
    dense = np.arange(BUCKETS, size)
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(y)))):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            idx = np.concatenate([np.concatenate([words[i][0], dense]) for i in pick])
            val = np.concatenate([np.concatenate([words[i][1], x[i]]) for i in pick])
            at = np.repeat(np.arange(len(pick)), [len(words[i][0]) + NUMBERS for i in pick])
            p = m.v[idx] * val[:, None]
            sums = np.zeros((len(pick), FACTORS))
            np.add.at(sums, at, p)
            z = m.w0 + np.bincount(at, m.w[idx] * val, minlength=len(pick)) + 0.5 * ((sums**2).sum(axis=1) - np.bincount(at, (p * p).sum(axis=1), minlength=len(pick)))
            err = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[pick]) * weight[pick] / len(pick)
            used, back = np.unique(idx, return_inverse=True)
            dw = np.bincount(back, err[at] * val) + DECAY * m.w[used]
            dv = np.zeros((len(used), FACTORS))
            np.add.at(dv, back, (err[at] * val)[:, None] * (sums[at] - p))
            dv += DECAY * m.v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            g0 += err.sum() ** 2
            m.w[used] -= RATE * dw / np.sqrt(gw[used])
            m.v[used] -= 0.5 * RATE * dv / np.sqrt(gv[used])
            m.w0 -= RATE * err.sum() / g0**0.5
    return m


def _features_of(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    from veilframe.llm import kernel as K

    for batch in batches:
        for first, rows, buf, offsets in K.chunks(batch.column("text")):
            at, bucket, value, raw = features(buf, offsets)
            ends = np.cumsum(np.bincount(at, minlength=rows))
            cuts = list(zip(np.r_[0, ends[:-1]], ends))
            cols = [pa.array([bucket[i:j].astype("<i4").tobytes() for i, j in cuts], pa.binary()), pa.array([value[i:j].astype("<f4").tobytes() for i, j in cuts], pa.binary()), pa.array([r.astype("<f8").tobytes() for r in raw], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("y").slice(first, rows), *cols], names=["y", "buckets", "vals", "numbers"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Fits on at most ``rows`` labelled documents of the training fold."""
    import numpy as np

    ship(docs.sparkSession)
    y = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("doc_id")) != HELD)).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    some = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", text.alias("text")).join(F.broadcast(some), "doc_id")  # at most ``rows`` ids
    texts = texts.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got = texts.select("y", "text").mapInArrow(_features_of, "y int, buckets binary, vals binary, numbers binary").collect()
    got = sorted(got, key=lambda r: (bytes(r["numbers"]), bytes(r["buckets"]), r["y"]))  # the same order in every run
    words = [(np.frombuffer(r["buckets"], "<i4").astype(np.int64), np.frombuffer(r["vals"], "<f4").astype(float)) for r in got]
    raw = np.array([np.frombuffer(r["numbers"], "<f8") for r in got]).reshape(len(got), NUMBERS)
    return fit(words, raw, np.array([r["y"] for r in got], float))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score of each row of docs."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(machine)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from veilframe.llm import kernel as K

        for batch in batches:
            for first, rows, buf, offsets in K.chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, rows), pa.array(shared.value.score(*features(buf, offsets)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(fold(F.col("doc_id")) == HELD, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
