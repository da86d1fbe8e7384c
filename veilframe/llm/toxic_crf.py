"""Toxicity: a linear-chain conditional random field that tags words as toxic or not, and what its marginals say of a text.

A chain is a sentence or line; its words have features of the word alone (the word, its first three to six bytes, its last
three and four), hashed to ``BUCKETS`` weights.  With weights for neighbours of either kind, forward and backward messages
give each word's probability of being toxic; the expected number and the density of toxic words in a text give its score,
and words of probability 1/2 or more, adjacent ones joined, are the spans.

Both messages are products of 2 x 2 matrices, and a chain's first matrix forgets what stood before it.  So a chunk of texts
is one product, made in rows of about the square root of its length: as many steps in NumPy, however long one sentence is.

Words are labelled for training from the texts' labels: word features that occur in toxic texts and hardly in others are
taken one by one, each time the one that explains most toxic texts, where a text that is explained k times already weighs
2^-k; the words with such a feature are the toxic words of the toxic texts.  The sample is at most ``TRAIN_ROWS`` labelled
ids of each kind, in the order of a hash of the ids, as long as their whole texts fit in ``TRAIN_BYTES``; ids whose crc32 is
2 mod 4 are held out.  The score is calibrated to the shares of the kinds among all labels of the training folds.

Defined cases: null text is empty text, and texts without words get the score of a text with no toxic word; a null doc_id is
not held out and never labelled; several labels of one id are averaged, and a tie counts as 1; of rows with the same id the
one whose text has the least hash trains; without labels of both kinds every score is the prior; repeated rows are each
scored; a very long text is a chunk of its own; an empty table gives no rows; other columns are not looked at, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.util import materialize, ship, table

FOLDS, HELD = 4, 2
THRESHOLD = 0.3
TRAIN_ROWS = 4000
TRAIN_BYTES = 4 << 20
BUCKETS = 1 << 18
CHUNK = 2 << 20
PREFIXES, SUFFIXES = (3, 4, 5, 6), (3, 4)
#: Features that label words: the word and its beginnings.
LABELLING = 1 + len(PREFIXES)
EPOCHS, BATCH_WORDS, RATE, DECAY = 6, 100_000, 0.2, 1e-6
LEAST_STEPS = 60


def fold(doc_id) -> "F.Column":
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


class Tokens:
    """Words of a chunk: starts, lengths, begins (of a chain), row, word (place in the distinct ones) and their features."""

    def __init__(self, buf, offsets):
        import numpy as np

        from veilframe.llm import kernel as K

        letter = np.zeros(256, bool)
        letter[65:91] = letter[97:123] = letter[128:] = True
        stop = np.zeros(256, bool)
        stop[list(b".!?\n")] = True
        inside = letter[buf]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < len(buf)]] = False
        self.starts = starts = np.flatnonzero(inside & ~before)
        self.rows = len(offsets) - 1
        self.counts = np.diff(np.searchsorted(starts, offsets))
        self.row = K.rows_of(self.counts)
        self.features = np.zeros((0, LABELLING + len(SUFFIXES)), np.uint64)
        if not len(starts):
            self.lengths = self.word = starts
            self.begins = np.zeros(0, bool)
            return
        self.lengths = lengths = np.append(starts[1:], len(buf)) - starts - np.add.reduceat(~inside, starts)
        stops = np.cumsum(stop[buf], dtype=np.int64)[starts]
        self.begins = np.ones(len(starts), bool)
        self.begins[1:] = (stops[1:] != stops[:-1]) | (self.row[1:] != self.row[:-1])
        ends = np.cumsum(lengths)
        place = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
        values = K.table_for(True)[buf[place + np.repeat(starts, lengths)]] * K._pow(int(lengths.max()))[place]
        hashes = K.mix(np.add.reduceat(values, ends - lengths) + lengths.astype(np.uint64))
        found, first, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        at, size = starts[first], lengths[first]
        low, power = K.table_for(True), K._pow(8)
        columns = [found]
        for sign, k in [(0, k) for k in PREFIXES] + [(1, k) for k in SUFFIXES]:
            from_ = at + (size - k if sign else 0)
            h = sum(low[buf[np.clip(from_ + j, 0, len(buf) - 1)]] * power[j] for j in range(k))
            # a word that is shorter has its own hash in place of the feature
            columns.append(np.where(size >= k, K.mix(h + np.uint64(1000 * (sign + 1) + k)), found))
        self.features = np.column_stack(columns)

    def buckets(self):
        import numpy as np

        return (self.features & np.uint64(BUCKETS - 1)).astype(np.int64)


def _scan(m, reverse: bool):
    """Running products (K, L, 2, 2 as four arrays of L rows) of the matrices of each row, each scaled to a sum of one."""
    import numpy as np

    out = [np.empty_like(x) for x in m]
    size = len(m[0])
    a = b = c = d = None
    for t in reversed(range(size)) if reverse else range(size):
        w, x, y, z = (q[t] for q in m)
        if a is None:
            a, b, c, d = w, x, y, z
        elif reverse:
            a, b, c, d = w * a + x * c, w * b + x * d, y * a + z * c, y * b + z * d
        else:
            a, b, c, d = a * w + b * y, a * x + b * z, c * w + d * y, c * x + d * z
        scale = 1 / (a + b + c + d)
        a, b, c, d = a * scale, b * scale, c * scale, d * scale
        for q, v in zip(out, (a, b, c, d)):
            q[t] = v
    return out


def messages(emit, begins, links):
    """(matrices, forward, backward): forward[t] and backward[t] are pairs for not toxic and toxic, up to their scale.

    emit: log odds of each word for being toxic; links: log weights of (start toxic, 0 -> 1, 1 -> 0, 1 -> 1).
    """
    import numpy as np

    n = len(emit)
    width = max(1, int(n**0.5))
    rows = -(-n // width)
    e = np.exp(np.clip(emit, -20, 20))
    start, t01, t10, t11 = np.exp(links)
    m = [np.ones(n), np.where(begins, start, t01) * e, np.where(begins, 1.0, t10), np.where(begins, start, t11) * e]
    # one column for each row of words, steps along the first axis; what is filled up leaves messages as they are
    grid = [np.concatenate([x, np.full(rows * width - n, fill)]).reshape(rows, width).T.copy() for x, fill in zip(m, (1.0, 0.0, 0.0, 1.0))]
    left, right = _scan(grid, False), _scan(grid, True)
    f, b = np.empty((rows, 2)), np.empty((rows, 2))
    x, y = 0.5, 0.5
    for k in range(rows):
        f[k] = x, y
        w = [q[-1, k] for q in left]
        x, y = x * w[0] + y * w[2], x * w[1] + y * w[3]
        x, y = x / (x + y), y / (x + y)
    x, y = 0.5, 0.5
    for k in reversed(range(rows)):
        b[k] = x, y
        w = [q[0, k] for q in right]
        x, y = w[0] * x + w[1] * y, w[2] * x + w[3] * y
        x, y = x / (x + y), y / (x + y)
    forward = np.stack([f[:, 0] * left[0] + f[:, 1] * left[2], f[:, 0] * left[1] + f[:, 1] * left[3]], -1)
    forward = np.swapaxes(forward, 0, 1).reshape(-1, 2)[:n]
    after = np.stack([right[0] * b[:, 0] + right[1] * b[:, 1], right[2] * b[:, 0] + right[3] * b[:, 1]], -1)
    after = np.swapaxes(after, 0, 1).reshape(-1, 2)[:n]  # what stands before word t sees
    backward = np.concatenate([after[1:], [[1.0, 1.0]]])
    return m, forward, backward


def marginals(emit, begins, links):
    import numpy as np

    if not len(emit):
        return np.zeros(0)
    _, f, b = messages(emit, begins, links)
    both = f * b
    return both[:, 1] / both.sum(axis=1)


class Tagger:
    """Weights of the features, the bias and the links, and how a text's score is made from the marginals."""

    def __init__(self, weights, bias, links, calibration):
        self.weights, self.bias, self.links, self.calibration = weights, bias, links, calibration

    def emit(self, tokens: Tokens):
        return (self.bias + self.weights[tokens.buckets()].sum(axis=1))[tokens.word] if len(tokens.starts) else tokens.starts.astype(float)

    def marginals(self, tokens: Tokens):
        return marginals(self.emit(tokens), tokens.begins, self.links)

    def score(self, tokens: Tokens, p):
        import numpy as np

        z = evidence(tokens, p) @ self.calibration[1:] + self.calibration[0]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def evidence(tokens: Tokens, p):
    """Of each text: logs of the expected number of toxic words and of their share, the strongest word."""
    import numpy as np

    total = np.bincount(tokens.row, p, tokens.rows)
    top = np.zeros(tokens.rows)
    np.maximum.at(top, tokens.row, p)
    return np.column_stack([np.log(total + 1e-2), np.log(total / np.maximum(tokens.counts, 1) + 1e-4), top])


def toxic_words(tokens: Tokens, y):
    """Whether each distinct word is toxic, by the features that explain the toxic texts; see the module."""
    import numpy as np

    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    out = np.zeros(len(tokens.features), bool)
    if not y.sum() or not len(out):
        return out
    pairs = np.unique(tokens.row.astype(np.int64) * len(out) + tokens.word)  # distinct words of each text
    doc, word = pairs // len(out), pairs % len(out)
    names, code = np.unique(tokens.features[:, :LABELLING], return_inverse=True)
    code = code.reshape(len(out), LABELLING)
    fd = np.unique((code[word] * tokens.rows + doc[:, None]).ravel())
    df1, df0 = (np.bincount(fd[toxic] // tokens.rows, minlength=len(names)) for toxic in (y[fd % tokens.rows] == 1, y[fd % tokens.rows] == 0))
    good = (df1 >= 3) & (df1 / n1 >= 20 * (df0 + 0.5) / n0) & (df1 * np.log((df1 + 1e-9) / n1 * n0 / (df0 + 0.5)) >= 8)
    mine = np.flatnonzero(y[doc] == 1)
    f, d, w = code[word[mine]].ravel(), np.repeat(doc[mine], LABELLING), np.repeat(word[mine], LABELLING)
    stay = good[f]
    order = np.lexsort((d[stay], f[stay]))
    f, d, w = f[stay][order], d[stay][order], w[stay][order]
    if not len(f):
        return out
    groups = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (d[1:] != d[:-1])])
    gf, gd = f[groups], d[groups]
    seen, least = np.zeros(tokens.rows), max(2.0, 0.003 * n1)
    while True:
        open_ = np.maximum.reduceat((~out[w]).astype(np.int8), groups)
        gain = np.bincount(gf, open_ * 0.5 ** seen[gd])
        best = int(gain.argmax())
        if gain[best] < least:
            return out
        seen[gd[(gf == best) & (open_ == 1)]] += 1
        out[w[f == best]] = True


def _together(texts: list[bytes]) -> Tokens:
    """The words of all texts, read in parts of a few hundred kilobytes."""
    import numpy as np

    parts, at = [], 0
    while at < len(texts) or not parts:
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to]) <= CHUNK // 8):
            held += len(texts[to])
            to += 1
        parts.append(Tokens(np.frombuffer(b"".join(texts[at:to]), np.uint8), np.cumsum([0, *map(len, texts[at:to])])))
        at = to
    out = parts[0]
    if len(parts) > 1:
        features = np.concatenate([p.features for p in parts])
        _, first, word = np.unique(features[:, 0], return_index=True, return_inverse=True)
        shift = np.cumsum([0, *(len(p.features) for p in parts)])
        rows = np.cumsum([0, *(p.rows for p in parts)])
        out.word = np.concatenate([word[p.word + k] for p, k in zip(parts, shift)])
        out.row = np.concatenate([p.row + k for p, k in zip(parts, rows)])
        out.features = features[first]
        out.begins, out.counts, out.starts, out.lengths = (np.concatenate([getattr(p, x) for p in parts]) for x in ("begins", "counts", "starts", "lengths"))
        out.rows = len(texts)
    return out


def fit(texts: list[bytes], y, share: float, seed: int = 5) -> Tagger:
    """share: of toxic texts among all that are labelled; the sample may have more."""
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(seed))
    share = min(max(share, 1e-4), 1 - 1e-4)
    flat = Tagger(np.zeros(BUCKETS), -8.0, np.zeros(4), np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0]))
    if len(set(y.tolist())) < 2:
        return flat
    every = _together(texts)
    named = toxic_words(every, y)
    if not named.any():
        return flat
    label = (named[every.word] & (y[every.row] == 1)).astype(float)
    buckets = every.buckets()
    # groups of texts of about BATCH_WORDS words, dealt anew each time
    firsts = np.concatenate([[0], np.cumsum(every.counts)])
    w, g = np.zeros(BUCKETS), np.full(BUCKETS, 1e-2)
    rate = label.mean()
    small = np.concatenate([[np.log(rate / (1 - rate))], np.zeros(4)])  # bias, links
    g_small = np.full(5, 1e-2)
    batches = max(1, len(label) // BATCH_WORDS)
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // batches))):
        for docs in np.array_split(rng.permutation(len(texts)), batches):
            at = np.concatenate([np.arange(firsts[i], firsts[i + 1]) for i in docs])
            if not len(at):
                continue
            idx, begins, t = buckets[every.word[at]], every.begins[at], label[at]
            emit = small[0] + w[idx].sum(axis=1)
            m, f, b = messages(emit, begins, small[1:])
            both = f * b
            p = both[:, 1] / both.sum(axis=1)
            err = (p - t) / len(at)
            inner = np.flatnonzero(~begins)
            before = f[inner - 1]
            joint = np.stack([before[:, 0] * m[0][inner] * b[inner, 0], before[:, 0] * m[1][inner] * b[inner, 1], before[:, 1] * m[2][inner] * b[inner, 0], before[:, 1] * m[3][inner] * b[inner, 1]])
            joint = (joint[1:] / joint.sum(axis=0)).sum(axis=1)
            prev, now = t[inner - 1], t[inner]
            true = np.array([((1 - prev) * now).sum(), (prev * (1 - now)).sum(), (prev * now).sum()])
            d_small = np.concatenate([[err.sum()], [err[begins].sum()], (joint - true) / len(at)])
            dw = np.bincount(idx.ravel(), np.repeat(err, idx.shape[1]), BUCKETS) + DECAY * w
            g += dw**2 * 1e6
            g_small += d_small**2 * 1e6
            w -= RATE * 1e3 * dw / np.sqrt(g)
            small = small - RATE * 1e3 * d_small / np.sqrt(g_small)
    tagger = Tagger(w, small[0], small[1:], flat.calibration)
    x = evidence(every, tagger.marginals(every))
    tagger.calibration = _logistic(x, y, share)
    return tagger


def _logistic(x, y, share):
    """Weights of a logistic regression in which toxic texts weigh as much as their share, by damped Newton steps."""
    import numpy as np

    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())) / len(y)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    x = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    ridge = np.r_[0.0, np.full(x.shape[1] - 1, 1e-3)]
    loss = lambda c: weight @ np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ c)) + 0.5 * (ridge * c * c).sum()
    c = np.r_[np.log(share / (1 - share)), np.zeros(x.shape[1] - 1)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -35, 35)))
        grad = x.T @ (weight * (p - y)) + ridge * c
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), grad)
        size = 1.0
        while size > 1e-6 and loss(c - size * step) > loss(c):
            size /= 2
        c = c - size * step
    return np.r_[c[0] - (c[1:] * mean / scale).sum(), c[1:] / scale]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Tagger:
    import numpy as np

    y = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != HELD))
    y = y.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    n = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    some = [y.filter(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    some = some[0].unionByName(some[1])
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", text.alias("text")).join(F.broadcast(some), "doc_id")  # at most twice ``rows`` ids
    texts = texts.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    texts, _ = materialize(texts.withColumn("bytes", F.octet_length("text")), "toxic-sample")
    taken, used = [], {0: 0, 1: 0}
    for r in texts.select("doc_id", "y", "bytes").orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if used[r["y"]] + r["bytes"] <= size:
            used[r["y"]] += r["bytes"]
            taken.append(r["doc_id"])
    ids = docs.sparkSession.createDataFrame([(i,) for i in taken], "doc_id long")
    got = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "y", "text").collect()
    got = sorted({r["text"]: (r["doc_id"], r["y"], r["text"]) for r in sorted(got, reverse=True)}.values())  # equal texts once
    return fit([r[2].encode() for r in got], np.array([r[1] for r in got], float), share)


def tag(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, score and spans (start and end of each toxic stretch, in code points) of each row of docs."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(tagger)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from veilframe.llm import kernel as K

        model = shared.value
        for batch in batches:
            for first, rows, buf, offsets in K.chunks(batch.column("text"), CHUNK):
                tokens = Tokens(buf, offsets)
                p = model.marginals(tokens)
                spans: list[list] = [[] for _ in range(rows)]
                hot = np.flatnonzero(p >= 0.5)
                if len(hot):
                    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                    follows = np.r_[False, (hot[1:] == hot[:-1] + 1) & ~tokens.begins[hot[1:]]]
                    a, z = hot[~follows], hot[np.r_[~follows[1:], True]]
                    base = points[offsets[tokens.row[a]]]
                    at = np.column_stack([points[tokens.starts[a]] - base, points[tokens.starts[z] + tokens.lengths[z]] - base])
                    for r, s in zip(tokens.row[a].tolist(), at.tolist()):
                        spans[r].append({"start": s[0], "end": s[1]})
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, rows), pa.array(model.score(tokens, p)), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start:long,end:long>>")


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = tag(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(fold(F.col("doc_id")) == HELD, F.lit(False))
    said = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), said.alias("spans"))
