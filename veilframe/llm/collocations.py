"""Phrase collocation mining: phrases of two to five words whose parts are found together far more often than by chance.

Words are counted in each language; those seen ``MIN_COUNT`` times or more get a number (``dictionary``), since a phrase
cannot be more frequent than its words.  Texts are cut into pieces at punctuation and at all other words, and each place of
a piece gives one key: the numbers of the next five words, filled up with zeros.  The keys of each chunk of texts are put
in order by a radix sort on digits of sixteen bits, equal ones combined, and cut into ranges; a row holds all keys of one
range, column by column.  The ranges of all chunks are put in order in the same way, and run lengths of prefixes are the
counts of all phrases of two to five words at once; runs that touch the border of a range are summed.  Where ranges are cut
comes from the keys of a few texts, so only the evenness of the tasks depends on these; every key of every text is counted.

``dictionary`` is broadcast while it has at most ``BROADCAST_WORDS`` words (twelve bytes each); beyond that, words get
their numbers by a join.  Words are told apart by a hash of 64 bits of word and language when texts are encoded, and two
words of the dictionary with one hash raise an error.

Defined cases: null text is empty text, a null language is ``und``; rows without words count nothing; repeated rows are each
counted; a very long text is a chunk of its own; equal scores are ranked by count, then by the bytes of the phrase; an
empty table gives no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.util import materialize, ship, table

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
#: The largest dictionary that is sent to all tasks.
BROADCAST_WORDS = 4_000_000
#: Bytes of text whose words, or keys, are combined together.
CHUNK = 4 << 20
#: Keys that one task puts in order.
TASK_KEYS = 1_000_000
#: Keys that tell where ranges are cut: for each range, for all of them, and the texts that are looked at for one of these.
BORDER_KEYS, BORDER_TOTAL, BORDER_TEXTS = 1000, 1_000_000, 16
#: Words of the dictionary that are numbered by one task.
NUMBERED = 100_000

SPACES, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"


def tokens(buf, offsets, langs):
    """Of a chunk: (hash of each word with its language, whether it begins a piece, words of each text, starts, lengths, lower-case bytes).

    langs: a number of 64 bits for the language of each text.
    """
    import numpy as np

    from veilframe.llm import kernel as K

    kind = np.zeros(256, np.uint8)
    kind[list(SPACES)], kind[list(BREAKS)] = 1, 2
    kinds = kind[buf]
    inside = kinds == 0
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(buf)]] = False  # words of adjacent texts may touch
    starts = np.flatnonzero(inside & ~before)
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    low = low[buf]
    counts = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, bool), counts, starts, starts, low
    lengths = np.append(starts[1:], len(buf)) - starts - np.add.reduceat(~inside, starts)
    ends = np.cumsum(lengths)
    firsts = ends - lengths
    place = np.arange(ends[-1]) - np.repeat(firsts, lengths)
    values = K.table_for(False)[low[place + np.repeat(starts, lengths)]] * K._pow(int(lengths.max()))[place]
    row = K.rows_of(counts)
    hashes = K.mix((np.add.reduceat(values, firsts) + lengths.astype(np.uint64)) ^ langs[row])
    cuts = np.cumsum(kinds == 2, dtype=np.int64)[starts]
    begins = np.ones(len(starts), bool)
    begins[1:] = (cuts[1:] != cuts[:-1]) | (row[1:] != row[:-1])
    return hashes, begins, counts, starts, lengths, low


def _langs(column):
    """(number of each row's language, the languages and their numbers)."""
    import numpy as np
    import xxhash

    codes = column.dictionary_encode()
    names = codes.dictionary.to_pylist()
    of = np.array([xxhash.xxh64_intdigest(x.encode()) for x in names], np.uint64)
    at = codes.indices.to_numpy(zero_copy_only=False)
    return at, names, of


def _count_words(batches: Iterator) -> Iterator:
    """Rows of lang, word, h, n for each chunk; the row without a word has the number of all words."""
    import numpy as np
    import pyarrow as pa

    from veilframe.llm import kernel as K

    for batch in batches:
        at, names, of = _langs(batch.column("lang"))
        for first, rows, buf, offsets in K.chunks(batch.column("text"), CHUNK):
            lang = at[first : first + rows]
            hashes, _, counts, starts, lengths, low = tokens(buf, offsets, of[lang])
            every = np.bincount(lang, counts, len(names)).astype(np.int64)
            some = np.flatnonzero(every)
            h, where, n = np.unique(hashes, return_index=True, return_counts=True)
            size = lengths[where]
            ends = np.cumsum(size)
            place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(starts[where], size)
            word = pa.Array.from_buffers(pa.large_string(), len(h), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(low[place])]).cast(pa.string())
            of_word = lang[K.rows_of(counts)[where]]
            langs = pa.array(names, pa.string()).take(pa.array(np.concatenate([of_word, some])))
            cols = [langs, pa.concat_arrays([word, pa.nulls(len(some), pa.string())]), pa.array(np.concatenate([h.view(np.int64), np.zeros(len(some), np.int64)])), pa.array(np.concatenate([n.astype(np.int64), every[some]]))]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "word", "h", "n"])


def packed(number: Column) -> Column:
    """Four bytes of a number."""
    return F.unhex(F.lpad(F.hex(number), 8, "0"))


def dictionary(texts: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame, int]:
    """(key, lang, word, h, n of each frequent word; lang and n of each language; number of the frequent words)."""
    ship(texts.sparkSession)
    found = texts.mapInArrow(_count_words, "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))
    found, _ = materialize(found.filter(F.col("word").isNull() | (F.col("n") >= min_count)), "phrase-words")
    words = found.filter("word IS NOT NULL")
    size = words.count()
    bucket = F.pmod("h", F.lit(max(1, size // NUMBERED))).alias("bucket")
    at, offsets = 1, []
    for r in sorted(words.groupBy(bucket).count().collect()):  # a row for each 100,000 words
        offsets.append((r["bucket"], at))
        at += r["count"]
    if at >= 1 << 32:
        raise ValueError("more than 2**32 frequent words")
    offsets = texts.sparkSession.createDataFrame(offsets, "bucket long, first long")
    order = F.row_number().over(Window.partitionBy("bucket").orderBy("h", "lang", "word"))
    numbered = words.withColumn("bucket", bucket).withColumn("i", order).join(F.broadcast(offsets), "bucket")
    numbered, _ = materialize(numbered.select(packed(F.col("first") + F.col("i") - 1).alias("key"), "lang", "word", "h", "n"), "phrase-dictionary")
    return numbered, found.filter("word IS NULL").select("lang", "n"), size


def radix_order(ids):
    """The order of rows of 32-bit numbers, least digit first, sixteen bits a digit (a radix sort in NumPy)."""
    import numpy as np

    order = np.arange(len(ids))
    for column in reversed(range(ids.shape[1])):
        for shift in (0, 16):
            digit = (ids[:, column] >> np.uint32(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _combined(ids, n):
    """Rows in order, equal ones once with their counts summed."""
    import numpy as np

    order = radix_order(ids)
    ids, n = ids[order], n[order]
    firsts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)]) if len(ids) else np.zeros(0, np.int64)
    return ids[firsts], np.add.reduceat(n, firsts) if len(firsts) else n


_KEYS = "part int, keys binary, n binary"


def _unpacked(keys, n=None):
    """Rows of numbers, and their counts, from what stands in a row of ``keys``."""
    import numpy as np

    ids = np.frombuffer(keys, np.uint32).reshape(MAX_WORDS, -1).T
    return ids if n is None else (ids, np.frombuffer(n, np.uint32).astype(np.int64))


def _ordered(ids):
    """Rows of numbers as values whose order is theirs."""
    import numpy as np

    return np.ascontiguousarray(ids.astype(">u4")).view(f"S{4 * MAX_WORDS}").ravel()


def _keys(ids, begins, borders, every):
    """The keys of a stretch of words, a row for each range: ids (0: not frequent) and whether each begins a piece.

    every: only every so-manieth key in their order."""
    import numpy as np
    import pyarrow as pa

    size = len(ids)
    piece = np.cumsum(begins | (ids == 0))
    out = np.zeros((size, MAX_WORDS), np.uint32)
    out[:, 0] = ids
    for k in range(1, min(MAX_WORDS, size)):
        out[: size - k, k] = np.where(piece[k:] == piece[:-k], ids[k:], 0)
    out = out[(out[:, 0] > 0) & (out[:, 1] > 0)] if size else out
    out, n = (x[every // 2 :: every] for x in _combined(out, np.ones(len(out), np.int64)))
    cuts = np.concatenate([[0], np.searchsorted(_ordered(out), borders), [len(out)]])
    parts = np.flatnonzero(cuts[1:] > cuts[:-1])
    n = n.astype(np.uint32)
    held = [(out[a:b].T.tobytes(), n[a:b].tobytes()) for a, b in zip(cuts[parts], cuts[parts + 1])]
    cols = [pa.array(parts, pa.int32()), *(pa.array([x[k] for x in held], pa.binary()) for k in (0, 1))]
    return pa.RecordBatch.from_arrays(cols, names=["part", "keys", "n"])


def known_words(words: DataFrame):
    """A dictionary that fits: (hashes in order, their numbers), sent to all tasks once."""
    import numpy as np

    known = words.select("h", F.conv(F.hex("key"), 16, 10).cast("long").alias("id")).toPandas()  # at most broadcast_words rows of two numbers
    h, ids = known["h"].to_numpy(np.int64).view(np.uint64), known["id"].to_numpy(np.uint32)
    order = np.argsort(h)
    h, ids = h[order], ids[order]
    if (h[1:] == h[:-1]).any():
        raise ValueError("two words of the dictionary have one hash")
    return words.sparkSession.sparkContext.broadcast((h, ids))


def keys(texts: DataFrame, words: DataFrame, size: int, broadcast_words: int = BROADCAST_WORDS, borders=None, shared=None, every: int = 1) -> DataFrame:
    """part, keys (five numbers for each place where two frequent words or more begin), n: a row for each range of a chunk.

    borders: the first key of each range but the first; shared: ``known_words``, where they were sent before; every: more
    than 1 for a part of the keys, which only tells where ranges may be cut.
    """
    import numpy as np

    borders = np.zeros(0, f"S{4 * MAX_WORDS}") if borders is None else borders
    if size > broadcast_words:
        return _joined_keys(texts, words, borders, every)
    shared = shared or known_words(words)

    def run(batches: Iterator) -> Iterator:
        from veilframe.llm import kernel as K

        h, ids = shared.value
        for batch in batches:
            at, _, of = _langs(batch.column("lang"))
            for first, rows, buf, offsets in K.chunks(batch.column("text"), CHUNK):
                hashes, begins, *_ = tokens(buf, offsets, of[at[first : first + rows]])
                if not len(h) or not len(hashes):
                    continue
                place = np.minimum(np.searchsorted(h, hashes), len(h) - 1)
                yield _keys(np.where(h[place] == hashes, ids[place], 0).astype(np.uint32), begins, borders, every)

    return texts.mapInArrow(run, _KEYS)


def range_borders(found: DataFrame, tasks: int):
    """The first keys of all ranges but the first, from a part of all keys."""
    import numpy as np

    some = [_ordered(_unpacked(r["keys"])) for r in found.select("keys").collect()]  # about BORDER_TOTAL keys
    some = np.sort(np.concatenate(some)) if some else np.zeros(0, f"S{4 * MAX_WORDS}")
    return np.unique(some[np.arange(1, tasks) * len(some) // tasks]) if len(some) else some


def _joined_keys(texts: DataFrame, words: DataFrame, borders, every: int) -> DataFrame:
    """The same keys with the numbers of the words found by a join, and the words of a piece put together again."""
    if words.groupBy("h").count().filter("count > 1").limit(1).count():
        raise ValueError("two words of the dictionary have one hash")

    def split(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from veilframe.llm import kernel as K

        for batch in batches:
            at, _, of = _langs(batch.column("lang"))
            row = batch.column("row").to_numpy()
            for first, rows, buf, offsets in K.chunks(batch.column("text"), CHUNK):
                hashes, begins, counts, *_ = tokens(buf, offsets, of[at[first : first + rows]])
                where = np.arange(len(hashes))
                piece = np.maximum.accumulate(np.where(begins, where, 0)) if len(where) else where
                text = np.repeat(row[first : first + rows], counts)
                yield pa.RecordBatch.from_arrays([pa.array(text), pa.array(piece), pa.array(where - piece), pa.array(hashes.view(np.int64))], names=["row", "piece", "pos", "h"])

    def pack(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            found = batch.column("found")
            size = found.value_lengths().to_numpy()
            pos, ids = (found.flatten().field(k).to_numpy() for k in (0, 1))
            begins = np.zeros(len(pos), bool)
            begins[(np.cumsum(size) - size)] = True  # a piece has one known word at least
            begins[1:] |= pos[1:] != pos[:-1] + 1
            yield _keys(ids.astype(np.uint32), begins, borders, every)

    rows = texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(split, "row long, piece long, pos long, h long")
    rows = rows.join(words.select("h", F.conv(F.hex("key"), 16, 10).cast("long").alias("id")), "h")
    pieces = rows.groupBy("row", "piece").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("found"))
    return pieces.select("found").mapInArrow(pack, _KEYS)


def phrase_counts(found: DataFrame, tasks: int, min_count: int = MIN_COUNT) -> DataFrame:
    """phrase (numbers of four bytes), f of all phrases of two words or more with f >= min_count, from keys; a range is
    counted by one task."""

    def runs(parts: list) -> Iterator:
        import numpy as np
        import pyarrow as pa

        ids, n = _combined(*(np.concatenate(x) for x in zip(*parts)))
        same = ids[1:] == ids[:-1]
        for k in range(2, MAX_WORDS + 1):
            firsts = np.flatnonzero(np.r_[True, ~same[:, :k].all(axis=1)])
            f = np.add.reduceat(n, firsts)
            stay = f >= min_count
            stay[[0, -1]] = True  # may go on in the ranges beside this one
            stay &= ids[firsts, k - 1] > 0
            body = np.ascontiguousarray(ids[firsts[stay], :k].astype(">u4"))
            phrase = pa.Array.from_buffers(pa.binary(4 * k), len(body), [None, pa.py_buffer(body)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([phrase, pa.array(f[stay])], names=["phrase", "f"])

    def count(batches: Iterator) -> Iterator:
        import numpy as np

        at, parts, held, known = None, [], 0, 2 * TASK_KEYS
        for batch in batches:
            for part, ids, n in zip(batch.column("part").to_pylist(), batch.column("keys"), batch.column("n")):
                if part != at:
                    if parts:
                        yield from runs(parts)
                    at, parts, held, known = part, [], 0, 2 * TASK_KEYS
                parts.append(_unpacked(ids.as_buffer(), n.as_buffer()))
                held += len(parts[-1][0])
                if held > 2 * known:  # keys that come again and again are combined on the way
                    parts = [_combined(*(np.concatenate(x) for x in zip(*parts)))]
                    held = known = max(known, len(parts[0][0]))
        if parts:
            yield from runs(parts)

    dealt = found.repartitionById(max(1, tasks), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(count, "phrase binary, f long").groupBy("phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= min_count)


#: floor(1000 a n / (l r)) in whole numbers of up to 38 digits.
_SCORE = "(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))) div (CAST(c.l AS DECIMAL(19,0)) * CAST(c.r AS DECIMAL(19,0)))"


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language; see the module."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    words, totals, size = dictionary(texts, min_count)
    places = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks, shared, borders = -(-places // TASK_KEYS), None, None
    if size <= broadcast_words:
        shared = known_words(words)
    if tasks > 1:
        share = min(BORDER_KEYS * tasks, BORDER_TOTAL) / places
        of_texts = min(1.0, share * BORDER_TEXTS)
        some = keys(texts.sample(of_texts, 13), words, size, broadcast_words, shared=shared, every=max(1, round(of_texts / share)))
        borders = range_borders(some, tasks)
    counts, _ = materialize(phrase_counts(keys(texts, words, size, broadcast_words, borders, shared), tasks, min_count), "phrase-counts")
    # phrases that a longer one always holds; if any longer one does, so does one that is longer by a word
    held = counts.filter(F.octet_length("phrase") > 8)
    cuts = F.array(F.expr("substring(phrase, 1, octet_length(phrase) - 4)"), F.expr("substring(phrase, 5)"))
    held = held.select(F.explode(cuts).alias("phrase"), F.col("f").alias("longer")).groupBy("phrase").agg(F.max("longer").alias("longer"))
    left = counts.join(held, "phrase", "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("f"))).select("phrase", F.col("f").alias("a"))
    # the two parts of each cut
    known = counts.select("phrase", "f", F.lit(None).cast("string").alias("lang")).unionByName(words.select(F.col("key").alias("phrase"), F.col("n").alias("f"), "lang"))
    cut = left.select("phrase", "a", F.explode(F.expr("sequence(1, octet_length(phrase) div 4 - 1)")).alias("k"))
    cut = cut.select("*", F.expr("substring(phrase, 1, 4 * k)").alias("head"), F.expr("substring(phrase, 4 * k + 1)").alias("tail"))
    cut = cut.join(known.select(F.col("phrase").alias("head"), F.col("f").alias("l"), "lang"), "head").join(known.select(F.col("phrase").alias("tail"), F.col("f").alias("r")), "tail")
    cut = cut.groupBy("phrase", "a").agg(F.max("lang").alias("lang"), F.collect_list(F.struct("k", "l", "r")).alias("cuts")).join(totals, "lang")  # four cuts at most
    out = cut.withColumn("s", F.expr(f"array_min(transform(cuts, c -> struct({_SCORE} AS score, c.k AS k, c.l AS l, c.r AS r)))")).select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")
    in_lang = Window.partitionBy("lang")
    out = out.withColumn("place", F.rank().over(in_lang.orderBy(F.desc("score"), F.desc("a")))).filter(F.col("place") <= top)
    # words for numbers, for the best and those that tie with the last of them
    ids = out.select("phrase", F.explode(F.expr("sequence(0, octet_length(phrase) div 4 - 1)")).alias("i")).select("phrase", "i", F.expr("substring(phrase, 4 * i + 1, 4)").alias("key"))
    said = ids.join(words.select("key", "word"), "key").groupBy("phrase").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("said"))
    rank = F.row_number().over(in_lang.orderBy(F.desc("score"), F.desc("a"), F.asc("said"))).cast("long")
    out = out.join(said, "phrase").withColumn("rank", rank).filter(F.col("rank") <= top)
    return out.select("lang", "rank", F.col("said").alias("phrase"), "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM w, unnest(range(1, 6)) AS s(k), unnest(range(1, len(ws) - k + 2)) AS r(i)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
h AS (SELECT c.lang, array_to_string(c.ws[i : i + m - 1], ' ') AS phrase, max(c.a) AS longer
      FROM c, unnest(range(2, c.k)) AS s(m), unnest(range(1, c.k - m + 2)) AS r(i) GROUP BY ALL),
x AS (SELECT c.lang, c.phrase, c.a, j, array_to_string(ws[1 : j], ' ') AS head, array_to_string(ws[j + 1 : k], ' ') AS tail
      FROM c LEFT JOIN h ON c.lang = h.lang AND c.phrase = h.phrase, unnest(range(1, c.k)) AS s(j) WHERE longer IS NULL OR 100 * longer < 100 * c.a),
y AS (SELECT x.lang, x.phrase, x.a, j, fl.f AS l, fr.f AS r, t.n, CAST((1000::HUGEINT * x.a * t.n) // (fl.f::HUGEINT * fr.f) AS BIGINT) AS score
      FROM x JOIN f fl ON fl.lang = x.lang AND fl.phrase = head JOIN f fr ON fr.lang = x.lang AND fr.phrase = tail JOIN t ON t.lang = x.lang),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


def op13_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))
