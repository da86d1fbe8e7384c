"""Best-fit packing by a grouping genetic algorithm.

Documents become token pieces of at most ``CAPACITY`` ids; only longer documents are cut, and their first piece takes
the remainder.  Full pieces are sequences of their own.  The others are dealt at random into shards of about
``SHARD`` pieces.  On each shard, islands evolve groupings of all its pieces from best fit: crossover injects whole well-filled bins of one parent into another, bins that hold a piece twice are dissolved, and
displaced pieces first take the place of shorter ones wherever that leaves less space, then go where they fit best,
longest first.  Between epochs the best grouping of an island migrates to the next island; at the end the best island of a shard wins.
Bins that stay poorly filled are pooled over all shards, dealt anew and packed once more.

An island only holds lengths and row numbers, so its memory is bounded by the shard; token ids never leave the
tokenising task.  A shard whose best-fit-decreasing grouping already meets the lower bound needs no evolution.

Defined cases: null text is empty text (one piece: the end id); repeated rows and ids give pieces each; ties in length
are broken by row number; a very long text is cut into many pieces; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import math
import random
import zlib
from collections.abc import Iterator
from itertools import chain, compress
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.util import materialize, ship, table

CAPACITY = 1024
END_ID = 2
#: The special token of the vocabulary.
END_TEXT = "<|endoftext|>"
SHARD = 32_768
ISLANDS = 2
EPOCHS = 2
POPULATION = 6
GENERATIONS = 25
#: Bins filled less than this are pooled after the first round.
WELL_FILLED = 0.985
VOCABULARY = "byte_bpe_50k"

#: White space that the vocabulary's pattern looks back from: two of these characters side by side.
WHITE_RUN = "[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2}"
_AHEAD = r"|\s+(?!\S)"

_encoders: dict = {}


def encoder(vocabulary: str = VOCABULARY, folder: str | None = None):
    """A function from text to an array of ids, equal to the tokenizers library's on the JSON file of the same name.

    The rank file of the same vocabulary is several times faster; texts that name the special token, which the JSON
    file gives an id of its own, go through the JSON file itself.  Only where white space follows white space does the pattern
    need to look ahead; a caller that knows a text to have none such (``runs=False``) has it cut in one pass.
    """
    if (vocabulary, folder) not in _encoders:
        import base64
        import os
        from functools import cache

        import numpy as np
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = (lambda name: os.path.join(folder, name)) if folder else public_tokenizers.path
        with open(path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

        @cache
        def fast(runs: bool):
            pattern = public_tokenizers.PATTERN if runs else public_tokenizers.PATTERN.replace(_AHEAD, "")
            # without a special token the library looks for an empty one at every character
            return tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens={END_TEXT: max(ranks.values()) + 1})

        @cache
        def slow():
            return Tokenizer.from_file(path(f"{vocabulary}.json"))

        def encode(text: str, runs: bool = True):
            if END_TEXT in text:
                return np.array(slow().encode(text, add_special_tokens=False).ids, dtype="<u4")
            return fast(runs).encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

        _encoders[vocabulary, folder] = encode
    return _encoders[vocabulary, folder]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: only the first may be shorter."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _tokenise(batches: Iterator, vocabulary: str, folder: str | None, capacity: int) -> Iterator:
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    encode = encoder(vocabulary, folder)
    for batch in batches:
        rows: list[tuple] = []
        texts = batch.column("text")
        runs = pc.match_substring_regex(texts, WHITE_RUN).to_pylist()
        for at, text in enumerate(texts.to_pylist()):
            ids = np.append(encode(text or "", runs[at] is not False), np.uint32(END_ID)).astype("<u4")
            rows += [(at, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), capacity))]
        at, *cols = zip(*rows) if rows else ((),) * 5
        ids = batch.column("doc_id").take(pa.array(at, pa.int64())).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, folder: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: _tokenise(it, vocabulary, folder, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---- the genetic algorithm on one shard; a grouping is a list of bins, a bin a list of item numbers


class _Open:
    """Bins by free space, for best fit: the smallest free space that is enough, in a bit set."""

    def __init__(self, capacity: int):
        self.mask, self.by_space = 0, [[] for _ in range(capacity + 1)]
        self.capacity = capacity

    def put(self, items: list[int], space: int) -> None:
        self.by_space[space].append(items)
        self.mask |= 1 << space

    def fit(self, item: int, length: int) -> None:
        rest = self.mask >> length
        if not rest:
            self.put([item], self.capacity - length)
            return
        space = length + (rest & -rest).bit_length() - 1
        bins = self.by_space[space]
        chosen = bins.pop()
        if not bins:
            self.mask &= ~(1 << space)
        chosen.append(item)
        self.put(chosen, space - length)

    def bins(self) -> list[list[int]]:
        return [b for bins in self.by_space for b in bins]


def best_fit(lengths: list[int], items: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Items, longest first, each into the bin where it leaves the least space."""
    out = _Open(capacity)
    for b in bins:
        out.put(list(b), capacity - sum(lengths[i] for i in b))
    for i in sorted(items, key=lambda i: (-lengths[i], i)):
        out.fit(i, lengths[i])
    return out.bins()


def fitness(lengths: list[int], bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins are better; among equals, the mean squared fill, which rises as space gathers in few bins."""
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def bound(lengths: list[int], capacity: int) -> int:
    """A number of bins that no grouping goes below: for each size, longer pieces than fit beside it have bins of their own,
    the other halves have one each, and what is left of shorter ones fills what room these have."""
    import numpy as np

    counts = np.bincount(np.asarray(lengths, dtype=np.int64), minlength=capacity + 1)
    n, total = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    half = capacity // 2
    size = np.arange(1, half + 1)
    wide = n[capacity - size] - n[half]
    left = total[half] - total[size - 1] - (wide * capacity - (total[capacity - size] - total[half]))
    least = n[capacity] - n[half] + np.maximum(0, -(-left // capacity))
    return int(max(-(-total[capacity] // capacity), least.max(initial=0)))


#: A bin as islands hold it: how full it is, and its items.
Bin = tuple[int, list[int]]


def exchange(lengths: list[int], bins: list[Bin], displaced: list[int], capacity: int) -> tuple[list[Bin], list[int]]:
    """Fills bins further: one or two of a bin's items give way to a displaced one, one to two displaced ones, wherever
    that leaves less space.  Returns the bins and who is displaced now; each step fills a bin more, so it ends."""
    free = sorted((lengths[i], i) for i in displaced)
    changed: list[Bin] = []

    def take(low: int, high: int) -> int | None:
        """The longest displaced item with low < length <= high leaves the list."""
        k = bisect.bisect_right(free, (high, math.inf)) - 1
        return free.pop(k)[1] if k >= 0 and free[k][0] > low else None

    for fill, b in bins:
        if not free:
            changed.append((fill, b))
            continue
        space, b, better = capacity - fill, list(b), True
        while space and free and better:
            better = False
            for out in [(i,) for i in b] + [(i, j) for k, i in enumerate(b) for j in b[:k]]:
                gone = sum(lengths[i] for i in out)
                came = [] if (one := take(gone, gone + space)) is None else [one]
                if not came and len(out) == 1:
                    for k in range(bisect.bisect_right(free, (gone + space, math.inf)) - 1, -1, -1):
                        rest = gone + space - free[k][0]
                        if 2 * free[k][0] <= gone:
                            break
                        at = bisect.bisect_right(free, (rest, math.inf), 0, k) - 1
                        if at >= 0 and free[at][0] + free[k][0] > gone:
                            came = [free.pop(k)[1], free.pop(at)[1]]
                            break
                if came:
                    for i in out:
                        b.remove(i)
                        bisect.insort(free, (lengths[i], i))
                    b += came
                    space -= sum(lengths[i] for i in came) - gone
                    better = True
                    break
        changed.append((capacity - space, b))
    return changed, [i for _, i in free]


def repair(lengths: list[int], bins: list[Bin], displaced: list[int], capacity: int) -> list[Bin]:
    """Bins that are full stay as they are; the others are filled further, and who is displaced then goes where it fits best."""
    full = [x for x in bins if x[0] == capacity]
    bins, displaced = exchange(lengths, [x for x in bins if x[0] < capacity], displaced, capacity)
    out = _Open(capacity)
    for fill, b in bins:
        if fill < capacity:
            out.put(list(b), capacity - fill)
    for i in sorted(displaced, key=lambda i: (-lengths[i], i)):
        out.fit(i, lengths[i])
    return full + [x for x in bins if x[0] == capacity] + [(capacity - space, b) for space, held in enumerate(out.by_space) for b in held]


def crossover(lengths: list[int], a: list[Bin], b: list[Bin], capacity: int, rng: random.Random) -> list[Bin]:
    """Well-filled bins of b go into a whole; a's bins that share an item with them are dissolved."""
    good = sorted(b, key=itemgetter(0), reverse=True)[: max(1, len(b) // 2)]
    chosen = rng.getrandbits(len(good))
    injected = list(compress(good, map(int, f"{chosen:0{len(good)}b}"))) or good[:1]
    taken = set(chain.from_iterable(map(itemgetter(1), injected)))
    stay, displaced = [], []
    free = taken.isdisjoint
    for x in a:
        if free(x[1]):
            stay.append(x)
        else:
            displaced += [i for i in x[1] if i not in taken]
    return repair(lengths, [*injected, *stay], displaced, capacity)


def mutate(lengths: list[int], bins: list[Bin], capacity: int, rng: random.Random) -> list[Bin]:
    """The emptiest bins and a few others are dissolved and their items packed anew."""
    order = sorted(bins, key=itemgetter(0))
    gone = max(1, len(order) // 10)
    picked = {*range(gone), *(rng.randrange(len(order)) for _ in range(gone))}
    return repair(lengths, [x for k, x in enumerate(order) if k not in picked], [i for k in picked for i in order[k][1]], capacity)


def _fitness(bins: list[Bin], capacity: int) -> tuple[int, float]:
    return -len(bins), sum([fill * fill for fill, _ in bins]) / capacity**2 / max(1, len(bins))


def evolve(lengths: list[int], seeds: list[list[list[int]]], capacity: int, seed: int, generations: int = GENERATIONS, population: int = POPULATION) -> list[list[int]]:
    """The best grouping found from the seeds and best fit.  All items take part in each generation; where the fewest bins
    that can be are reached, there is nothing to evolve."""
    first = best_fit(lengths, list(range(len(lengths))), [], capacity)
    least = bound(lengths, capacity)
    if (best := min([*seeds, first], key=len)) and len(best) <= least:
        return best
    rng = random.Random(seed)
    pool = [[(sum(lengths[i] for i in b), b) for b in x] for x in [*seeds, first] if x]
    if not pool:
        return best
    pool.sort(key=lambda x: _fitness(x, capacity), reverse=True)
    while len(pool) < population:
        pool.append(mutate(lengths, pool[0], capacity, rng))
    scored = sorted(((_fitness(x, capacity), x) for x in pool), key=lambda x: x[0], reverse=True)[:population]
    for _ in range(generations):
        if -scored[0][0][0] <= least:
            break
        a, b = scored[0][1], scored[rng.randrange(1, len(scored))][1]
        for child in (crossover(lengths, a, b, capacity, rng), mutate(lengths, crossover(lengths, b, a, capacity, rng), capacity, rng)):
            scored.append((_fitness(child, capacity), child))
        # equal groupings would leave nothing to cross
        scored = sorted({s[0]: s for s in reversed(scored)}.values(), key=lambda x: x[0], reverse=True)[:population]
        if len(scored) == 1:
            child = mutate(lengths, scored[0][1], capacity, rng)
            scored = sorted([scored[0], (_fitness(child, capacity), child)], key=lambda x: x[0], reverse=True)
    return [b for _, b in scored[0][1]]


def _groups(pdf, keys: list[int]) -> list[list[list[int]]]:
    """The groupings that the rows carry: one for each value of the column ``of``."""
    out = []
    for _, part in pdf.groupby("of"):
        bins: dict[int, list[int]] = {}
        for item, b in zip(part["item"], part["bin"]):
            bins.setdefault(b, []).append(keys[item])
        out.append(list(bins.values()))
    return out


def _epoch(pdf, capacity: int, islands: int, epoch: int):
    """One island of one shard: evolves what it has and passes its best on, to itself and to the next island."""
    import pandas as pd

    shard, island = int(pdf["shard"].iloc[0]), int(pdf["island"].iloc[0])
    known = pdf.drop_duplicates("item").sort_values(["length", "item"], ascending=[False, True])
    items, lengths = known["item"].tolist(), known["length"].tolist()
    at = {item: k for k, item in enumerate(items)}
    seeds = _groups(pdf[pdf["of"] >= 0], at) if (pdf["of"] >= 0).any() else []
    best = evolve(lengths, seeds, capacity, hash((shard, island, epoch)) & 0x7FFFFFFF)
    rows = [(items[i], lengths[i], b) for b, bin_ in enumerate(best) for i in bin_]
    one = pd.DataFrame(rows, columns=["item", "length", "bin"]).assign(shard=shard, of=island, score=fitness(lengths, best, capacity)[1] - len(best))
    return pd.concat([one.assign(island=to) for to in sorted({island, (island + 1) % islands})])[["shard", "island", "of", "item", "length", "bin", "score"]]


def _in_epoch(epoch: int, capacity: int, islands: int):
    return lambda pdf: _epoch(pdf, capacity, islands, epoch)


def _winner(pdf, capacity: int, round_: int):
    """The best island's grouping of a shard, with places in the bins."""
    best = pdf["of"][pdf["score"] == pdf["score"].max()].min()
    rows = pdf[(pdf["of"] == best)].drop_duplicates("item").sort_values(["bin", "item"])
    after = rows.groupby("bin")["length"].cumsum()
    return rows.assign(
        sequence_id=(round_ << 60) + (int(pdf["shard"].iloc[0]) << 24) + rows["bin"], offset=after - rows["length"], fill=rows.groupby("bin")["length"].transform("sum")
    )[["item", "length", "sequence_id", "offset", "fill"]]


_ROW = "shard long, island int, of int, item long, length long, bin long, score double"


def _round(items: DataFrame, n: int, round_: int, capacity: int, islands: int, epochs: int, shard: int) -> DataFrame:
    """items (item, length) grouped: item, length, sequence_id, offset, fill."""
    n_shards = max(1, math.ceil(n / shard))
    state = items.select(
        F.pmod(F.xxhash64("item", F.lit(round_)), F.lit(n_shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(-1).alias("of"), "item", "length", F.lit(-1).cast("long").alias("bin"), F.lit(0.0).alias("score")
    )
    # a group is seconds of work on few bytes: left to themselves, shuffles this small are put together into a few tasks
    tasks = 2 * n_shards * islands
    for epoch in range(epochs):
        state = state.repartition(tasks, "shard", "island").groupBy("shard", "island").applyInPandas(_in_epoch(epoch, capacity, islands), _ROW)
    home = state.filter(F.col("island") == F.col("of")).repartition(2 * n_shards, "shard")
    return home.groupBy("shard").applyInPandas(lambda pdf: _winner(pdf, capacity, round_), "item long, length long, sequence_id long, offset long, fill long")


def pack(pieces_: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, shard: int = SHARD) -> DataFrame:
    """Rows of pieces (column length) with sequence_id and offset."""
    spark = pieces_.sparkSession
    ship(spark)
    # Written once: tokens are not made again, and row numbers stay what they are if a task is run anew.
    kept, _ = materialize(pieces_.withColumn("item", F.monotonically_increasing_id()), "pieces")
    full = kept.filter(F.col("length") == capacity).withColumn("sequence_id", F.col("item") - F.lit(2**62)).withColumn("offset", F.lit(0).cast("long"))
    rest = kept.filter(F.col("length") < capacity)
    first, _ = materialize(_round(rest.select("item", "length"), rest.count(), 1, capacity, islands, epochs, shard), "packed")
    poor = F.col("fill") < WELL_FILLED * capacity
    again = first.filter(poor).select("item", "length")
    second = _round(again, again.count(), 2, capacity, islands, epochs, shard)
    placed = first.filter(~poor).unionByName(second).select("item", "sequence_id", "offset")
    return full.unionByName(rest.join(placed, "item")).drop("item")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents").select("doc_id", "text")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline form, the last stage: a row for each piece."""
    return pack(pieces(docs.select("doc_id", "text")))
