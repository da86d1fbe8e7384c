"""The operators with Python kernels against plain versions, libraries and held-out data."""

import collections
import math
import random
import struct
import zlib

import numpy as np
import plain
import public_tokenizers
import pyarrow as pa
import pytest

from veilframe.llm import kernel, katz, media, ngram_join, packing, quality_fm, sp_viterbi


# ---- words


def test_word_kernel():
    texts = ["", "a b", "  x\ty\n", "ab", "AB c", None, "é ü", "a" * 5000, "end", "start of the next"]
    for size in (1, 7, 1 << 20):
        hashes, counts = [], []
        for _, _, buf, offsets in kernel.chunks(pa.array(texts), size):
            h, n, _ = kernel.word_hashes(buf, offsets, lower=True)
            hashes += h.tolist()
            counts += n.tolist()
        want = [plain.words(plain.lower(t)) for t in texts]
        assert counts == [len(w) for w in want]
        seen = {}
        for h, w in zip(hashes, [x for ws in want for x in ws]):
            assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


# ---- quality classifier


def test_quality_held_out(spark):
    out = quality_fm.op1_quality_classifier(spark, "/root/testdata/sf0.01").toPandas()
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.5)).all()
    assert all(bool(h) == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(out.doc_id, out.held_out))
    held = out[out.held_out].merge(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas(), on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.97


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(1)
    m = quality_fm.Machine(0.3, rng.normal(size=quality_fm.BUCKETS + quality_fm.NUMBERS), rng.normal(size=(quality_fm.BUCKETS + quality_fm.NUMBERS, 3)), np.zeros(quality_fm.NUMBERS), np.ones(quality_fm.NUMBERS))
    idx, val, raw = np.array([3, 9, 77]), np.array([0.5, 1.0, 0.2]), rng.normal(size=(1, quality_fm.NUMBERS))
    x = np.concatenate([val, m.numbers(raw)[0]])
    i = np.concatenate([idx, np.arange(quality_fm.BUCKETS, quality_fm.BUCKETS + quality_fm.NUMBERS)])
    z = m.w0 + m.w[i] @ x + sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
    assert math.isclose(m.score(np.zeros(3, int), idx, val, raw)[0], 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    out = quality_fm.score(odd, quality_fm.train(odd, labels)).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    none = quality_fm.train(odd, labels.limit(0))
    assert {round(r.score, 6) for r in quality_fm.score(odd, none).collect()} == {0.5}


# ---- packing


def check_packing(pdf, texts):
    encode = packing.encoder()
    for i, t in texts.items():
        ids = np.append(encode(t or ""), 2).astype("<u4")
        rows = pdf[pdf.doc_id == i].sort_values("piece")
        assert rows.start.tolist() == [s for s, _ in packing.cut(len(ids))] and rows.length.sum() == len(ids)
        assert rows.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in packing.cut(len(ids))]
    for _, rows in pdf.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.length.sum() <= packing.CAPACITY and rows.offset.tolist() == (rows.length.cumsum() - rows.length).tolist()


def test_packing_documents(spark, sf_dir, docs):
    pdf = packing.op3_best_fit_packing(spark, sf_dir).toPandas()
    check_packing(pdf, {r.doc_id: r.text for r in docs.collect()})
    assert pdf.sequence_id.nunique() <= math.ceil(pdf.length.sum() / packing.CAPACITY) * 1.02 + 1


def test_packing_cuts_white_space_as_the_library(spark):
    """Texts without white space beside white space are cut by a pattern that looks nowhere ahead; the ids are the same."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\u0085", "\u00a0", "\u2003", "\u3000", "\x1c", "\u200b", "a", "don't", "12", "é", "!?", "日本", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(2000)] + [None, "a" + chr(0x85) * 2 + "b"]
    single = [t for t in texts if t and not any(a.isspace() and b.isspace() for a, b in zip(t, t[1:]))]
    assert len(single) > 100
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: zlib.crc32(np.array(slow.encode(t or "", add_special_tokens=False).ids + [packing.END_ID], dtype="<u4").tobytes()) for i, t in enumerate(texts)}
    got = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), capacity=1 << 20).collect()
    assert {r.doc_id: r.ids_crc32 for r in got} == want
    encode = packing.encoder()
    assert all(encode(t, False).tolist() == encode(t).tolist() == slow.encode(t, add_special_tokens=False).ids for t in single)


def test_packing_islands_are_not_put_together_into_few_tasks(spark):
    """The bytes of a shard are few and its evolution long, so shuffles must not be coalesced by their size."""
    from pyspark.sql import functions as F

    items = spark.range(400).select(F.col("id").alias("item"), (F.col("id") % 97 + 300).cast("long").alias("length"))
    one = packing._round(items, 400, 1, packing.CAPACITY, 2, 2, 10)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 3
    dealt = one.select("sequence_id", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({r.task for r in dealt}) > 10 and len({r.sequence_id >> 24 for r in dealt}) == 40


def test_packing_odd_rows(spark, odd):
    pdf = packing.pack(packing.pieces(odd)).toPandas()
    assert pdf.groupby("sequence_id").length.sum().max() <= packing.CAPACITY and pdf[pdf.piece == 0].shape[0] == odd.count()
    assert packing.pack(packing.pieces(odd.limit(0))).count() == 0
    assert packing.cut(1) == [(0, 1)] and packing.cut(1024) == [(0, 1024)] and packing.cut(1025) == [(0, 1), (1, 1024)]


def test_fast_encoder_equals_the_library(docs):
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder()
    rng = random.Random(4)
    odd = [*map(chr, (0, 9, 10, 13, 32, 0x85, 0xA0, 0x200B, 0x2028, 0x3000, 0x301, 0x130, 0x1E9E, 0xFEFF, 0xFFFD, 0x1F600, 0x10FFFF)), *"aZ09'_-.\u00e9\u03b1\u0436\u4e2d\u0627\u0e01\ud55c", "'s", "  ", "\n\n", "don't", "123", "<|", "|>"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += [r.text for r in docs.collect()] + ["", "<|endoftext|> x <|endoftext|>", " \n\n  a", "é🙂 日本", "don't we'll", "x" * 3000]
    assert all(fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids for t in texts)


def test_evolution_beats_or_meets_best_fit():
    rng = random.Random(3)
    for _ in range(5):
        lengths = [rng.randrange(200, 700) for _ in range(200)]
        plain_ = packing.best_fit(lengths, list(range(200)), [], 1024)
        best = packing.evolve(lengths, [], 1024, seed=5)
        assert sorted(i for b in best for i in b) == list(range(200)) and len(best) <= len(plain_)
        assert all(sum(lengths[i] for i in b) <= 1024 for b in best)


def test_evolution_beats_best_fit_where_that_is_bad():
    rng = random.Random(1)
    for triples in (20, 80):  # three items fill each bin exactly, which best fit does not see
        lengths = []
        for _ in range(triples):
            a = rng.randrange(390, 500)
            b = rng.randrange(256, (1024 - a) // 2 + 1)
            lengths += [a, b, 1024 - a - b]
        plain_ = packing.best_fit(lengths, list(range(len(lengths))), [], 1024)
        best = packing.evolve(lengths, [], 1024, seed=5)
        assert len(best) < len(plain_) * 0.95 and len(best) <= triples * 1.05 + 1
        again = packing.evolve(lengths, [best], 1024, seed=6)
        assert sorted(i for b in again for i in b) == list(range(len(lengths))) and len(again) <= len(best)


def test_evolution_finds_the_optimum_of_small_cases():
    rng = random.Random(2)
    for case in range(60):
        lengths = [rng.randrange(100, 700) for _ in range(8)]
        best = [(0, 0)] + [(99, 0)] * 255  # fewest bins, and the least fill of the last one, of each subset
        for m in range(1, 256):
            for i in range(8):
                if m >> i & 1:
                    bins, fill = best[m ^ 1 << i]
                    best[m] = min(best[m], (bins, fill + lengths[i]) if bins and fill + lengths[i] <= 1024 else (bins + 1, lengths[i]))
        assert len(packing.evolve(lengths, [], 1024, seed=case)) == best[-1][0]


def test_all_pieces_of_a_shard_take_part(monkeypatch):
    rng = random.Random(4)
    lengths = []
    for _ in range(700):  # 2100 pieces: three fill each bin exactly
        a = rng.randrange(390, 500)
        b = rng.randrange(256, (1024 - a) // 2 + 1)
        lengths += [a, b, 1024 - a - b]
    held, plain_repair = [], packing.repair
    monkeypatch.setattr(packing, "repair", lambda n, bins, displaced, c: held.append(sum(len(b[1]) for b in bins) + len(displaced)) or plain_repair(n, bins, displaced, c))
    best = packing.evolve(lengths, [], 1024, seed=5)
    assert held and min(held) == len(lengths)
    assert sorted(i for b in best for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 1024 for b in best)
    assert len(best) <= 700 * 1.05 < len(packing.best_fit(lengths, list(range(len(lengths))), [], 1024)) * 0.93


def test_no_grouping_goes_below_the_bound():
    assert [packing.bound(x, 10) for x in ([], [10], [6, 6, 6], [6, 6, 4, 4], [9, 9, 2], [5, 5, 5], [1] * 11)] == [0, 1, 3, 2, 3, 2, 2]


# ---- media


def test_media_payloads(spark, sf_dir, docs):
    import hashlib

    got = {r.doc_id: r for r in media.op5_media_columns(spark, sf_dir).collect()}
    for r in docs.collect():
        raw = (r.text or "").encode()
        padded = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        x = got[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert x.media_bytes == len(padded) + 44 and x.feature.startswith("audio/wav;")


def png():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_sniffing(spark):
    import gzip
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b")
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00" + bytes(6) + b",\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02\x12\xff\x00\x34\xff\xd9"
    pdf = b"%PDF-1.4\nx\nstartxref\n0\n%%EOF"
    for kind, data in (("image/png", png()), ("image/gif", gif), ("image/jpeg", jpeg), ("application/gzip", gzip.compress(b"x" * 99)), ("application/zip", z.getvalue()), ("application/pdf", pdf), ("audio/wav", media.wav_of(b"ab" * 32))):
        assert media.sniff_bytes(data, "text/plain") == (kind, [])
        assert media.sniff_bytes(b"junk" + data + b"more", "text/plain") == ("text/plain", [(kind, 4, len(data))])
        assert media.sniff_bytes(data[:-3] + b"!!", "text/plain")[0] == "text/plain" or kind in ("application/pdf",)
    twice = pdf + b"\nupdate\nstartxref\n9\n%%EOF"
    assert media.sniff_bytes(b"x" + twice + b"y" + pdf, "text/plain")[1] == [("application/pdf", 1, len(twice)), ("application/pdf", len(twice) + 2, len(pdf))]
    end = z.getvalue()
    lying = end[:-2] + struct.pack("<H", 50_000)  # an end record that claims a comment beyond the value
    assert media.sniff_bytes(b"x" + lying, "text/plain") == ("text/plain", []) and media.sniff_bytes(b"x" + end[:-2] + b"\x02\x00hi", "text/plain")[1] == [("application/zip", 1, len(end) + 2)]
    assert media.sniff_bytes(None) == (None, []) and media.sniff_bytes(b"RIFFxxxx") == (None, [])
    inner = media.wav_of(png() + bytes(-len(png()) % 2))
    assert media.sniff_bytes(inner) == ("audio/wav", [("image/png", 44, len(png()))])
    df = spark.createDataFrame([(1, bytearray(png()), "text/html"), (2, None, "x")], "id int, data binary, said string")
    got = {r.id: r.media for r in media.sniff(df, "data", "said").collect()}
    assert got[1].type == "image/png" and got[2].type is None


def test_media_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    out = media.op5_media_columns(spark, str(tmp_path)).collect()
    assert len(out) == odd.count() and {r.payload_bytes for r in out if r.n_bytes == 0} == {64}


# ---- SentencePiece


@pytest.fixture(scope="module")
def processor():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sp_viterbi.MODEL))


def test_codec_equals_the_library(docs, processor):
    rng = random.Random(2)
    c = sp_viterbi.codec()
    texts = [r.text for r in docs.limit(80).collect()] + ["", " ", "  a  b   ", "    " * 9, "\n\n\ta", "日本語", "x" * 500, "ab" * 300, "-" * 100, "🙂 <s> </s> <0x41>", "a_b __init__ m². x"]
    texts += ["".join(rng.choice("aeiou ▁\n-=*_.thren²") for _ in range(400)) for _ in range(20)]
    for t in texts:
        ids = np.frombuffer(c.encode_bytes(t), "<i4").tolist()
        assert ids == processor.encode(t)
        assert c.decode_ids(ids) == processor.decode(ids)


def test_search_is_streamed(processor):
    c = sp_viterbi.codec()
    text = sp_viterbi.MARK + "the quick brown fox jumps over it again ".replace(" ", sp_viterbi.MARK) * 200
    for step in (1, 5, 1000):
        s, out, most = sp_viterbi.StreamingViterbi(c.model), [], 0
        for i in range(0, len(text), step):
            out += s.feed(text[i : i + step])
            most = max(most, len(s.tail))
        assert out + s.close() == processor.encode(text[1:].replace(sp_viterbi.MARK, " ")) and most < 8 * s.window


def test_ids_are_committed_where_paths_converge(docs, processor):
    c = sp_viterbi.Codec(public_tokenizers.path(sp_viterbi.MODEL))
    search = c.parts.search
    for r in docs.limit(40).collect():
        c.encode_bytes(r.text or "")
    assert search.commits == len(c.parts) > 1000  # one at each boundary that no piece crosses
    before = search.commits
    text = "".join(random.Random(5).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    assert np.frombuffer(c.encode_bytes(text), "<i4").tolist() == processor.encode(text)
    assert search.commits - before > 20  # within one stretch of letters


def test_sentencepiece_rows(spark, odd):
    out = sp_viterbi.encode(odd)
    rows = out.collect()
    assert len(rows) == odd.count() and all(r.decoded_ok for r in rows) and {r.n_ids for r in rows if r.doc_id in (0, 1)} == {0}
    back = sp_viterbi.decode(out.drop("doc_id")).collect()
    assert sorted(r.text for r in back) == sorted(r.text or "" for r in odd.collect())
    assert sp_viterbi.encode(odd.limit(0)).count() == 0


# ---- language model


def small_corpus(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(vocab[: 5 + 35 * (rng.random() < 0.3)]) for _ in range(rng.randrange(0, 30)))) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def unigrams(c):
    """P(b) from plain counts: discounted, the rest shared by the slots of unknown words."""
    n, d = sum(c.values()), katz.discounts(collections.Counter(c.values()))
    kept = lambda k: k * (d[k] if k < len(d) else 1.0)
    share = sum(map(kept, c.values())) / n
    s = (1 - 1 / (n + 1)) / share if 1 - share < 1 / (n + 1) else 1.0
    return lambda b: s * kept(c[b]) / n if c[b] else (1 - s * share) / katz.CLASSES


def test_lm_base_columns_and_direct_scores(spark):
    from pyspark.sql import functions as F

    df, rows = small_corpus(spark)
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    docs = df.withColumn("held_out", katz.held_out(F.col("doc_id")))
    from veilframe.llm.util import ship

    ship(spark)
    trained = katz.train(docs.filter("NOT held_out"))
    got = {r.doc_id: r for r in katz.score(docs, trained).collect()}
    toks = {i: plain.words(plain.lower(t)) + [None] for i, t in rows}
    c = collections.Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in toks.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
    # the same probabilities, evaluated one token at a time from plain counts
    pairs = collections.Counter((a, b) for i, ws in toks.items() if not held[i] for a, b in zip(["^", *ws], ws))
    d = katz.discounts(collections.Counter(pairs.values()))
    p1 = unigrams(c)
    assert math.isclose(sum(map(p1, c)) + katz.CLASSES * p1("never"), 1.0, rel_tol=1e-9)
    total, kept, seen = collections.Counter(), collections.Counter(), collections.defaultdict(float)
    for (a, b), r in pairs.items():
        total[a] += r
        kept[a] += r * (d[r] if r < len(d) else 1.0)
        seen[a] += p1(b)

    def prob(a, b):
        if not total[a]:
            return p1(b)
        share, least = kept[a] / total[a], 1 / (total[a] + 1)
        s = (1 - least) / share if 1 - share < least else 1.0
        if (r := pairs[a, b]):
            return s * (d[r] if r < len(d) else 1.0) * r / total[a]
        return (1 - s * share) / (1 - seen[a]) * p1(b)

    for a in list(total)[:15]:  # exactly normalised
        assert math.isclose(sum(prob(a, b) for b in c) + (1 - sum(p1(b) for b in c)) * (prob(a, "never") / p1("never") if True else 0), 1.0, rel_tol=1e-9)
    for i, ws in list(toks.items())[:80]:
        if all(c[w] for w in ws):
            assert math.isclose(got[i].score, sum(math.log10(prob(a, b)) for a, b in zip(["^", *ws], ws)), rel_tol=1e-9)


def test_lm_beats_its_base_and_takes_odd_rows(spark, odd, tmp_path):
    out = katz.op8_lm_scoring(spark, "/root/testdata/sf0.01").filter("held_out").toPandas()
    assert out.score.sum() > out.base_score.sum() and np.isfinite(out.score).all()
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    rows = katz.op8_lm_scoring(spark, str(tmp_path)).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) for r in rows)
    odd.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert katz.op8_lm_scoring(spark, str(tmp_path / "none")).count() == 0


def test_discounts_leave_mass():
    assert all(0 < x < 1 for x in katz.discounts({1: 1000, 2: 300, 3: 120, 4: 70, 5: 40, 6: 30})[1:])
    assert all(0 < x < 1 for x in katz.discounts({})[1:]) and all(0 < x < 1 for x in katz.discounts({1: 1, 2: 50})[1:])


def test_lm_rare_words_stay_units_of_their_own(spark, monkeypatch):
    """Every word keeps its own pairs, however few words and pairs the cache takes and however the tokens are dealt."""
    from pyspark.sql import functions as F
    from veilframe.llm.util import ship

    ship(spark)
    df, rows = small_corpus(spark)
    docs = df.withColumn("held_out", katz.held_out(F.col("doc_id"))).unionByName(spark.createDataFrame([(-1, "w3 zz w4 w39 w38", True)], "doc_id long, text string, held_out boolean"))
    rows = [*rows, (-1, "w3 zz w4 w39 w38")]
    monkeypatch.setattr(katz, "UNITS", 12)
    monkeypatch.setattr(katz, "PAIRS", 40)
    monkeypatch.setattr(katz, "BUCKET", 700)
    trained = katz.train(docs.filter("NOT held_out"))
    assert trained[3] > 3
    got = {r.doc_id: r for r in katz.score(docs, trained).collect()}
    toks = {i: plain.words(plain.lower(t)) + [None] for i, t in rows}
    train = [i for i in toks if not got[i].held_out]
    c = collections.Counter(w for i in train for w in toks[i])
    assert sum(12 * k < sum(c.values()) for k in c.values()) > 20  # most words are below the cache's count
    pairs = collections.Counter((a, b) for i in train for a, b in zip(["^", *toks[i]], toks[i]))
    d = katz.discounts(collections.Counter(pairs.values()))
    p1 = unigrams(c)
    after = collections.defaultdict(dict)
    for (a, b), r in pairs.items():
        after[a][b] = r

    def prob(a, b):
        if not after.get(a):
            return p1(b)
        total, kept = sum(after[a].values()), sum(r * (d[r] if r < len(d) else 1.0) for r in after[a].values())
        s = max(1 - 1 / (total + 1), 0) / (kept / total) if 1 - kept / total < 1 / (total + 1) else 1.0
        if (r := pairs[a, b]):
            return s * (d[r] if r < len(d) else 1.0) * r / total
        return (1 - s * kept / total) / (1 - sum(map(p1, after[a]))) * p1(b)

    for i, ws in toks.items():
        assert math.isclose(got[i].score, sum(math.log10(prob(a, b)) for a, b in zip(["^", *ws], ws)), rel_tol=1e-9)
        assert got[i].n_known == sum(c[w] > 0 for w in ws)


# ---- n-gram join


def check_join(rows, texts):
    links = plain.jaccard_links(texts)
    n = collections.Counter(i for pair in links for i in pair)
    cls = plain.classes(len(texts), links)
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == {i: (cls[i], n[i]) for i in range(len(texts))}


@pytest.mark.parametrize("block", [2, 256])
def test_join_against_brute_force(spark, block):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 120))] for _ in range(30)]
    texts = [" ".join(b) for b in base]
    for b in base[:20]:
        for _ in range(4):
            c = list(b)
            for _ in range(rng.randrange(0, 3)):
                c[rng.randrange(len(c))] = f"n{rng.randrange(99)}"
            texts.append(" ".join(c).upper() if rng.random() < 0.2 else " ".join(c))
    texts += ["", None, " ", "one", "ONE", "a b c d", "a b c d e", "A  b\tc d e"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_join(ngram_join.join_documents(df, block=block).collect(), texts)


def test_join_large_group_of_near_copies(spark):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join([*words, f"tail{i}"]) for i in range(150)] + ["other words only here now then"]
    out = {r.doc_id: r for r in ngram_join.join_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=16).collect()}
    assert all(out[i].n_links == 149 and out[i].class_id == 0 for i in range(150)) and out[150].n_links == 0


def test_join_documents_and_odd_rows(spark, docs, odd):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    check_join(ngram_join.join_documents(docs).collect(), [t for _, t in rows])
    out = ngram_join.join_documents(odd)
    assert out.count() == odd.count() and out.filter("doc_id = 6").first().class_id == 5
    assert ngram_join.join_documents(odd.limit(0)).count() == 0


def test_pruning_rule():
    assert ngram_join.least_matches(16) < ngram_join.least_matches(96) < 0.8 * 96
    from itertools import accumulate

    n, m = 96, ngram_join.least_matches(96)
    mass = list(accumulate(math.comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(n + 1)))
    assert mass[m] >= ngram_join.TOLERANCE > mass[m - 1]
