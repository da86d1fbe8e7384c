"""Filter audit, toxicity and phrase collocations against plain versions."""

import collections
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from same import of_frame, of_sql

from veilframe.llm import collocations, filter_audit, toxic_crf

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- filter interaction audit


def audit_by_hand(rows, labels):
    """rows: (doc_id, text, lang); labels: doc_id -> (quality, toxic)."""
    docs = []
    for i, text, lang in rows:
        t = text or ""
        w = WORD.findall(t)
        first = min((j for j, u, _ in rows if (u or "") == t and j is not None), default=None)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and first is not None and i > first,
        }
        docs.append((lang or "", fails, *labels.get(i, (0, 0))))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                gone = lambda d: any(d[1][y] for y in order[: step - 1])  # noqa: E731, B023
                here = [d for d in mine if not gone(d) and d[1][x]]
                kept = sum(not gone(d) and not d[1][x] for d in mine)
                alone = sum(d[1][x] and sum(d[1].values()) == 1 for d in mine)
                total[x] += len(here)
                out[part, "".join(order), step] = [kept, len(here), sum(gone(d) and d[1][x] for d in mine), alone, sum(d[2] == 1 for d in here), sum(d[3] == 1 for d in here), x]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = total[v[-1]]
    return out


def test_audit_against_every_order_by_hand(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "d#", "eps", *(f"w{k}" for k in range(300))]
    texts = [" ".join(rng.choice(words[: rng.choice([5, 305])]) for _ in range(rng.choice([3, 150, 250, 400]))) for _ in range(40)]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(150)] + [(None, texts[0], "en"), (7, None, "en"), (9, "", "de"), (11, texts[1], "en"), (11, texts[1], "en")]
    labels = {i: (rng.choice([0, 1]), rng.choice([0, 1])) for i in range(0, 150, 2)}
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, bits int, part string").repartition(5)
    marks = spark.createDataFrame([(i, *v) for i, v in labels.items()] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    index = filter_audit.bitmap_index(filter_audit.facts(docs, marks), (*filter_audit.FILTERS, *filter_audit.LABELS))
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in filter_audit.audit(filter_audit.subset_counts(index)).collect()}
    assert got == audit_by_hand(rows, labels) and len(got) == 3 * 600


def test_audit_of_an_empty_table(spark):
    docs, marks = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    index = filter_audit.bitmap_index(filter_audit.facts(docs, marks), (*filter_audit.FILTERS, *filter_audit.LABELS))
    assert filter_audit.audit(filter_audit.subset_counts(index)).count() == 0


def test_audit_takes_odd_rows(spark, odd):
    marks = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    index = filter_audit.bitmap_index(filter_audit.facts(odd, marks), (*filter_audit.FILTERS, *filter_audit.LABELS))
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in filter_audit.audit(filter_audit.subset_counts(index)).collect()}
    assert got == audit_by_hand([(r.doc_id, r.text, r.lang) for r in odd.select("doc_id", "text", "lang").collect()], {3: (1, 0)})


# ---- toxicity


@pytest.mark.parametrize("n", [1, 2, 3, 7, 11])
def test_marginals_are_sums_over_all_tag_sequences(n):
    rng = np.random.default_rng(n)
    emit, begins, links = rng.normal(0, 2, n), rng.random(n) < 0.3, rng.normal(0, 1, 4)
    begins[0] = True
    total, toxic = 0.0, np.zeros(n)
    for tags in itertools.product((0, 1), repeat=n):
        s = sum(e * y for e, y in zip(emit, tags))
        s += sum(links[0] * y if b else {(0, 1): links[1], (1, 0): links[2], (1, 1): links[3]}.get((x, y), 0.0) for x, y, b in zip((0, *tags), tags, begins))
        total, toxic = total + np.exp(s), toxic + np.exp(s) * np.array(tags)
    assert np.allclose(toxic / total, toxic_crf.marginals(emit, begins, links))


def test_chains_of_a_long_text_do_not_depend_on_how_it_is_cut():
    rng = np.random.default_rng(1)
    emit, begins, links = rng.normal(0, 3, 5000), rng.random(5000) < 0.001, rng.normal(0, 1, 4)
    begins[[0, 2000]] = True
    whole = toxic_crf.marginals(emit, begins, links)
    parts = [toxic_crf.marginals(emit[a:b], begins[a:b], links) for a, b in ((0, 2000), (2000, 5000))]
    assert np.allclose(whole, np.concatenate(parts))


def insults(n, seed=4):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ta", "ne", "ri", "so", "mu") for b in ("lor", "ken", "vis", "dan", "pel", "gor", "tib")]
    bad = [f"zokk{b}" for b in ("lor", "ken", "vis", "dan", "pel", "gor")] + ["grumpf"]
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        w = [rng.choice(plain) + rng.choice([" ", " ", ". ", "\n"]) for _ in range(rng.randrange(20, 60))]
        for _ in range(rng.randrange(3, 6) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + " ")
        rows.append((i, "".join(w), int(toxic)))
    return rows


def test_held_out_toxic_texts_are_found_and_their_words_named(spark):
    rows = insults(600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 != 2 or y == 0], "doc_id long, toxic int")
    tagger = toxic_crf.train(docs, labels)
    got = {r.doc_id: r for r in toxic_crf.tag(docs, tagger).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 100 and all((got[i].score >= 0.3) == bool(y) for i, _, y in held)
    for i, text, y in held:
        named = " ".join(text[s.start : s.end] for s in got[i].spans).split()
        assert set(named) == {w for w in re.findall("[a-z]+", text) if w.startswith("zokk") or w == "grumpf"}


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    rows = insults(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    one = toxic_crf.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    two = toxic_crf.train(docs, spark.createDataFrame([(i, 1 - y if held(i) else y) for i, _, y in rows], "doc_id long, toxic int"))
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.calibration, two.calibration)


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    got = toxic_crf.tag(odd, toxic_crf.train(odd, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    none = toxic_crf.tag(odd, toxic_crf.train(odd.limit(0), labels.limit(0))).collect()
    assert len({r.score for r in none}) == 1
    assert toxic_crf.tag(odd.limit(0), toxic_crf.train(odd, labels)).count() == 0


# ---- phrase collocations


def collocations_by_hand(rows, least, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inner = collections.defaultdict(int)
    for (lang, *w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inner[lang, *w[i : i + k]] = max(inner[lang, *w[i : i + k]], a)
    out = collections.defaultdict(list)
    for (lang, *w), a in cand.items():
        if 100 * inner[lang, *w] >= 100 * a:
            continue
        s, k = min((1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w)))
        out[lang].append((-s, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]], n[lang]))
    return sorted((lang, r, x[2].decode(), -x[1], *x[3:], -x[0]) for lang, v in out.items() for r, x in enumerate(sorted(v)[:top], 1))


def phrase_rows(seed):
    rng = random.Random(seed)
    words = ["new", "York", "city", "of", "über", "los", "x", "Ä", "a-b", "rare"]
    make = lambda: "".join(rng.choice(words[: rng.choice([3, 6, 10])]) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ", "]) for _ in range(rng.randrange(0, 60)))
    rows = [(make(), rng.choice(["en", "en", "de", None])) for _ in range(120)]
    return rows + [("los los los los los los los", "en")] * 9 + [(None, "en"), ("", None), ("word", "xx"), (" . ,", "en")]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("known", [collocations.BROADCAST_WORDS, 0])
def test_phrases_by_hand(spark, seed, known):
    rows = phrase_rows(seed)
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "text string, lang string, n int, phrase string").repartition(4)
    got = collocations.collocations(docs, 6, 50, known).collect()
    assert sorted(tuple(r) for r in got) == collocations_by_hand(rows, 6, 50) != []


def test_runs_over_the_borders_of_ranges_are_summed(spark):
    rows = [("a b a b a b c", "en")] * 300 + [("a b", "en"), ("c c c", "en")] * 50
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    words, _, size = collocations.dictionary(docs.select("text", "lang"), 5)
    counts = [{bytes(r.phrase): r.f for r in collocations.phrase_counts(collocations.keys(docs, words, size), tasks, 5).collect()} for tasks in (1, 2, 9)]
    assert counts[0] == counts[1] == counts[2] and max(counts[0].values()) == 950


@pytest.mark.parametrize("known", [collocations.BROADCAST_WORDS, 0])
def test_keys_come_as_a_row_for_each_range_of_a_chunk(spark, known):
    """Not as a row for each key; ranges cut anywhere, inside the runs of a phrase too, give the same counts."""
    rng = random.Random(4)
    rows = [(" ".join(rng.choice("abcdefgh") for _ in range(200)), "en") for _ in range(60)] + [("a b a b a b c", "en")] * 300
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    words, _, size = collocations.dictionary(docs, 5)
    whole = collocations.keys(docs, words, size, known)
    want = {bytes(r.phrase): r.f for r in collocations.phrase_counts(whole, 1, 20).collect()}
    some = collocations.keys(docs, words, size, known, every=3)
    for tasks in (2, 9, 40):
        borders = collocations.range_borders(some, tasks)
        cut = collocations.keys(docs, words, size, known, borders)
        assert 0 < len(borders) < tasks and cut.select("part").distinct().count() == len(borders) + 1
        assert cut.count() <= whole.count() * (len(borders) + 1) < len(want) * 100
        assert {bytes(r.phrase): r.f for r in collocations.phrase_counts(cut, tasks, 20).collect()} == want
    assert {bytes(r.phrase): r.f for r in collocations.phrase_counts(cut, 2, 20).collect()} == want


def test_ranges_are_cut_by_a_few_texts(spark, monkeypatch):
    rows = phrase_rows(5)
    docs = spark.createDataFrame(rows * 3, "text string, lang string").repartition(4)
    for name, value in (("TASK_KEYS", 500), ("BORDER_KEYS", 20), ("BORDER_TEXTS", 4)):
        monkeypatch.setattr(collocations, name, value)
    got = collocations.collocations(docs, 6, 50).collect()
    assert sorted(tuple(r) for r in got) == collocations_by_hand(rows * 3, 6, 50) != []


def test_scores_are_exact_beyond_64_bits(spark):
    a, n, l, r = 9_007_199_254_740_993, 90_071_992_547_409_931, 9_007_199_254_740_997, 9_007_199_254_741_001
    got = spark.sql(f"SELECT {collocations._SCORE} AS s FROM (SELECT {a}L AS a, {n}L AS n, named_struct('l', {l}L, 'r', {r}L) AS c)").first().s
    assert got == 1000 * a * n // (l * r)


def test_radix_order():
    ids = np.random.default_rng(2).integers(0, 1 << 32, (500, 5), dtype=np.uint64).astype(np.uint32)
    ids[::3] = ids[0]
    ids[::5, :3] = 7
    assert (ids[collocations.radix_order(ids)] == np.array(sorted(ids.tolist()), np.uint32)).all()


def test_phrases_of_odd_rows_and_of_an_empty_table(spark, odd):
    got = collocations.collocations(odd, 20).collect()
    rows = [(r.text, r.lang) for r in odd.select("text", "lang").collect()]
    assert sorted(tuple(r) for r in got) == collocations_by_hand(rows, 20, 2000)
    assert collocations.collocations(odd.limit(0)).count() == 0


def test_phrase_sql_with_a_lower_limit(spark, sf_dir):
    """The tables of sf0.001 have few phrases that are seen a hundred times; with ten there are some."""
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = of_frame(collocations.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"), 10))
    assert got == of_sql(duck, collocations.SQL.replace(">= 100)", ">= 10)")) and len(got[1]) > 50
