"""The kernel's quick ways find what the patterns find, and do not search each text for each pattern."""

import random

from veilframe.operators import names, prefilter
from veilframe.operators.engine import Engine
from veilframe.operators.names import GREEK_PAIR, PATRONYMIC, find_candidates, inflected_names
from veilframe.sources.rules import RuleSet

BITS = (
    "ann alex papadopoulos Γιώργος Παπαδόπουλος παπαδάκης ος ea foo Maria ou ſ K ı İ ΟΥ é 日本 idis akis ς Σ ό α η omou ana contact patient Patient who's friend send the to bob".split()
    + [" "] * 12 + ["  ", "\n", "-", ".", "_", "1", "·", "΋", "ͅ", "\ud83d", "@"]
)


def _texts(n: int) -> list[str]:
    rng = random.Random(11)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


def test_inflected_names_are_those_of_the_patterns():
    for t in [*_texts(5000), "", "a", "foo papadopoulos", "ανα καλη"]:
        assert inflected_names(t) == ([m.span() for m in GREEK_PAIR.finditer(t)], [m.span() for m in PATRONYMIC.finditer(t)]), t


def test_words_without_an_ending_are_not_searched(monkeypatch):
    class Fails:
        def finditer(self, *_):
            raise AssertionError("searched")

        fullmatch = finditer

    for name in ("GREEK_PAIR", "PATRONYMIC", "_SECOND_OF_PAIR"):
        monkeypatch.setattr(names, name, Fails())
    assert inflected_names("words that have nothing at the end " * 1000) == ([], [])


def test_candidates_are_the_same_where_patterns_are_known_to_be_absent():
    engine = Engine(RuleSet([]))
    texts = [t.replace("\ud83d", "") for t in _texts(3000)]  # columns hold no lone surrogates
    found = [(n, more) for n, _, _, more in engine.prepared(texts, True)]
    assert any(more for _, more in found)
    for n, more in found:
        assert find_candidates(n.unicode, [], engine.words, more) == find_candidates(n.unicode, [], engine.words)


def test_a_scan_looks_for_several_patterns(monkeypatch):
    import pyarrow.compute as pc

    pre = prefilter.Prefilter({str(k): rf"\bx{k}[a-z]+\b" for k in range(40)})
    scans, plain = [], pc.match_substring_regex
    monkeypatch.setattr(pc, "match_substring_regex", lambda column, pattern: scans.append(len(column)) or plain(column, pattern))
    assert pre.absent(["nothing"] * 50 + ["an x7a, x8b and x39c"]) == [{str(k) for k in range(40)}] * 50 + [{str(k) for k in range(40) if k not in (7, 8, 39)}]
    assert sum(n > 1 for n in scans) == 40 // prefilter.GROUP


def test_rules_are_looked_for_only_where_texts_hold_what_they_need():
    import re

    from veilframe.operators.spans import needs
    from veilframe.plans.queries import FREQUENT, _rule

    assert [needs(p) for p in (r"\d{3}", r"a|\d", r"(?:\d|1[2-3])+x", r"\d*", r"[0-9a]", "a@b1", r"(?:\d@)?", r"[^0-9]", r"(?=1)a")] == [{"digit"}, set(), {"digit"}, set(), set(), {"at", "digit"}, set(), set(), set()]
    rules = [_rule(*x) for x in FREQUENT]
    assert sum(bool(needs(r.pattern)) for r in rules) > len(rules) // 2
    rng = random.Random(3)
    for r in rules:
        for m in re.finditer(r.pattern, " ".join("".join(rng.choice("ab1239.@-AZ ") for _ in range(20)) for _ in range(500))):
            assert ("digit" not in needs(r.pattern) or re.search(r"\d", m[0])) and ("at" not in needs(r.pattern) or "@" in m[0])


def test_rule_names_are_those_of_rule_hits(spark):
    from veilframe.operators import spans
    from veilframe.plans.queries import FREQUENT, _rule
    from veilframe.sources.rules import pack

    rules = [_rule(*x) for x in FREQUENT] + pack("base").of("D")
    df = spark.createDataFrame([(1, "a@b.co 123-45-6789 Alice, Art. 9 and x@y.org 10.0.0.1"), (2, None), (3, ""), (4, "٣٤٥-٤٥-١٢٣٤ HMO ABCDEFGH")], "id long, text string")
    count = lambda rows: sorted(map(tuple, rows.groupBy("id", "rule").count().collect()))
    assert count(spans.rule_names(df, rules)) == count(spans.rule_hits(df, rules)) != []


def test_readings_by_replacing_are_those_of_each_character():
    from veilframe.operators import normalize

    bits = list("abc ü ß é ς Σ 日 한 か … ﬁ ª ½ \x00 \x7f \u200b \u00a0 \u2060 ſ İ Ж Щ ’ ．") + ["\n", "\t", "\U00010400", "\U0001d400"]
    rng, done = random.Random(7), 0
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 30)))
        quick, plain = normalize._few_special(text), normalize._each_special(text)
        done += quick is not None
        assert quick is None or (quick == plain and quick.stripped == plain.stripped), text
    assert done > 2000 and normalize._few_special("".join(map(chr, range(0x400, 0x440)))) is None


def test_terms_are_compared_with_whole_texts_only_where_these_are_short():
    from veilframe.operators.normalize import normalize
    from veilframe.sources.rules import Rule

    engine = Engine(RuleSet([Rule("T", "D", "Custom", "Redact", "secret")]))
    for text, found in (("s.e_c r-e t", True), ("!!s e c r e t!!", True), ("s e c r e t s", False), ("s e c r e", False), ("", False), ("-" * 5000, False)):
        n = normalize(text)
        assert bool(engine.terms.equal(n)) == found
    n = normalize("many words " * 1000)
    assert engine.terms.equal(n) == [] and "stripped" not in n.__dict__


def test_a_report_of_what_was_found_looks_for_nothing(monkeypatch):
    from veilframe.operators.engine import packed
    from veilframe.sources.rules import pack

    engine = Engine(pack("base", native=True))
    texts = [*_texts(300), "we saw Tamsin, Orlin and Vasko there, ask 123-45-6789 or ann@example.com"]
    said = [("window", 0, [(7, 13, "B-PER", 0.9)]), ("probe", 15, [(0, 4, "B-PER", 0.9)])]
    texts = [t.replace("\ud83d", "") for t in texts]
    want, found = [engine.report(t, None, None, said) for t in texts], []
    for n, absent, names, more in engine.prepared(texts, True):
        confirmed, potential = engine.detect(n, absent, names)
        found.append(packed(confirmed, potential, engine.candidates(n, confirmed, more)))
    monkeypatch.setattr(Engine, "detect", None)
    monkeypatch.setattr(Engine, "candidates", None)
    assert [engine.report(t, None, None, said, f) for t, f in zip(texts, found)] == want and len(want[-1]["redactions"]) > 2


def test_answers_are_read_field_by_field():
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    from veilframe.operators.engine import answers_of
    from veilframe.operators.verdicts import SAID

    rng = random.Random(5)
    entity = lambda: {"s": rng.randrange(9), "e": rng.randrange(9), "label": rng.choice(["B-PER", None]), "score": rng.choice([0.5, 1.0])}
    answer = lambda: {"kind": rng.choice(["window", "probe"]), "place": rng.randrange(99), "entities": [entity() for _ in range(rng.randrange(3))]}
    rows = [rng.choice([None, [answer() for _ in range(rng.randrange(4))]]) for _ in range(200)]
    column = pa.array(rows, to_arrow_type(_parse_datatype_string(SAID)))
    for a, n in ((0, 200), (37, 90), (199, 1), (50, 0)):
        want = [[(x["kind"], x["place"], [tuple(e.values()) for e in x["entities"]]) for x in row or ()] for row in rows[a : a + n]]
        assert answers_of(column.slice(a, n)) == want
    assert answers_of(pa.nulls(3, column.type)) == [[], [], []]
