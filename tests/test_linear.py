"""Names, overlaps, fusing, dictionaries and restoring: the same as plain versions, and in time linear in text and maps."""

import random
import re
import time

import pytest

from veilframe.operators import names
from veilframe.operators.engine import JOINTS, Engine, Span
from veilframe.operators.intervals import Cover, Intervals
from veilframe.sources.rules import Rule, RuleSet, pack
from veilframe.streaming.rehydrate import Rehydrator

#: The same introductions as one pattern, whose time grows with the square of the text.
PLAIN_INTRO = re.compile(names.INTRO.pattern.replace(r"(?:email|send|forward)\s+(?:directly\s+)?to", r"(?:email|send|forward)\s+(?:the\s+[\w\s]+\s+)?(?:directly\s+)?to"))


def growth(make, run, sizes):
    """How many times longer run takes for each doubling, the best of three."""
    took = []
    for n in sizes:
        x = make(n)
        best = []
        for _ in range(3):
            began = time.perf_counter()
            run(x)
            best.append(time.perf_counter() - began)
        took.append(min(best))
    return [b / a for a, b in zip(took, took[1:])]


def test_introductions_are_those_of_one_pattern():
    rng = random.Random(1)
    words = "send email forward the to directly report x bob ann-lee o'neil 'kim' @ask . , ask my boss per tom a 1 _b the the to αβγ".split()
    found = 0
    for _ in range(8000):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", "-", "", ". "]) for _ in range(rng.randrange(1, 16)))
        want = [m.span(1) for m in PLAIN_INTRO.finditer(text)]
        assert list(names.introductions(text)) == want, text
        found += len(want)
    assert found > 3000


def test_overlaps_are_those_of_a_loop():
    rng = random.Random(2)
    for _ in range(300):
        index, plain = Intervals(), []
        for _ in range(60):
            a = rng.randrange(400)
            b = a + rng.choice([0, 1, 5, 63, 64, 65, 200])
            want = next((k for k, (x, y) in enumerate(plain) if a < y and b > x), None)
            assert index.first(a, b) == want
            if want is not None and rng.random() < 0.5:
                plain[want] = min(plain[want][0], a), max(plain[want][1], b)
                index.widen(want, a, b)
            else:
                plain.append((a, b))
                index.add(a, b)
        cover = Cover(plain)
        assert all(cover.holds(at) == any(x <= at < y for x, y in plain) for at in range(-1, 700))


def test_fusing_takes_the_first_listed_potential_that_follows():
    rng = random.Random(3)
    engine = Engine(RuleSet())
    for _ in range(400):
        text = "".join(rng.choice(["ab", "cd", " ", "  ", " van ", " de ", ","]) for _ in range(30))
        span = lambda name: Span(a := rng.randrange(len(text) - 3), a + rng.randrange(1, 4), name, "Redact", "Other")
        confirmed = sorted((span("c") for _ in range(4)), key=lambda s: (s.start, -s.end))
        potential = [span(f"p{k}") for k in range(8)]
        want, left = [], list(potential)
        for c in confirmed:
            end = c.end
            while (k := next((k for k, p in enumerate(left) if p.start >= end and (not (g := text[end : p.start]).strip() or g in JOINTS)), None)) is not None:
                end = left.pop(k).end
            want.append(end)
        copies = [Span(c.start, c.end, c.rule, c.action, c.category) for c in confirmed]
        engine.resolve(text, copies, potential)
        assert potential == left


def test_long_texts_take_proportional_time():
    name = lambda i: f"John Sm{'abcdefghij'[i % 10]}th{'klmnopqrst'[i // 10 % 10]}{'klmnopqrst'[i // 100 % 10]}{'abcdefghij'[i // 1000]}"
    engine = Engine(pack("base", native=True))
    assert max(growth(lambda n: " and ".join(map(name, range(n))), engine.report, (1000, 2000, 4000))) < 3
    assert max(growth(lambda n: "send the report " * n, lambda t: list(names.introductions(t)), (4000, 8000, 16000))) < 3


def test_time_does_not_depend_on_the_number_of_terms_or_placeholders():
    text = "see Term7 Ltd now " * 3000
    engines = {n: Engine(RuleSet([Rule(f"t{i}", "D", "Other", "Redact", f"Term{i} Ltd") for i in range(n)])) for n in (10, 20_000)}
    assert growth(engines.get, lambda e: e.report(text), (10, 20_000))[0] < 3
    chunks = ["hi [NAME_", "7] and [X"] * 1000
    streams = {n: Rehydrator({f"[NAME_{i}]": f"v{i}" for i in range(n)}) for n in (10, 20_000)}
    assert growth(streams.get, lambda r: [r.feed(c) for c in chunks], (10, 20_000))[0] < 3


def test_terms_are_those_of_a_loop():
    rng = random.Random(5)
    terms = ["ab", "ab ab", "b", "a-b", "abc", "b ab", "é", "ab", "-", "c a"]
    rules = [Rule(f"r{k}", "D", "Other", "Redact", t) for k, t in enumerate(terms)]
    engine = Engine(RuleSet(rules))
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", "c", "A", " ", "-", "é", "."]) for _ in range(rng.randrange(1, 25)))
        low = engine.prepared([text]).__next__()[0].ascii.lower()
        want = []
        for k, t in enumerate(terms):
            t = t.replace("é", "e")
            want += [(f"r{k}", i, i + len(t)) for i in range(len(low) - len(t) + 1) if low.startswith(t, i) and not (i and low[i - 1].isalnum()) and not low[i + len(t) : i + len(t) + 1].isalnum()]
        assert sorted((r.id, a, b) for r, a, b in engine.terms.found(low)) == sorted(want)


@pytest.mark.parametrize("seed", range(4))
def test_streams_restore_what_a_whole_text_restores(seed):
    rng = random.Random(seed)
    tokens = {"[A_1]": "x[A_2]", "[A_10]": "y", "[A_": "z", "<<k>>": "w", "k": "v", "[B": "[A_1]", "": "never"}
    pieces = [*tokens, "[A_1", "[", "]", "0]", "plain", "<", ">>"]
    longest = re.compile("|".join(re.escape(t) for t in sorted(filter(None, tokens), key=len, reverse=True)))
    for _ in range(300):
        text = "".join(rng.choice(pieces) for _ in range(8))
        want = longest.sub(lambda m: tokens[m[0]], text)
        for size in (1, 2, 3, 7, len(text) + 1):
            r = Rehydrator(tokens)
            assert "".join([*(r.feed(text[i : i + size]) for i in range(0, len(text), size)), r.close()]) == want
