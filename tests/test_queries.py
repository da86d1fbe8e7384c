import pytest
from same import of_frame, of_sql

from veilframe.plans import queries as q


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert of_frame(q.queries()[name](spark, sf_dir)) == of_sql(duck, q.oracle_sql()[name])


def test_queries_without_sql_against_the_engine(spark, sf_dir):
    """Each text's report, names and candidates, made one by one, are what the queries return."""
    from veilframe.operators.engine import Engine
    from veilframe.operators.names import find_candidates, find_names
    from veilframe.operators.normalize import normalize
    from veilframe.operators.sessions import SessionTokens
    from veilframe.sources.words import Words

    assert set(q.queries()) - set(q.oracle_sql()) == {"sanitize_base", "scrub_full", "name_spans", "name_candidates", "scrub_verdicts", "session_tokens"}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    run = lambda name: q.queries()[name](spark, sf_dir).collect()
    full = Engine(q.pack(native=True))
    want = {i: full.report(t) for i, t in docs.items() if t is not None}
    got = {r.doc_id: r for r in run("scrub_full")}
    assert set(got) == set(docs)
    for i, r in want.items():
        assert (got[i].sanitized_text, got[i].is_blocked, got[i].n_redactions, got[i].n_potential) == (r["sanitized_text"], r["is_blocked"], len(r["redactions"]), len(r["potential_misses"]))
    base = {r.doc_id: r for r in run("sanitize_base")}
    assert set(base) == set(docs) and sum(r.n_redactions or 0 for r in base.values()) > 5
    names, maybe, base_engine = [], [], Engine(q.pack("base", native=True))
    for i, t in docs.items():
        n = normalize(t or "")
        names += [(i, f.start, f.end, f.label) for f in find_names(n.unicode, n.ascii, [], Words())]
        maybe += [(i, a, b, kind) for a, b, kind, _ in find_candidates(n.unicode, [(s.start, s.end) for s in base_engine.detect(n)[0]], Words())]
    assert sorted((r.doc_id, r.start, r.end, r.label) for r in run("name_spans")) == sorted(names) != []
    assert sorted((r.doc_id, r.start, r.end, r.kind) for r in run("name_candidates")) == sorted(maybe) != []
    engine, tokens, of = Engine(q.pack("base", native=True)), None, object()
    turns = {(r.conv_id, r.turn): r.sanitized_text for r in run("session_tokens")}
    rows = sorted(((r.conv_id, r.turn, r.text or "") for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()))
    for conv, turn, text in rows:
        if conv != of:
            of, tokens = conv, SessionTokens()
        assert turns[conv, turn] == engine.report(text, tokens)["sanitized_text"]
    assert len(turns) == len(rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())


def test_planted_texts_hold_a_match_of_every_rule(spark, sf_dir):
    for name in q.PLANTED:
        got = {r.rule for r in q.queries()[f"rules_{name}"](spark, sf_dir).filter("doc_id = -1").collect()}
        assert got == {r.id for r in q.pack(name).of("R")}, name
