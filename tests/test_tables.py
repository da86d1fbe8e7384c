import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veilframe.functions import text as T
from veilframe.operators import audit, evaluate, retrieval
from veilframe.sources.docx import read_docx
from veilframe.streaming.rehydrate import DONE, Rehydrator, delta, rehydrate_stream

KEY, PEPPER = b"k" * 40, b"pepper"


@pytest.fixture(scope="module")
def ledger(spark):
    rows = [(c, i, f"2024-01-01 00:00:{i:02d}", f"u{i % 2}", i == 3, "[]", f"text {i}") for c in (1, 2) for i in range(1, 8)]
    ev = spark.createDataFrame(rows, "c long, i long, ts string, username string, is_blocked boolean, redactions_json string, raw string")
    out = audit.append(ev, "c", "i", KEY, PEPPER, segment=3).cache()  # nonces are random: one writing only
    out.count()
    return out


def verdicts(df, **kw):
    return {(r.chain, r.seq): r.verdict for r in audit.verify(df, KEY, segment=3, **kw).collect()}


def test_ledger_intact_and_opens(ledger):
    assert set(verdicts(ledger).values()) == {"intact"}
    first = ledger.filter("seq = 1").select(audit.open_payload(audit.genesis(F.col("chain"), F.col("segment")), F.col("username"), F.col("encrypted_data"), PEPPER).alias("raw"))
    assert {r.raw for r in first.collect()} == {"text 1"}


@pytest.mark.parametrize("column,value", [("username", "x"), ("is_blocked", True), ("redactions_json", "[1]"), ("ts", "t"), ("payload_hash", "00" * 32), ("encrypted_data", b"xx"), ("integrity_hash", "00" * 32)])
def test_any_altered_column_is_found(ledger, column, value):
    bad = ledger.withColumn(column, F.when((F.col("seq") == 2) & (F.col("chain") == 1), F.lit(value)).otherwise(F.col(column)))
    v = verdicts(bad)
    assert v[1, 2] == "tampered" and v[2, 2] == "intact" and v[1, 1] == "intact"


def test_gap_purge_and_anchor(ledger):
    assert verdicts(ledger.filter("NOT (seq = 5 AND chain = 1)"))[1, 6] == "gap"
    purged = audit.purge(ledger, "u1")
    assert verdicts(purged)[1, 1] == "purged" and verdicts(purged, skip_purged=False)[1, 1] == "tampered"
    archived = ledger.withColumn("encrypted_data", F.lit(None).cast("binary"))
    assert set(verdicts(archived).values()) == {"archived"}
    anchors = audit.anchor(ledger)
    check = lambda df: {r.chain: r.verdict for r in audit.anchor_check(df, anchors).collect()}
    assert check(ledger) == {1: "ok", 2: "ok"}
    assert check(ledger.filter("NOT (chain = 1 AND seq > 5)"))[1] == "shrunk"
    assert check(ledger.withColumn("integrity_hash", F.when((F.col("chain") == 2) & (F.col("seq") == 7), "x").otherwise(F.col("integrity_hash"))))[2] == "changed"
    with pytest.raises(RuntimeError):
        audit.under_pressure(ledger, F.lit(1), F.lit(True), F.lit(1), 0.5, 10)


@pytest.mark.parametrize("column", ["ts", "username", "is_blocked", "redactions_json", "raw"])
def test_a_null_field_leaves_the_chain_whole(spark, column):
    rows = [(1, i, "t", "u", False, "[]", "x") for i in range(1, 6)]
    ev = spark.createDataFrame(rows, "c long, i long, ts string, username string, is_blocked boolean, redactions_json string, raw string")
    out = audit.append(ev.withColumn(column, F.when(F.col("i") != 2, F.col(column))), "c", "i", KEY, PEPPER, segment=10).cache()
    assert out.filter("integrity_hash IS NULL").count() == 0
    assert verdicts(out) == {(1, i): "archived" if column == "raw" and i == 2 else "intact" for i in range(1, 6)}
    put = {"is_blocked": False, "raw": None}.get(column, "")
    if column != "raw":
        assert verdicts(out.withColumn(column, F.coalesce(F.col(column), F.lit(put))))[1, 2] == "tampered"


def test_a_ledger_needs_chains(spark):
    ev = spark.createDataFrame([(None, 1, "t", "u", False, "[]", "x")], "c long, i long, ts string, username string, is_blocked boolean, redactions_json string, raw string")
    with pytest.raises(Exception, match="needs a chain"):
        audit.append(ev, "c", "i", KEY, PEPPER).collect()


URLS = {
    "http://instance-data/": "metadata", "http://a.metadata.google.internal/": "metadata", "http://x.instance-data:80/": "metadata", "http://[fe80::1]/": "metadata", "http://[::ffff:169.254.169.254]/": "metadata",
    "http://2852039166/": "metadata", "http://0xA9FEA9FE/": "metadata", "http://0251.0376.0251.0376/": "metadata", "http://169.254.43518": "metadata", "http://[::]/": "private", "http://0.1.2.3/": "private",
    "http://2130706433/": "private", "http://127.1/": "private", "http://[::1]:8080/": "private", "http://[fd12:3456::1]/": "private", "http://[::ffff:10.0.0.1]/": "private", "http://[::ffff:a00:1]/": "private",
    "http://172.31.255.255/": "private", "http://172.32.0.1/": "ok", "http://u:p@10.0.0.1/": "private", "http://%31%30.0.0.1/": "private", "http:\\\\localhost\\x": "private", " http://a.localhost ": "private",
    "http://8.8.8.8/": "ok", "http://[2001:db8::1]/": "ok", "http://256.1.1.1/": "scheme", "http://1.2.3.4.5/": "scheme", "http://[1::2::3]/": "scheme", "http://[1:2]/": "scheme", "http:///": "scheme", "file:///etc": "scheme",
    "": "scheme", "http://99999999999999999999/": "scheme", "http://a.example/?u=http://10.0.0.1/": "ok", "http://metadata.example/": "ok",
}


def test_url_guard(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string")
    look = lambda **kw: {r.u: r.v for r in df.select("u", T.url_verdict(F.col("u"), **kw).alias("v")).collect()}
    assert look() == URLS
    assert look(production=False) == {u: "ok" if v == "private" else v for u, v in URLS.items()}
    listed = look(allowed_hosts=("127.0.0.1", "::1", "[fe80::1]"))
    assert listed["http://127.1/"] == "ok" and listed["http://[::1]:8080/"] == "ok" and listed["http://8.8.8.8/"] == "not allowed" and listed["http://[fe80::1]/"] == "metadata"
    assert spark.createDataFrame([(None,)], "u string").select(T.url_verdict(F.col("u")).alias("v")).first().v in (None, "scheme")


def test_restore_takes_any_key(spark):
    rows = [("[token-1] a[b+]c \\\\E x", {"[token-1]": "T", "a[b": "1", "a[b+]c": "2", "\\\\E": "$1"}), ("aab", {"a": "1", "aa": "2", "": "9"}), ("x", {}), ("x", None), (None, {"a": "b"})]
    df = spark.createDataFrame(rows, "t string, m map<string,string>")
    assert [r.x for r in df.select(T.restore(F.col("t"), F.col("m")).alias("x")).collect()] == ["T 2 $1 x", "2b", "x", "x", None]


def test_jobs(spark):
    docs = spark.createDataFrame([(1, "ann", "red apple pie"), (2, "ann", "apple"), (3, "bob", "red apple")], "doc_id long, owner string, text string")
    asked = spark.createDataFrame([("ann", "t", "the RED apple", "1"), ("cat", "t", "apple", "2")], "username string, thread_id string, query string, created_at string")
    jobs = retrieval.complete(retrieval.enqueue(asked, PEPPER), docs, "owner", PEPPER).cache()
    ids = {r.username: r.id for r in jobs.collect()}
    assert retrieval.result_of(jobs, ids["ann"], "ann", PEPPER).first().result == "red apple pie"
    assert retrieval.result_of(jobs, ids["ann"], "bob", PEPPER).isEmpty() and not retrieval.result_of(jobs, ids["ann"], "bob", PEPPER, admin=True).isEmpty()
    assert retrieval.result_of(jobs, ids["cat"], "cat", PEPPER).first().result == retrieval.NOTHING
    assert retrieval.terms("the of") == ["the", "of"] and retrieval.terms("Who is A-b?") == ["b"]
    assert retrieval.delete_documents(docs, "owner", "ann").count() == 1 and retrieval.retrieve(docs, "!!", "owner").isEmpty()


def test_jobs_by_index_are_jobs(spark):
    """Posting lists give the answers that all documents of an owner give: short and missing terms, repeated, null and empty rows."""
    docs = spark.createDataFrame([(1, "ann", "Red apple pie"), (2, "ann", "apple"), (2, "ann", "apple red"), (3, "bob", "red apple"), (4, "ann", ""), (5, "ann", None), (None, "ann", "\U0001f600\U0001f600x red apples"), (6, None, "red")], "doc_id long, owner string, text string")
    queries = ["red apple", "RED", "ap", "pie ap", "zebra", "red zebra", "the", "", "!!", "\u00e9t\u00e9", None, "apples red"]
    asked = spark.createDataFrame([(u, str(i), q, "1") for i, q in enumerate(queries) for u in ("ann", "bob", "cat")], "username string, thread_id string, query string, created_at string")
    jobs = retrieval.enqueue(asked, PEPPER).withColumn("id", F.concat_ws("/", "username", "thread_id"))
    opened = lambda **kw: {r.id: r.x for r in retrieval.complete(jobs, docs, "owner", PEPPER, **kw).select("id", retrieval.unseal(F.col("result"), F.col("username"), PEPPER, retrieval.JOB_INFO).cast("string").alias("x")).collect()}
    plain = opened()
    assert opened(postings=retrieval.index(docs, "owner")) == plain and len(plain) == 36
    assert plain["ann/0"].startswith("\U0001f600\U0001f600x red apples\n---\nRed apple pie") and plain["cat/0"] == retrieval.NOTHING
    assert retrieval.index(docs.limit(0), "owner").isEmpty()


def test_frequent_terms_meet_few_documents(spark, monkeypatch):
    """Jobs grow with the documents, and all ask for words that every document holds: what they meet is no square of them."""
    monkeypatch.setattr(retrieval, "FIRST_DOCS", 8)
    met = {}
    for n in (200, 800):
        docs = spark.range(n).selectExpr("id AS doc_id", "'ann' AS owner", "concat('common words in number', id % 50, ' ', id) AS text")
        asked = docs.selectExpr("owner AS username", "cast(doc_id AS string) AS thread_id", "concat('common words number', doc_id % 50) AS query", "'1' AS created_at")
        jobs = retrieval.enqueue(asked, PEPPER).withColumn("id", F.col("thread_id"))
        questions = docs.selectExpr("owner AS username", "concat('common number', doc_id % 50, ' words') AS _q", "array('common', concat('number', doc_id % 50), 'words') AS _terms").distinct()
        near, met[n] = retrieval.candidates(questions, retrieval.index(docs, "owner"), 3)
        assert near.count() == met[n] and near.groupBy("_q").count().filter("count >= 3").count() == 50
        done = retrieval.complete(jobs, docs, "owner", PEPPER, postings=retrieval.index(docs, "owner"))
        got = {r.id: r.x for r in done.select("id", retrieval.unseal(F.col("result"), F.col("username"), PEPPER, retrieval.JOB_INFO).cast("string").alias("x")).collect()}
        plain = {r.doc_id: r.text for r in docs.collect()}
        assert len(got) == n
        for i, x in got.items():
            assert x.split("\n---\n") == [t for t in plain.values() if all(w in t for w in ("common", "words", f"number{int(i) % 50}"))][:3]
    assert met[800] <= 1.5 * met[200]


def test_restore_is_not_recursive(spark):
    df = spark.createDataFrame([("Hello [TOKEN_1]", {"[TOKEN_1]": "Alice [TOKEN_2]", "[TOKEN_2]": "Bob"})], "t string, m map<string,string>")
    assert df.select(T.restore(F.col("t"), F.col("m")).alias("x")).first().x == "Hello Alice [TOKEN_2]"


def test_every_chunking_restores_the_same():
    tokens = {"[NAME_1]": "Ann", "[NAME_10]": "Bob [NAME_1]", "[X_2]": "y"}
    text, want = "a [NAME_1] b [NAME_10] [X_2][ [NAME", "a Ann b Bob [NAME_1] y[ [NAME"
    for size in range(1, len(text) + 1):
        r = Rehydrator(tokens)
        assert "".join(r.feed(text[i : i + size]) for i in range(0, len(text), size)) + r.close() == want


def test_delta(spark):
    lines = ['data: {"choices":[{"delta":{"content":"a"}}]}', 'data: {"delta":{"text":"b"}}', "data: [DONE]", ": ping"]
    got = [r.d for r in spark.createDataFrame([(x,) for x in lines], "l string").select(delta(F.col("l")).alias("d")).collect()]
    assert got == ["a", "b", DONE, None]


def test_stream(spark, tmp_path):
    import json

    tokens = json.dumps({"[NAME_1]": "Ann"})
    rows = [("s", i, c, tokens) for i, c in enumerate(["hi [NA", "ME_1] and [N", DONE])] + [("t", 0, "[NAME_1]", tokens)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "stream_id string, seq long, chunk string, tokens string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("stream_id string, seq long, chunk string, tokens string").parquet(src)
    q = rehydrate_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got: dict = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r.seq):
        got[r.stream_id] = got.get(r.stream_id, "") + r.text
    assert got == {"s": "hi Ann and [N", "t": "Ann"}


def test_docx(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>Hello</w:t></w:r><w:r><w:t>you</w:t></w:r></w:p></w:document>')
    (tmp_path / "a.docx").write_bytes(buf.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no zip")
    assert {r.path[-6:]: r.text for r in read_docx(spark, str(tmp_path)).collect()} == {"a.docx": "Hello you ", "b.docx": None}


def test_eval_file(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"text": "I am Ann", "entities": [{"token": "Ann", "start": 5, "end": 8, "label": "P"}]}\nbroken\n')
    df = evaluate.read_eval(spark, str(tmp_path / "e.jsonl")).withColumn("out", F.lit("I am [NAME_1]"))
    row = evaluate.entity_recall(df, "out").first()
    assert (row.tp, row.fn, row.recall, row.precision) == (1, 0, 1.0, 1.0)


def test_session_stream(spark, tmp_path):
    from veilframe.operators.sessions import session_stream
    from veilframe.sources.rules import Rule, RuleSet

    rules = RuleSet([Rule("name", "R", "IndividualName", "Redact", "Anna Lee|Anna|Bob")])
    schema = "username string, seq long, text string"
    for k, rows in enumerate([[("u", 1, "Anna Lee"), ("v", 1, "Bob")], [("u", 2, "Bob and Anna")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = session_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), rules, idle=None).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.username, r.seq): r.sanitized_text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("u", 1): "[NAME_1]", ("v", 1): "[NAME_1]", ("u", 2): "[NAME_2] and [NAME_1]"}


def test_legacy_shield(spark):
    from veilframe.operators.legacy import shield

    df = spark.createDataFrame([(1, "Foo 123-45-6789 foo 123-45-6789 bar"), (2, None)], "id int, text string")
    got = {r.id: (r.sanitized_text, r.token_map) for r in shield(df, ["foo", "b.r"]).collect()}
    assert got[1] == ("[TERM_1] [SSN_1] [TERM_2] [SSN_2] bar", {"[SSN_1]": "123-45-6789", "[SSN_2]": "123-45-6789", "[TERM_1]": "Foo", "[TERM_2]": "foo"}) and got[2] == (None, None)


def test_legacy_shield_finds_distinct_matches_once(spark):
    import time

    from veilframe.operators.legacy import shield

    n = 40_000
    df = spark.createDataFrame([(1, "the und 123-45-6789 " * n)], "id int, text string")
    began = time.time()
    row = shield(df, ["the", "und"]).select(F.length("sanitized_text").alias("n"), F.size("token_map").alias("k")).first()
    assert (row.n, row.k) == (sum(len(f"[TERM_1] [TERM_2] [SSN_{i}] ") for i in range(1, n + 1)), n + 2)
    assert time.time() - began < 20  # 80,000 matches of two terms


def test_guard_hook(spark):
    df = spark.createDataFrame([("x", True), ("y", False), ("z", None)], "text string, bad boolean")
    assert [r.s for r in df.select(T.guard_status(F.col("text"), classifier=F.col("bad")).alias("s")).collect()] == ["classifier", "ok", "classifier"]


def test_tables(spark, tmp_path):
    from veilframe.sources.tables import SCHEMAS, Conflict, Tables

    t = Tables(spark, str(tmp_path / "store"))
    assert all(t.read(name).isEmpty() and t.read(name).columns == [c.split()[0] for c in s.split(", ")] for name, s in SCHEMAS.items())
    docs = spark.createDataFrame([("1", "a", "ann"), ("2", "b", "bob"), ("3", None, None), ("4", "d", "")], "id string, text string, username string")
    t.append(docs, "documents")
    t.append(docs.limit(1), "documents")
    assert sorted(r.id for r in t.read("documents").collect()) == ["1", "1", "2", "3", "4"]
    old = t.read("documents")
    t.replace(audit.purge_everywhere("ann", documents=t.read("documents"))["documents"], "documents")
    assert sorted((r.id, r.text, r.username) for r in t.read("documents").collect()) == [("2", "b", "bob"), ("3", None, None), ("4", "d", "")]
    assert old.count() == 5 and t.read("documents", version=2).count() == 5  # readers keep what they began with
    t.replace(audit.purge_everywhere("", documents=t.read("documents"))["documents"], "documents")
    assert sorted(r.id for r in t.read("documents").collect()) == ["2", "3"]
    with pytest.raises(KeyError):
        t.read("none")
    with pytest.raises(KeyError):
        t.append(docs, "none")
    late, soon = t.begin(), t.begin()
    soon.append(docs, "documents")
    soon.commit()
    late.append(docs, "documents")
    with pytest.raises(Conflict):
        late.commit()
    assert t.read("documents").count() == 6
    assert t.clean(keep=1, older=3600) == 0 and t.clean(keep=1, older=0) == 4 and t.versions() == [5] and t.read("documents").count() == 6


def test_a_transaction_is_seen_whole_or_not_at_all(spark, tmp_path):
    from veilframe.sources.tables import Tables

    t = Tables(spark, str(tmp_path / "store"))
    threads = spark.createDataFrame([("1", "ann")], "id string, username string")
    heads = spark.createDataFrame([("c", 1, "h")], "chain string, last_seq long, last_hash string")
    for steps in range(3):  # stopped before the commit, after each of its steps
        change = t.begin("w", 0)
        if steps > 0:
            assert change.append(threads, "threads").count() == 1
        if steps > 1:
            change.replace(heads, "anchors")
            (tmp_path / "store" / "_log").mkdir(exist_ok=True)
            (tmp_path / "store" / "_log" / ".draft").write_text('{"tab')
        assert t.read("threads").isEmpty() and t.read("anchors").isEmpty() and t.versions() == []
    change = t.begin("w", 0)
    change.append(threads, "threads")
    change.replace(heads, "anchors")
    assert change.commit() == 1 and t.begin("w", 0) is None and t.begin("w", 1) is not None and t.begin("v", 0) is not None
    assert t.read("threads").count() == 1 and t.read("anchors").count() == 1 and not t.append(threads, "threads", "w", 0)


def events(spark, rows):
    made = [(c, i, f"2024-01-01 00:00:{i % 60:02d}", f"u{i % 2}", i == 3, "[]", f"text {i}") for c, i in rows]
    return spark.createDataFrame(made, "c string, i long, ts string, username string, is_blocked boolean, redactions_json string, raw string")


def test_a_ledger_goes_on(spark, tmp_path):
    """However a ledger is cut into batches, its unsealed rows are those of one writing; a batch that comes again changes nothing."""
    from veilframe.sources.tables import Tables

    rows = [("a", i) for i in range(1, 12)] + [("b", i) for i in range(1, 4)] + [("a", 3_000_000), ("c", 1)]
    whole = {tuple(r) for r in audit.append(events(spark, rows), "c", "i", KEY, PEPPER, segment=4, sealed=False).drop("encrypted_data").collect()}
    for k, cuts in enumerate([(1, 16), (5, 16), (4, 8, 9, 16)]):
        t, before = Tables(spark, str(tmp_path / f"l{k}")), 0
        for n, cut in enumerate(cuts):
            part = events(spark, rows[before:cut])
            assert audit.extend(t, part, "c", "i", KEY, PEPPER, "w", n, segment=4, sealed=False)
            assert not audit.extend(t, part, "c", "i", KEY, PEPPER, "w", n, segment=4, sealed=False)
            before = cut
        assert {tuple(r) for r in t.read("audit_reports").drop("encrypted_data").collect()} == whole
        assert {tuple(r) for r in audit.newest_heads(t.read("anchors")).collect()} == {tuple(r) for r in audit.anchor(t.read("audit_reports")).collect()}


def test_a_sealed_ledger_goes_on_and_folds_its_heads(spark, tmp_path, monkeypatch):
    from veilframe.sources import tables

    monkeypatch.setattr(tables, "FOLD", 2)
    t = tables.Tables(spark, str(tmp_path / "store"))
    for n in range(4):
        assert audit.extend(t, events(spark, [("a", 2 * n), ("a", 2 * n + 1), (f"only {n}", 1)]), "c", "i", KEY, PEPPER, "w", n, segment=3)
    got = audit.verify(t.read("audit_reports"), KEY, segment=3)
    assert {r.verdict for r in got.collect()} == {"intact"} and sorted(r.seq for r in got.filter("chain = 'a'").collect()) == list(range(1, 9))
    assert len(t.state()[1]["tables"]["anchors"]) == 2 and audit.newest_heads(t.read("anchors")).count() == 5


def test_equal_and_missing_orders_are_numbered_alike(spark):
    rows = [("a", None, "t", u, False, "[]", "x") for u in "cab"] + [("a", 5, "t", u, False, "[]", "x") for u in "ba"] + [("a", 2_000_001, "t", "z", False, "[]", "x")]
    schema = "c string, i long, ts string, username string, is_blocked boolean, redactions_json string, raw string"
    for shuffled in (rows, rows[::-1]):
        out = audit.append(spark.createDataFrame(shuffled, schema).repartition(3), "c", "i", KEY, PEPPER)
        assert [r.username for r in out.orderBy("seq").collect()] == list("abcabz")
    times = spark.createDataFrame([("a", f"2024-01-01 0{h}:00:00", "u") for h in (3, 1, 2)], "c string, at string, raw string").select("c", F.col("at").cast("timestamp").alias("i"), F.col("at").alias("ts"), F.lit("u").alias("username"), F.lit(False).alias("is_blocked"), F.lit("[]").alias("redactions_json"), "raw")
    assert [r.ts[12] for r in audit.append(times, "c", "i", KEY, PEPPER).orderBy("seq").collect()] == ["1", "2", "3"]


def test_sessions_go_on(spark, tmp_path):
    """Two batches are one: people, numbers and other tokens; only changed states are written; idle sessions begin anew."""
    from veilframe.operators import sessions
    from veilframe.sources.rules import Rule, RuleSet
    from veilframe.sources.tables import Tables

    rules = RuleSet([Rule("name", "R", "IndividualName", "Redact", "Anna Lee|Anna|Bob"), Rule("email", "R", "Other", "Redact", r"\w+@x\.org")])
    turns = [("u", 1, "Anna Lee wrote a@x.org"), ("v", 1, "Bob"), (None, 1, "Bob"), ("u", 2, "b@x.org and Anna"), ("w", 1, ""), ("u", 3, "A@x.org wrote Bob"), ("v", 2, "nobody"), ("v", 3, None)]
    frame = lambda rows: spark.createDataFrame(rows, "who string, n long, text string")
    want = {(r.who, r.n): r.sanitized_text for r in sessions.scrub_sessions(frame(turns), "who", "n", rules).collect()}
    assert want["u", 2] == "[EMAIL_3] and [NAME_1]"
    for cut in (3, 4, 6):
        t = Tables(spark, str(tmp_path / f"s{cut}"))
        run = lambda rows, n, now, idle=3600: sessions.resume(t, frame(rows), "who", "n", rules, PEPPER, "w", n, now, idle=idle)  # noqa: E731, B023
        assert run(turns[:cut], 0, "2024-01-01 00:00:00") and run(turns[cut:], 1, "2024-01-01 00:10:00") and not run(turns[cut:], 1, "2024-01-01 00:10:00")
        assert {(r.username, r.seq): r.sanitized_text for r in sessions.turns_of(t).collect()} == want
        assert t.read("sessions").filter("username = 'v'").count() == 1
    assert run([("u", 4, "Bob")], 2, "2024-01-01 05:00:00") and run([("v", 4, "Anna met Bob")], 3, "2024-01-01 05:00:00", None)
    got = {(r.username, r.seq): r.sanitized_text for r in sessions.turns_of(t).collect()}
    assert got["u", 4] == "[NAME_1]" and got["v", 4] == "[NAME_2] met [NAME_1]"
    change = t.begin()
    change.replace(t.read("sessions").withColumn("session_data", F.lit(b"broken")), "sessions")
    change.commit()
    with pytest.raises(Exception, match="cannot be opened"):
        run([("v", 5, "Bob")], 4, "2024-01-01 05:00:01")


def test_acknowledged_rows_and_purged_users(spark, ledger):
    acked = audit.acknowledge(audit.acknowledge(ledger, spark.createDataFrame([(1, 2), (1, 2)], "chain long, seq long")), spark.createDataFrame([(2, 3)], "chain long, seq long"))
    assert {(r.chain, r.seq) for r in acked.filter("siem_acked").collect()} == {(1, 2), (2, 3)} and acked.count() == ledger.count()
    out = audit.purge_everywhere("u1", ledger=ledger, sessions=spark.createDataFrame([("u1",), ("u2",), (None,)], "username string"))
    assert {r.username for r in out["sessions"].collect()} == {"u2", None} and out["ledger"].filter("username = 'u1'").isEmpty()


def test_rate_limit(spark, tmp_path):
    from veilframe.streaming.intake import limit, limit_stream, write_batches

    rows = [("a", f"{i:03}", i * 0.01) for i in range(60)] + [("b", "000", 5.0), ("c", "000", None)]
    df = spark.createDataFrame(rows, "username string, id string, at double")
    got = {(r.username, r.id): r.allowed for r in limit(df, rate=10, burst=20).collect()}
    assert sum(v for (u, _), v in got.items() if u == "a") == 25 and got["b", "000"] and not got["c", "000"] and all(got["a", f"{i:03}"] for i in range(22))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 10, 20)
    write_batches(stream, str(tmp_path / "out"), str(tmp_path / "ck"), None).awaitTermination()
    assert {(r.username, r.id): r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {k: v for k, v in got.items() if k[0] != "c"}


def test_jobs_never_show_what_could_not_be_scrubbed(spark):
    docs = spark.createDataFrame([(1, "ann", "red apple", "r"), (2, "ann", "apple", None)], "doc_id long, owner string, text string, safe string")
    asked = spark.createDataFrame([("ann", "t", "apple", "1")], "username string, thread_id string, query string, created_at string")
    jobs = retrieval.complete(retrieval.enqueue(asked, PEPPER), docs, "owner", PEPPER, scrubbed=F.col("safe")).cache()
    assert retrieval.result_of(jobs, jobs.first().id, "ann", PEPPER).first().result == "r\n---\n[REDACTION_FAILURE]"


def test_latencies(spark):
    import random

    rng = random.Random(3)
    for values in ([5.0], [1.0, 2.0], [rng.random() * 10 ** rng.randrange(6) for _ in range(999)], [7.0] * 50 + [1.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        s, n = sorted(values), len(values)
        row = evaluate.latencies(df, "v").first()
        assert (row.min, row.median, row.p95, row.p99, row.max) == (s[0], s[n // 2], s[min(n - 1, int(n * 0.95))], s[min(n - 1, int(n * 0.99))], s[-1])
    assert evaluate.latencies(df.limit(0), "v").first().median is None


def test_quantiles_of_any_doubles(spark):
    import random
    import struct

    inf, nan = float("inf"), float("nan")
    rng = random.Random(5)
    bits = [x for x in (struct.unpack(">d", struct.pack(">Q", rng.getrandbits(64)))[0] for _ in range(500)) if x == x]
    shares = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
    for values in ([1, 2, 3, inf], [1, 2, 3, nan], [0.0, 5e-324], [-0.0, 0.0, -5e-324], [-inf, inf], [nan], bits, [-1.5, -1.25, 2.0] * 9):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
        s = sorted(v for v in values if v == v)
        assert evaluate.quantiles(df, "v", shares) == [s[min(len(s) - 1, int(len(s) * p))] if s else None for p in shares]
        row = evaluate.latencies(df, "v").first()
        assert (row.min, row.max) == ((s[0], s[-1]) if s else (None, None))


def test_gaps_of_one_chain(spark):
    ids = spark.createDataFrame([(i,) for i in (1, 2, 5, 999_999, 1_000_000, 1_000_002, 3_500_000)], "id long")
    assert sorted(tuple(r) for r in audit.gaps(ids, "id").collect()) == [(2, 5), (5, 999_999), (1_000_000, 1_000_002), (1_000_002, 3_500_000)]


def test_bodies(spark):
    from veilframe.operators.content import scrub_bodies, texts_of, walk
    from veilframe.sources.rules import Rule, RuleSet

    deep = "x"
    for _ in range(100_000):
        deep = [{"text": deep}]
    assert texts_of({"messages": [{"content": deep}]}) == ["x"]
    given = {"text": ["a", {"content": "b", "other": "c"}], "id": "d"}
    assert walk(given, str.upper) == {"text": ["A", {"content": "B", "other": "c"}], "id": "d"} and given["text"][0] == "a"
    rows = spark.createDataFrame([(1, '{"prompt":"Anna and Bob"}', 5), (2, "no json", 6), (3, "[1]", 7), (4, None, 8)], "id int, body string, texts2 int")
    got = {r.id: r for r in scrub_bodies(rows, RuleSet([Rule("name", "R", "IndividualName", "Redact", "Anna|Bob")])).collect()}
    assert got[1].clean == '{"prompt":"[NAME_1] and [NAME_2]"}' and got[1].token_map == {"[NAME_1]": "Anna", "[NAME_2]": "Bob"} and got[1].texts2 == 5
    assert all(got[i].clean is None and got[i].texts is None for i in (2, 3, 4))
    odd = spark.createDataFrame([(1, '{"prompt":"\\ud800 Bob \\ud83d\\ude00","\\udfff":"\\ud800"}')], "id int, body string")
    r = scrub_bodies(odd, RuleSet([Rule("name", "R", "IndividualName", "Redact", "Anna|Bob")])).first()
    assert r.texts == ["\ufffd Bob \U0001f600"] and r.clean == '{"prompt":"\ufffd [NAME_1] \U0001f600","\ufffd":"\ufffd"}'


def test_turns_are_prepared_by_small_batches(spark, monkeypatch):
    """A task's memory does not grow with the batches that Spark hands it, and sessions go on over their parts."""
    from veilframe.operators import sessions
    from veilframe.operators.engine import Engine
    from veilframe.sources.rules import RuleSet, pack

    class Watched(Engine):
        def prepared(self, texts, candidates=False):
            if len(texts) > 500:
                raise ValueError(f"{len(texts)} texts at once")
            return super().prepared(texts, candidates)

    monkeypatch.setattr(sessions, "Engine", Watched)
    rules = RuleSet([r for r in pack("base").rules if r.id == "email_address"])
    turns = spark.range(1200).selectExpr("'ann' AS username", "id AS seq", "concat('x', id % 700, '@mail.example') AS text")
    got = {r.seq: r.sanitized_text for r in sessions.scrub_sessions(turns, "username", "seq", rules).collect()}
    assert got == {i: f"[EMAIL_{i % 700 + 1}]" for i in range(1200)}
