"""Quality rules, line dedup, chat formatting and secret scans against plain versions."""

import hashlib
import random

import plain
import pytest
from pyspark.sql import functions as F
from same import of_frame, of_sql

from veilframe.llm import chat_format, line_dedup, quality_rules, secret_scan
from veilframe.llm.queries import oracle_sql, queries
from veilframe.llm.util import scratch


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert of_frame(queries()[name](spark, sf_dir)) == of_sql(duck, oracle_sql()[name])


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_native_plans_hold_no_python(spark, sf_dir):
    for name in ("op2_line_dedup", "op4_chat_formatting", "op7_quality_rules", "op10_secret_scans"):
        assert no_python(queries()[name](spark, sf_dir)), name


# ---- quality rules


def test_base_statistics(odd):
    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.judge(odd).collect())
    assert got == sorted(plain.base_stats(r.text) for r in odd.select("text").collect())


def test_frequent_lines_go_and_depleted_documents_too(spark):
    body = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i, "menu home about\n" + body(i, 30), "a") for i in range(30)] + [(100 + i, "Menu  HOME about\n" + body(i, 30), "b") for i in range(5)]
    rows += [(200 + i, "menu home about\n" * 9 + body(900 + i, 3), "a") for i in range(3)]
    rows += [(300 + i, body(5000, 40), "a") for i in range(40)]  # exact copies are one document
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert got[0].kept and got[0].removed_words == 3 and got[100].removed_words == 0 and got[300].kept and got[300].removed_words == 0
    assert not got[200].kept and got[200].removed_words == 27
    assert not {r.doc_id: r.kept for r in quality_rules.judge(df, copies=True).collect()}[300]
    kept = {r.doc_id: r.text for r in quality_rules.stage(spark, df, "").collect()}
    assert kept[0] == body(0, 30) and kept[100].startswith("Menu") and 200 not in kept and len(kept) == 75


# ---- line dedup


@pytest.mark.parametrize("seed", range(3))
def test_runs_against_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = [(i, "\n".join(rng.choice(["a", "b b", "c", "", "d e "]) for _ in range(rng.randrange(0, 25)))) for i in range(20)]
    if seed == 2:
        docs = [(i, "x\n" * 20) for i in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for least in (1, 6):
        gone = plain.line_runs([t for _, t in docs], least)
        want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g) for (i, t), g in zip(docs, gone)}
        assert {r.doc_id: r.text for r in line_dedup.dedup(df, least).collect()} == want


def test_white_space_at_the_ends_of_lines_is_ignored(spark):
    line = " ".join(f"w{i}" for i in range(25))
    rows = [(0, f"{line}\nx"), (1, f"a\r\n\t{line}\r\nb"), (2, f"\x0b {line}\x0c \t")]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: rows[0][1], 1: "a\r\nb", 2: ""}


def test_ranks_are_a_suffix_array(spark):
    rng = random.Random(8)
    texts = ["\n".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    lines = line_dedup.line_table(df, 8)
    ids = {r.pos: (r.h1, r.h2) for r in lines.collect()}
    levels, _ = line_dedup.ascend(line_dedup._repeated(lines, ["h1", "h2"]).select("pos", "name"), 8)
    runs = {p: tuple(ids[q] for q in range(p, p + 300) if q in ids and q >> 8 == p >> 8) for p in ids}
    for k, level in enumerate(levels):
        named = sorted((r.name, runs[r.pos][: 1 << k]) for r in level.collect())
        assert all(len(run) == 1 << k for _, run in named)
        assert all((a == b) == (x == y) and x <= y for (a, x), (b, y) in zip(named, named[1:]))  # equal runs, equal ranks, in order
    ranks = {r.pos: r.ranks for r in line_dedup.suffix_array(levels).collect()}
    deep = max(len(r) for r in ranks.values()) - 1
    last = sorted((r, runs[p][: 1 << deep]) for p, r in ranks.items() if len(r) == deep + 1)
    assert deep > 1 and [x for _, x in last] == sorted(x for _, x in last)


def test_runs_on_documents(docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = {i: len(g) for (i, _), g in zip(rows, plain.line_runs([t for _, t in rows], line_dedup.MIN_WORDS))}
    assert {r.doc_id: r.removed_lines for r in line_dedup.dedup(docs).collect()} == want


def test_copies_lose_everything_and_null_stays(odd):
    out = line_dedup.dedup(odd).select("doc_id", "text", "emptied", F.col("doc.text").alias("before")).collect()
    by = lambda i: [r for r in out if r.doc_id == i]
    assert not by(5)[0].emptied and by(6)[0].emptied and by(9)[0].emptied and not by(8)[0].emptied
    assert by(0)[0].text is None and by(1)[0].text == "" and by(7)[0].text == "plus a tail of words" and by(11)[0].text == "x" and len(out) == odd.count()


# ---- chat formatting


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "&amp;lt;<s>", "<<SYS>> & <</SYS>>", "a <", "[", ">>", "<<ROLE:x>>", "\n\n", "", None]
    rows = [(c, t, role, nasty[(t + c) % len(nasty)]) for c in range(10) for t, role in enumerate(["system", "user", "assistant", "tool>", None, "user", "assistant"])]
    rows += [(50, 0, "user", "same"), (50, 0, "user", "same"), (None, None, "user", "x"), (None, 1, "assistant", "y" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_conversations(df).withColumn("turns", chat_format.read_back(F.col("formatted")))
    for r in out.collect():
        want = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]
        assert [(x.role, x.text) for x in r.turns] == want
        assert all(x.loss == (x.role == "assistant") for x in r.turns)


def test_chat_sql_on_hard_texts(spark, tmp_path):
    import duckdb

    texts = ["a >>> b", ">>>>", ">", "<<<SYS>>>", "<<s>>", "&gt;>", "[[INST]]", "<</ROLE>>>>", "<</SYS>>>> &amp;", "a\n>>\n>", "", None]
    roles = ["user", "assistant", "system", "tool>>x", "a<<ROLE:b", "<s>&", None]
    rows = [(c, t, roles[(c + t) % len(roles)], texts[(3 * c + t) % len(texts)]) for c in range(12) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    duck = duckdb.connect()
    duck.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert of_frame(chat_format.op4_chat_formatting(spark, str(tmp_path))) == of_sql(duck, chat_format.SQL)
    df.limit(0).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert chat_format.op4_chat_formatting(spark, str(tmp_path / "none")).count() == 1  # the added conversation alone


def test_machine(spark):
    runs = {1: "system user assistant user assistant", 2: "user assistant", 3: "assistant user", 4: "user user", 5: "system assistant", 6: "user assistant system", 7: "user tool"}
    df = spark.createDataFrame([(c, t, r, "x") for c, s in runs.items() for t, r in enumerate(s.split())], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.valid for r in chat_format.format_conversations(df).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False}
    by_turn = {(r.conv_id, r.turn): r.valid for r in chat_format.segments(df).collect()}
    assert by_turn[4, 0] and not by_turn[4, 1] and by_turn[7, 0] and not by_turn[7, 1]


def test_added_conversation(spark, sf_dir):
    r = chat_format.op4_chat_formatting(spark, sf_dir).filter("conv_id = -7").first()
    t = chat_format.ADDED_TEXT
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(t), hashlib.sha256(t.encode()).hexdigest()) and r.valid
    assert r.turns_sha256 == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()


# ---- secret scans

TRICKY = [
    "token=token:abcdefgh", "PASSWORD: 'hunter2x'", "api_key=abc", "apikey   =   \"ab/c+d=.e-f\"", "secretsecret=123456", "AKIA" + "A" * 16, "AKIAAKIA" + "B" * 12, "x" + "0123456789abcdef" * 2, "ABCDEF0123456789abcdef01",
    "é token=abcdef é 0123456789abcdef01234567", "password=password=password=x", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.abc-_d", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 12, "token\t=abcdef", "ſecret=abcdef", "secret =\n abcdef",
]


def test_spans_against_python(spark, odd, docs):
    texts = TRICKY + [r.text for r in odd.select("text").collect()] + [r.text for r in docs.select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_scan.scan_documents(df).collect():
        assert [(x.s, x.k, x.e) for x in r.found] == plain.secrets(texts[r.doc_id], secret_scan.KINDS), texts[r.doc_id]


def test_ledger_scans_only_what_is_new(spark):
    path = scratch(spark, "test-ledger")
    first = spark.createDataFrame([(1, "token=abcdef"), (2, "token=abcdef"), (3, "clean")], "doc_id long, text string")
    out = secret_scan.scan_documents(first, path)
    assert {r.doc_id: len(r.found) for r in out.collect()} == {1: 1, 2: 1, 3: 0}
    ledger = secret_scan.Ledger(spark, path)
    assert ledger.scanned().count() == 2
    ledger.scan(first.select("text"))
    assert ledger.scanned().count() == 2
    second = first.union(spark.createDataFrame([(4, "secret: xyzxyz")], "doc_id long, text string"))
    assert {r.doc_id: len(r.found) for r in secret_scan.scan_documents(second, path).collect()}[4] == 1 and ledger.scanned().count() == 3
    ledger.scan(first.select("text"), rule_version="other")
    assert ledger.scanned().count() == 5


def test_masking(spark):
    df = spark.createDataFrame([(1, "a token=abcdef0123456789abcdef0123 b", 9), (2, None, 0), (3, "x", 1)], "doc_id long, text string, n_chars long")
    assert {r.doc_id: (r.text, r.n_chars) for r in secret_scan.stage(spark, df, "").collect()} == {1: ("a [assign] b", 12), 2: (None, 0), 3: ("x", 1)}


# ---- all of them: columns stay, empty tables pass


def test_stages_keep_columns_and_take_empty_tables(spark, odd):
    from veilframe.llm import ngram_join

    for stage in (quality_rules.stage, line_dedup.stage, ngram_join.stage, secret_scan.stage):
        out = stage(spark, odd, "")
        assert out.dtypes == odd.dtypes and all(r.row == "row" and r.found == "found" for r in out.collect())
        assert stage(spark, odd.limit(0), "").count() == 0


def test_windows_of_words_are_hashed_by_halves(spark):
    """No list of eight hashes for each word, and texts about as long as a window are counted as by hand."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (*range(0, 40), 200) for _ in range(4)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", quality_rules.base_stats(F.col("text"))["n_repeat_words"].alias("n"))
    assert {r.id: r.n for r in rows.collect()} == {i: plain.base_stats(t)[-1] for i, t in enumerate(texts)}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and plan.count("zip_with(") > 3
