"""Owned documents, retrieval of context, and search jobs over them."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.crypto import seal, unseal
from veilframe.operators.sessions import first_k

# Words that a query leaves out.
STOP_WORDS = (
    "the a an and or but if then else to of in on at by for with about against between into through during before after above below from up down out over under "
    "again further once here there when where why how all any both each few more most other some such no nor not only own same so than too very can will just should now me tell who is it"
).split()
CONTEXT_DOCS, JOB_DOCS = 5, 3
JOB_INFO = "grounding"
#: What a word of a posting list is, and how many characters of a term are looked for first.
WORD, GRAM = r"[\p{IsAlphabetic}\p{N}]+", 3
#: Documents that questions meet first, how much larger each later part is than all before, ids from which cuts are estimated.
FIRST_DOCS, GROWTH, CUTS = 4096, 3, 10_000
#: Rows of a table of questions up to which it is sent to all tasks; larger ones are shuffled.
SENT_ROWS = 200_000
NOTHING = "No relevant context found."
#: Stands for a document that could not be scrubbed.
FAILED = "[REDACTION_FAILURE]"


def terms(query: str) -> list[str]:
    """Lower-case letters-and-digits words without stop words; all of them where nothing else is left."""
    found, word = [], ""
    for c in query.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            found.append(word)
            word = ""
    return [t for t in found if t not in STOP_WORDS] or found


def retrieve(docs: DataFrame, query: str, owner: str, order: str = "doc_id", k: int = CONTEXT_DOCS, user: str | None = None) -> DataFrame:
    """The first k documents of each owner (or of one user) that hold every term of the query, in order."""
    wanted = terms(query)
    if not wanted or k <= 0:
        return docs.limit(0).withColumn("rn", F.lit(0))
    low = F.lower("text")
    mine = docs if user is None else docs.filter(F.col(owner) == user)
    return first_k(mine.filter(reduce(lambda a, b: a & b, [F.contains(low, F.lit(t)) for t in wanted])), owner, order, k)


def add_documents(store: DataFrame, new: DataFrame) -> DataFrame:
    return store.unionByName(new)


def delete_documents(store: DataFrame, owner: str, user: str) -> DataFrame:
    return store.filter(~F.col(owner).eqNullSafe(F.lit(user)))


def enqueue(requests: DataFrame, pepper: bytes) -> DataFrame:
    """requests (username, thread_id, query, created_at) to pending jobs with a sealed query."""
    job = F.concat_ws(":", F.lit("SB-SESSION"), "username", "thread_id", F.expr("uuid()"))
    return requests.select(job.alias("id"), "username", "thread_id", seal(F.col("query"), F.col("username"), pepper, JOB_INFO).alias("query"), F.lit(None).cast("binary").alias("result"), F.lit("pending").alias("status"), "created_at")


def pending(jobs: DataFrame) -> DataFrame:
    return jobs.filter("status = 'pending'").orderBy("created_at", "id")


def index(docs: DataFrame, owner: str) -> DataFrame:
    """Posting lists (username, word, doc_id, version): which of a user's documents hold a word (a run of letters and digits,
    in lower case); version is the hash of the text, as a document may come again with another one.

    To be written once, sorted by user and word, and added to as documents come; a large user's lists lie apart by word.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0))
    return docs.select(F.col(owner).alias("username"), F.explode(words).alias("word"), "doc_id", F.xxhash64("text").alias("version"))


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT_ROWS else df


def _kept(df: DataFrame) -> DataFrame:
    """A small frame computed once, without the plan that it came from, which would grow with each round."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def held(wanted: DataFrame, postings: DataFrame) -> DataFrame:
    """(username, doc_id, version, terms): which of wanted (username, term) each document of a user holds.

    A term has no character that a word cannot have, so it stands in a text where it stands in one of its words: terms
    are looked for in the different words of all documents, first by three characters of theirs.
    """
    wanted = _kept(wanted.distinct())
    least = wanted.agg(F.min(F.length("term"))).first()[0] or 0
    postings = postings.filter(F.length("word") >= least)  # a shorter word holds no term
    terms, words = wanted.select("term").distinct(), postings.select("word").distinct()
    at = F.when(F.length("word") >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - GRAM + 1), lambda i: F.substring(F.col("word"), i, F.lit(GRAM)))))
    by_gram = words.select("word", F.explode(at).alias("gram")).join(terms.filter(F.length("term") >= GRAM).withColumn("gram", F.substring("term", 1, GRAM)), "gram")
    both = by_gram.select("word", "term").unionByName(words.crossJoin(terms.filter(F.length("term") < GRAM)).select("word", "term"))
    both = _kept(both.filter(F.contains("word", F.col("term"))))
    found = postings.join(_sent(both, both.count()), "word").join(_sent(wanted, wanted.count()), ["username", "term"])
    return found.groupBy("username", "doc_id", "version").agg(F.collect_set("term").alias("terms"))


def _rounds(documents: DataFrame) -> list[Column]:
    """Conditions that part the documents by their numbers, each part ``GROWTH`` times as large as all before; where they are
    cut is estimated, and no result depends on it."""
    n = documents.count()
    some = sorted(r.doc_id for r in documents.filter("doc_id IS NOT NULL").select("doc_id").sample(min(1.0, CUTS / max(n, 1)), 1).collect())
    cuts, size = [], FIRST_DOCS
    while size < n and some:
        cuts.append(some[min(len(some) - 1, size * len(some) // n)])
        size *= GROWTH + 1
    cuts, doc = sorted(set(cuts)), F.col("doc_id")
    if not cuts:
        return [F.lit(True)]
    return [doc.isNull() | (doc <= cuts[0]), *((doc > a) & (doc <= b) for a, b in zip(cuts, cuts[1:])), doc > cuts[-1]]


def candidates(asked: DataFrame, postings: DataFrame, k: int) -> tuple[DataFrame, int]:
    """(username, _q, doc_id, version) of the first k documents that hold all terms of a question, those with the number of
    the kth too, and how many these are; asked: different (username, _q, _terms).

    Documents are met by rounds in order of their numbers, and a question that has its k is not asked again, so a question
    about frequent terms ends early and one about rare terms meets few: it meets those that hold its rarest term.
    """
    documents = held(asked.select("username", F.explode("_terms").alias("term")), postings).persist(StorageLevel.DISK_ONLY)
    rounds = _rounds(documents)
    sizes = documents.select("username", F.explode("terms").alias("term")).groupBy("username", "term").agg(F.count("*").alias("n"))
    by_term = asked.select("username", "_q", "_terms", F.explode("_terms").alias("term")).join(sizes, ["username", "term"])
    rarest = by_term.groupBy("username", "_q").agg(F.first("_terms").alias("_terms"), F.min_by("term", F.struct("n", "term")).alias("term"), F.count("*").alias("known"))
    questions = _kept(rarest.filter(F.col("known") == F.size("_terms")).drop("known"))
    live, near, rows = questions, None, 0
    by_question = Window.partitionBy("username", "_q").orderBy("doc_id")
    for part in rounds:
        if not (left := live.count()):
            break
        each = documents.filter(part).select("username", "doc_id", "version", "terms", F.explode("terms").alias("term"))
        hits = each.join(_sent(live, left), ["username", "term"]).filter(F.forall("_terms", lambda t: F.array_contains("terms", t)))
        first = _kept(hits.select("username", "_q", "doc_id", "version").withColumn("rn", F.rank().over(by_question)).filter(F.col("rn") <= k).drop("rn"))
        rows += first.count()
        near = first if near is None else near.unionByName(first)
        done = near.groupBy("username", "_q").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
        live = questions.join(done, ["username", "_q"], "left_anti")
    documents.unpersist()
    return (asked.limit(0).join(documents.limit(0), "username").select("username", "_q", "doc_id", "version"), 0) if near is None else (near, rows)


def complete(jobs: DataFrame, docs: DataFrame, owner: str, pepper: bytes, scrubbed: Column | None = None, k: int = JOB_DOCS, postings: DataFrame | None = None) -> DataFrame:
    """Pending jobs answered: their query's terms all in a document of the same user; the first k, joined and sealed.

    Jobs of a user with the same terms are one question.  With postings (the ``index`` of docs) it meets the documents that
    hold its terms, without them every document of the user.  ``scrubbed`` is the text as it may be shown, and where it is
    null, as scrubbing failed, FAILED stands for it.
    """
    query = unseal(F.col("query"), F.col("username"), pepper, JOB_INFO).cast("string")
    parts = F.filter(F.split(F.lower(query), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: t != "")
    kept = F.filter(parts, lambda t: ~t.isin(*STOP_WORDS))
    asked = jobs.filter("status = 'pending'").withColumn("_terms", F.sort_array(F.array_distinct(F.when(F.size(kept) > 0, kept).otherwise(parts))))
    asked = asked.withColumn("_q", F.concat_ws(" ", "_terms"))
    shown = docs.select(F.col(owner).alias("username"), "doc_id", F.xxhash64("text").alias("version"), F.lower("text").alias("_low"), (F.coalesce(scrubbed, F.lit(FAILED)) if scrubbed is not None else F.col("text")).alias("_shown"))
    looked = asked.filter(F.size("_terms") > 0).select("username", "_q", "_terms").dropDuplicates(["username", "_q"])
    if postings is None:
        met = looked.join(shown, "username")
    else:
        looked = _kept(looked)
        near, rows = candidates(looked, postings, k)
        near = near.join(looked, ["username", "_q"]).select(F.col("username").alias("_user"), "_q", "_terms", F.col("doc_id").alias("_doc"), F.col("version").alias("_version"))
        met = shown.join(_sent(near, rows), (F.col("_user") == F.col("username")) & F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_version") == F.col("version"))).drop("_user", "_doc", "_version")
    hits = met.filter(F.forall("_terms", lambda t: F.contains(F.col("_low"), t)))
    best = first_k(hits.select("username", "_q", "doc_id", "_shown"), ["username", "_q"], ["doc_id", "_shown"], k)
    answer = best.groupBy("username", "_q").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "_shown"))), lambda x: x["_shown"]), "\n---\n").alias("_answer"))
    text = F.coalesce("_answer", F.lit(NOTHING))
    done = asked.drop("_terms", "result", "status").join(answer, ["username", "_q"], "left").withColumn("result", seal(text, F.col("username"), pepper, JOB_INFO)).withColumn("status", F.lit("completed")).drop("_answer")
    return jobs.filter("status <> 'pending'").unionByName(done.select(*jobs.columns))


def result_of(jobs: DataFrame, job: str, requester: str, pepper: bytes, admin: bool = False) -> DataFrame:
    """The answer, for its owner or an administrator only, once it is there."""
    mine = jobs.filter((F.col("id") == job) & (F.col("status") == "completed") & (F.lit(admin) | (F.col("username") == requester)))
    return mine.select("id", unseal(F.col("result"), F.col("username"), pepper, JOB_INFO).cast("string").alias("result"))


def may_search(role: Column, privileged: Column) -> Column:
    return (role == "admin") | privileged
