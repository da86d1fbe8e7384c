"""The audit ledger: sealed payloads, a chain of MACs, verification, retention and reports.

A ledger is many subchains (a key, rows numbered by ``seq``), each cut into segments of ``SEGMENT`` rows that start from
a digest of their own name, so that no task ever folds more than a segment; one subchain and one long segment give the
single-chain form.  Each row's MAC covers the previous MAC, time, user, verdict, redactions and payload digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from veilframe.functions.crypto import bound_info, derive_key, framed, hmac_sha256
from veilframe.sources.tables import Tables

SEGMENT = 1000
#: Numbers of a chain that are numbered, or looked at for gaps, together; of times it is an hour.
STRETCH = 1_000_000
INFO = "audit-payload"
PURGED = "[REDACTED]"


def genesis(chain: Column, segment: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws("/", F.lit("genesis"), chain.cast("string"), segment.cast("string")).cast("binary"), 256))


def segment_of(seq: Column, size: int = SEGMENT) -> Column:
    return F.floor((seq - 1) / size).cast("long")


def message(prev: Column, ts: Column, user: Column, blocked: Column, redactions: Column, payload_hash: Column) -> Column:
    """A canonical encoding: every field with its length; a null is a length that no value has."""
    flag = F.when(blocked, F.unhex(F.lit("01"))).when(~blocked, F.unhex(F.lit("00")))
    parts = [prev, ts.cast("binary"), user.cast("binary"), flag, redactions.cast("binary"), payload_hash]
    return F.concat(*[F.coalesce(framed(p), F.unhex(F.lit("FFFFFFFF"))) for p in parts])


def stretch_of(order: Column, kind: S.DataType) -> Column:
    """A coarser order: equal or rising where ``order`` rises.  Texts and fractions have one stretch only."""
    if isinstance(kind, S.IntegralType):
        coarse = F.floor(order / STRETCH)
    elif isinstance(kind, (S.TimestampType, S.TimestampNTZType)):
        coarse = F.floor(F.unix_seconds(order.cast("timestamp")) / 3600)
    elif isinstance(kind, S.DateType):
        coarse = F.unix_date(order)
    else:
        coarse = F.lit(0)
    return F.coalesce(coarse.cast("long"), F.lit(-(1 << 63)))  # nulls come first


def numbered(events: DataFrame, chain: str, order: str, heads: DataFrame | None = None) -> DataFrame:
    """events with ``seq``, going on from the heads (chain, last_seq, last_hash), and ``_last`` (the head's MAC as hex).

    Rows are numbered within stretches of their order, and stretches by their counts, so that one chain is no single task.
    Rows of equal order are numbered by what they hold.
    """
    rows = events.withColumn("_at", stretch_of(F.col(order), events.schema[order].dataType))
    counts = rows.groupBy(chain, "_at").agg(F.count("*").alias("_n"))
    if heads is None:
        counts = counts.withColumn("_base", F.lit(0)).withColumn("_last", F.lit(None).cast("string"))
    else:
        known = heads.select(F.col("chain").cast(events.schema[chain].dataType).alias(chain), F.col("last_seq").alias("_base"), F.col("last_hash").alias("_last"))
        counts = counts.join(known, chain, "left")
    earlier = F.sum("_n").over(Window.partitionBy(chain).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(chain, "_at", "_last", (F.coalesce("_base", F.lit(0)) + F.coalesce(earlier, F.lit(0))).alias("_first"))
    ties = ("ts", "username", "is_blocked", "redactions_json", "raw")
    within = Window.partitionBy(chain, "_at").orderBy(order, *[c for c in ties if c != order])
    return rows.join(starts, [chain, "_at"]).withColumn("seq", (F.col("_first") + F.row_number().over(within)).cast("long"))


def append(events: DataFrame, chain: str, order: str, key: bytes, pepper: bytes, segment: int = SEGMENT, sealed: bool = True, heads: DataFrame | None = None) -> DataFrame:
    """events (chain, order, ts string, username, is_blocked, redactions_json, raw) to ledger rows.

    With heads, the ``anchor`` of a ledger written so far, chains go on where they end: in their segment, from their last
    MAC.  The payload is sealed for hex(previous MAC) and user, so rows cannot change places; unsealed rows keep a digest
    only.  Fields may be null (a null payload has no digest); a row without a chain is refused.
    """
    owned = F.coalesce(F.col(chain), F.raise_error(F.lit("a ledger row needs a chain")).cast(events.schema[chain].dataType))
    rows = numbered(events.withColumn(chain, owned), chain, order, heads).withColumn("segment", segment_of(F.col("seq"), segment))
    item = F.struct("seq", "ts", "username", "is_blocked", "redactions_json", "raw")
    groups = rows.groupBy(F.col(chain).alias("chain"), "segment").agg(F.sort_array(F.collect_list(item)).alias("rows"), F.max("_last").alias("_last"), F.min("seq").alias("_from"))

    def step(acc: Column, x: Column) -> Column:
        prev = acc["hash"]
        if sealed:
            owner = F.concat(F.lower(F.hex(prev)), F.coalesce(x["username"], F.lit("")))
            data = F.aes_encrypt(x["raw"].cast("binary"), derive_key(pepper, bound_info(INFO, owner)), F.lit("GCM"), F.lit("DEFAULT"), F.unhex(F.lit("")), owner.cast("binary"))
        else:
            data = x["raw"].cast("binary")

        def with_payload(data: Column) -> Column:
            digest = F.unhex(F.sha2(data, 256))
            mac = hmac_sha256(key, message(prev, x["ts"], x["username"], x["is_blocked"], x["redactions_json"], digest))
            row = F.struct(
                x["seq"].alias("seq"), x["ts"].alias("ts"), x["username"].alias("username"), x["is_blocked"].alias("is_blocked"), x["redactions_json"].alias("redactions_json"),
                F.lower(F.hex(digest)).alias("payload_hash"), F.lower(F.hex(mac)).alias("integrity_hash"), (data if sealed else F.lit(None).cast("binary")).alias("encrypted_data"),
            )
            return F.struct(mac.alias("hash"), F.array_append(acc["out"], row).alias("out"))

        return F.transform(F.array(data), with_payload)[0]

    row = "struct<seq:bigint,ts:string,username:string,is_blocked:boolean,redactions_json:string,payload_hash:string,integrity_hash:string,encrypted_data:binary>"
    fresh = F.col("_from") == F.col("segment") * segment + 1
    start = F.when(fresh, genesis(F.col("chain"), F.col("segment"))).otherwise(F.unhex("_last"))
    zero = F.struct(start.alias("hash"), F.array().cast(f"array<{row}>").alias("out"))
    return groups.select("chain", "segment", F.explode(F.aggregate("rows", zero, step, lambda acc: acc["out"])).alias("r")).select("chain", "segment", "r.*")


def extend(store: Tables, events: DataFrame, chain: str, order: str, key: bytes, pepper: bytes, app: str, batch: int, segment: int = SEGMENT, sealed: bool = True) -> bool:
    """The store's ledger goes on by a batch of events, with the heads of the chains that grew, in one transaction.

    A batch of a writer (``app``) counts once: False where it, or a later one, was there already.  Of the ledger itself
    nothing is read.
    """
    if (change := store.begin(app, batch)) is None:
        return False
    rows = append(events.withColumn(chain, F.col(chain).cast("string")), chain, order, key, pepper, segment, sealed, newest_heads(change.read("anchors")))
    written = change.append(rows, "audit_reports")  # nonces are random: heads are those of the rows as written
    change.merge(anchor(written), "anchors", newest_heads)
    change.commit()
    return True


def newest_heads(heads: DataFrame) -> DataFrame:
    return heads.groupBy("chain").agg(F.max("last_seq").alias("last_seq"), F.max_by("last_hash", "last_seq").alias("last_hash"))


def verify(ledger: DataFrame, key: bytes, segment: int = SEGMENT, skip_purged: bool = True) -> DataFrame:
    """ledger with ``verdict``: intact, archived (payload gone, MAC right), purged (trusted), gap or tampered.

    Each row is held against the stored MAC before it, so a break names its row.  skip_purged is the boot check; without
    it (the command-line check) a purged row counts as tampered.
    """
    w = Window.partitionBy("chain", "segment").orderBy("seq")
    first = F.col("seq") == F.col("segment") * segment + 1
    prev = F.when(first, genesis(F.col("chain"), F.col("segment"))).otherwise(F.unhex(F.lag("integrity_hash").over(w)))
    before = F.lag("seq").over(w)
    mac = hmac_sha256(key, message(prev, F.col("ts"), F.col("username"), F.col("is_blocked"), F.col("redactions_json"), F.unhex("payload_hash")))
    right = (F.lower(F.hex(mac)) == F.col("integrity_hash")) & (F.col("payload_hash").isNull() | F.unhex("payload_hash").isNotNull())
    payload = F.col("encrypted_data").isNull() | (F.sha2("encrypted_data", 256) == F.col("payload_hash"))
    purged = F.coalesce((F.col("username") == PURGED) | F.col("username").startswith("GDPR_"), F.lit(False))
    verdict = F.when(~first & (F.coalesce(before, F.lit(-1)) != F.col("seq") - 1), "gap")
    if skip_purged:
        verdict = verdict.when(purged, "purged")
    verdict = verdict.when(~F.coalesce(right & payload, F.lit(False)), "tampered").when(F.col("encrypted_data").isNull(), "archived").otherwise("intact")
    return ledger.withColumn("verdict", verdict)


def open_payload(row_prev: Column, user: Column, data: Column, pepper: bytes) -> Column:
    owner = F.concat(F.lower(F.hex(row_prev)), F.coalesce(user, F.lit("")))
    return F.try_aes_decrypt(data, derive_key(pepper, bound_info(INFO, owner)), F.lit("GCM"), F.lit("DEFAULT"), owner.cast("binary")).cast("string")


def anchor(ledger: DataFrame) -> DataFrame:
    """The last row of every subchain."""
    return ledger.groupBy("chain").agg(F.max("seq").alias("last_seq"), F.max_by("integrity_hash", "seq").alias("last_hash"))


def anchor_check(ledger: DataFrame, anchors: DataFrame) -> DataFrame:
    """Subchains that shrank, whose anchored row changed, or that have no anchor."""
    now = anchor(ledger)
    at = ledger.select("chain", F.col("seq").alias("last_seq"), F.col("integrity_hash").alias("found"))
    both = now.select("chain", F.col("last_seq").alias("now_seq")).join(anchors, "chain", "full").join(at, ["chain", "last_seq"], "left")
    verdict = F.when(F.col("last_hash").isNull(), "missing anchor").when(F.coalesce("now_seq", F.lit(0)) < F.col("last_seq"), "shrunk").when(~F.col("found").eqNullSafe(F.col("last_hash")), "changed").otherwise("ok")
    return both.select("chain", verdict.alias("verdict"))


def gaps(ids: DataFrame, column: str, chain: str | None = None) -> DataFrame:
    """Where the numbers of a subchain jump: (the number before, the number after).

    Numbers are compared within stretches of ``STRETCH``, and the ends of stretches with each other, so that a single
    chain is no single task: the last step has a row for each stretch.
    """
    keys = [chain] if chain else []
    own = F.floor(F.col(column) / STRETCH)
    inside = Window.partitionBy(*keys, "_at").orderBy(column)
    seen = ids.select(*keys, column, own.alias("_at")).withColumn("before_id", F.lag(column).over(inside))
    ends = seen.groupBy(*keys, "_at").agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    between = ends.withColumn("before_id", F.lag("_high").over(Window.partitionBy(*keys).orderBy("_at")))
    both = seen.select(*keys, "before_id", F.col(column).alias("after_id")).unionByName(between.select(*keys, "before_id", F.col("_low").alias("after_id")))
    return both.filter(F.col("after_id") != F.col("before_id") + 1)


def with_raw(reports: DataFrame, raw: DataFrame, key: str = "id") -> DataFrame:
    return reports.join(raw, key, "left")


def compliance(ledger: DataFrame, blocked: Column, at: Column, redactions: Column, digest: Column, order: Column) -> DataFrame:
    return ledger.agg(
        F.count("*").alias("total_requests"), F.sum(F.when(blocked, 1).otherwise(0)).cast("long").alias("total_blocked"), F.sum(redactions).cast("long").alias("total_redactions"),
        F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.max_by(digest, order).alias("last_hash"),
    )


def rule_frequency(ledger: DataFrame, column: str = "redactions_json") -> DataFrame:
    """How often each rule shows in the ledger's redaction lists."""
    found = F.explode(F.from_json(column, "array<struct<rule_id:string>>"))
    return ledger.select(found.alias("r")).groupBy(F.col("r.rule_id").alias("rule")).agg(F.count("*").alias("n"))


def purge(ledger: DataFrame, user: str) -> DataFrame:
    mine = F.col("username") == user
    return ledger.withColumn("encrypted_data", F.when(~mine, F.col("encrypted_data"))).withColumn("username", F.when(mine, PURGED).otherwise(F.col("username")))


def retain_raw(raw: DataFrame, at: Column, acked: Column, now: Column, days: int = 30) -> DataFrame:
    """Raw logs stay unless they are old and acknowledged."""
    return raw.filter(~((at < now - F.expr(f"INTERVAL {days} DAYS")) & acked))


def retain_sessions(sessions: DataFrame, at: Column, now: Column, hours: int = 24) -> DataFrame:
    return sessions.filter(at >= now - F.expr(f"INTERVAL {hours} HOURS"))


def under_pressure(raw: DataFrame, at: Column, acked: Column, now: Column, free_share: float, free_mb: float) -> DataFrame:
    """Below a tenth of free space acknowledged logs older than an hour go; below 50 MB the job stops."""
    if free_mb < 50:
        raise RuntimeError("less than 50 MB free: no more audit writes")
    return raw.filter(~((at < now - F.expr("INTERVAL 1 HOUR")) & acked)) if free_share < 0.1 else raw


def purge_everywhere(user: str, ledger: DataFrame | None = None, documents: DataFrame | None = None, owner: str = "username", **tables: DataFrame) -> dict[str, DataFrame]:
    """A user's rows leave documents and every other table with a username (jobs, threads, sessions); the ledger keeps its
    rows without their payload, so that its chain can still be verified."""
    out = {} if ledger is None else {"ledger": purge(ledger, user)}
    if documents is not None:
        out["documents"] = documents.filter(~F.col(owner).eqNullSafe(F.lit(user)))
    return out | {name: t.filter(~F.col("username").eqNullSafe(F.lit(user))) for name, t in tables.items()}


def acknowledge(ledger: DataFrame, acked: DataFrame, column: str = "siem_acked") -> DataFrame:
    """ledger with a flag: has the remote endpoint confirmed this row?  acked: (chain, seq) of confirmed rows, repeats allowed.
    A flag once set stays."""
    old = F.coalesce(F.col(column), F.lit(False)) if column in ledger.columns else F.lit(False)
    new = acked.select("chain", "seq").distinct().withColumn("_acked", F.lit(True))
    return ledger.withColumn(column, old).join(new, ["chain", "seq"], "left").withColumn(column, F.col(column) | F.coalesce("_acked", F.lit(False))).drop("_acked")
