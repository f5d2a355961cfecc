"""The ledger: an append-only, hash-chained log of events, and state as a fold over it."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.operators.graph import materialise, ranked

GENESIS = "0" * 64
# Kinds of events
EVENTS = "PROPOSED ENDORSED REJECTED MERGED SPLIT MINTED RECLASSIFIED SUPERSEDED DEPRECATED REINSTATED SUBSTITUTION_APPROVED ERP_WRITEBACK INGESTED PIPELINE_RUN".split()
SCHEMA = "seq long, event_type string, subject string, payload_json string, actor string, actor_cpse string, actor_role string, reason string, prev_hash string, hash string, created_at string"


def canonical_json(payload: dict) -> str:
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def digest(seq: int, event_type: str, payload_json: str, actor: str, prev_hash: str, created_at: str) -> str:
    return hashlib.sha256("|".join([str(seq), event_type, payload_json, actor, prev_hash, created_at]).encode()).hexdigest()


def digest_column() -> Column:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.sha2(F.concat_ws("|", *[text(c) for c in ("seq", "event_type", "payload_json", "actor", "prev_hash", "created_at")]), 256)


def append(spark: SparkSession, head: tuple[int, str], events: Iterable[dict], now: str | None = None) -> tuple[DataFrame, tuple[int, str]]:
    """Chain a batch of new events to head (last seq, last hash): their rows, and the new head.

    The chain is one sequence by definition, so a batch is chained by its one
    writer, on the driver; verification and replay are parallel. Each event has
    event_type, payload and actor, and may have subject, actor_cpse, actor_role, reason.
    """
    seq, prev = head
    rows = []
    for e in events:
        if e["event_type"] not in EVENTS:
            raise ValueError(f"unknown event type {e['event_type']}")
        seq += 1
        at = e.get("created_at") or now or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        payload = canonical_json(e.get("payload", {}))
        own = digest(seq, e["event_type"], payload, e["actor"], prev, at)
        rows.append((seq, e["event_type"], e.get("subject", ""), payload, e["actor"], e.get("actor_cpse", ""), e.get("actor_role", ""), e.get("reason", ""), prev, own, at))
        prev = own
    return spark.createDataFrame(rows, SCHEMA), (seq, prev)


def head(log: DataFrame) -> tuple[int, str]:
    row = log.agg(F.max(F.struct("seq", "hash")).alias("h")).first()
    return (row.h.seq, row.h.hash) if row.h else (0, GENESIS)


def chain_by_day(events: DataFrame) -> DataFrame:
    """events (event_id, event_type, payload_json, actor, created_at) as a log with one chain per day, each from GENESIS.

    A day is chained in one task, which streams over its events in order and
    holds a batch at a time; days in parallel. merkle_roots ties the days
    together. seq is the global rank by event_id.
    """
    rows = ranked(events.withColumn("day", F.substring("created_at", 1, 10)), "event_id").withColumnRenamed("rank", "seq")
    names = ["seq", "day", "event_type", "payload_json", "actor", "created_at"]

    def run(batches):
        day, prev = None, GENESIS
        for batch in batches:
            prevs, hashes = [], []
            for seq, own, kind, payload, actor, at in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                if own != day:
                    day, prev = own, GENESIS
                prevs.append(prev)
                prev = digest(seq, kind, payload, actor, prev, at)
                hashes.append(prev)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prevs, pa.string()), pa.array(hashes, pa.string())], names=[*names, "prev_hash", "hash"])

    kind = "seq long, day string, event_type string, payload_json string, actor string, created_at string, prev_hash string, hash string"
    filled = rows.select("seq", "day", "event_type", F.coalesce("payload_json", F.lit("")).alias("payload_json"), F.coalesce("actor", F.lit("")).alias("actor"), "created_at")
    return filled.repartition("day").sortWithinPartitions("day", "seq").mapInArrow(run, kind)


def verify(log: DataFrame, chain: str | None = None) -> DataFrame:
    """Rows of log that are not what was written: (seq, hash_ok, link_ok) of each bad one.

    Each hash is computed anew, and each prev_hash is held against the hash
    that is stored in the row before, by a join on seq (within the chain column,
    if named); one bad row does not make those behind it bad.
    """
    keys = [chain] if chain else []
    rows = log.select("seq", "prev_hash", "hash", (digest_column() == F.col("hash")).alias("hash_ok"), *keys)
    if chain:
        from pyspark.sql import Window

        link = F.coalesce(F.lag("hash").over(Window.partitionBy(chain).orderBy("seq")), F.lit(GENESIS))
        met = rows.withColumn("before", link)
    else:
        met = rows.join(log.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("before")), "seq", "left").withColumn("before", F.when(F.col("seq") == 1, F.lit(GENESIS)).otherwise(F.col("before")))
    return met.withColumn("link_ok", F.coalesce(F.col("before") == F.col("prev_hash"), F.lit(False))).where("NOT (hash_ok AND link_ok)").select("seq", "hash_ok", "link_ok")


def merkle_roots(log: DataFrame, key: str = "day") -> DataFrame:
    """Merkle root of the hashes of each key, in order of seq: pairs are hashed, an odd last one with itself, until one is left."""
    from pyspark.sql import Window

    level = log.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("seq")) - 1).alias("i"), F.col("hash").alias("h"))
    size = level.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while size > 1:
        counts = level.groupBy(key).agg(F.max("i").alias("last"))
        met = level.join(counts, key)
        paired = met.groupBy(key, F.floor(F.col("i") / 2).cast("int").alias("j"), "last").agg(F.min_by("h", "i").alias("left"), F.max_by("h", "i").alias("right"))
        level = materialise(paired.select(key, F.col("j").alias("i"), F.when(F.col("last") == 0, F.col("left")).otherwise(F.sha2(F.concat("left", "right"), 256)).alias("h")))
        size = (size + 1) // 2
    return level.select(key, F.col("h").alias("root"))


def replay(log: DataFrame, upto: int | None = None) -> DataFrame:
    """Membership (nmc, member) that the log leaves, from events MERGED and SPLIT up to a seq.

    A member is in a code if its last event there is MERGED. payload_json:
    {"nmc": code, "members": [ids]}.
    """
    log = log if upto is None else log.where(F.col("seq") <= upto)
    told = F.from_json("payload_json", "nmc string, members array<bigint>")
    each = log.where(F.col("event_type").isin("MERGED", "SPLIT")).select("seq", "event_type", told.alias("p")).select("seq", "event_type", "p.nmc", F.explode("p.members").alias("member"))
    last = each.groupBy("nmc", "member").agg(F.max_by("event_type", "seq").alias("last"))
    return last.where("last = 'MERGED'").select("nmc", "member")


def codes(log: DataFrame, upto: int | None = None) -> DataFrame:
    """Minted codes with class, description and whether they are deprecated."""
    log = log if upto is None else log.where(F.col("seq") <= upto)
    told = F.from_json("payload_json", "nmc string, class_code string, golden_description string")
    each = log.where(F.col("event_type").isin("MINTED", "DEPRECATED", "REINSTATED")).select("seq", "event_type", told.alias("p"))
    minted = each.where("event_type = 'MINTED'").groupBy(F.col("p.nmc").alias("nmc")).agg(F.max_by(F.struct("p.class_code", "p.golden_description"), "seq").alias("m"))
    state = each.where("event_type <> 'MINTED'").groupBy(F.col("p.nmc").alias("nmc")).agg((F.max_by("event_type", "seq") == "DEPRECATED").alias("deprecated"))
    return minted.join(state, "nmc", "left").select("nmc", "m.class_code", "m.golden_description", F.coalesce("deprecated", F.lit(False)).alias("deprecated"))


def projection_difference(log: DataFrame, members: DataFrame) -> DataFrame:
    """(nmc, member, where) that only the replayed log or only the table has."""
    both = replay(log).withColumn("l", F.lit(True)).join(members.select("nmc", "member").distinct().withColumn("t", F.lit(True)), ["nmc", "member"], "full")
    return both.where("l IS NULL OR t IS NULL").select("nmc", "member", F.when(F.col("t").isNull(), "log").otherwise("table").alias("where"))


def events(log: DataFrame, limit: int = 200, offset: int = 0, subject: str | None = None, event_type: str | None = None) -> DataFrame:
    """Events, the last first; limit and offset are the feature (a page)."""
    for c, v in (("subject", subject), ("event_type", event_type)):
        if v is not None:
            log = log.where(F.col(c) == v)
    return log.orderBy(F.desc("seq")).offset(offset).limit(limit)


# --- state transitions -------------------------------------------------------


def endorsements(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Open proposals (proposal_id, a_org, b_org) with who endorsed: complete once every owning organisation has, one vote each; registrars count for any."""
    owning = F.array_distinct(F.array("a_org", "b_org"))
    votes = decisions.where("decision = 'endorse'").groupBy("proposal_id").agg(F.array_sort(F.collect_set("actor_cpse")).alias("endorsed"), F.max(F.col("actor_role") == "registrar").alias("registrar"))
    met = proposals.join(votes, "proposal_id", "left").withColumn("endorsed", F.array_intersect(owning, F.coalesce("endorsed", F.array().cast("array<string>"))))
    waiting = F.array_except(owning, F.col("endorsed"))
    return met.select("proposal_id", "endorsed", waiting.alias("waiting_for"), ((F.size(waiting) == 0) | F.coalesce("registrar", F.lit(False))).alias("complete"))


def links(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(must, cannot) pairs a < b of stewards' final decisions (a_id, b_id, decision: merge or distinct); the last decision counts."""
    last = decisions.groupBy(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).agg(F.max_by("decision", "decision_id").alias("last"))
    return last.where("last = 'merge'").select("a", "b"), last.where("last = 'distinct'").select("a", "b")


def merge_events(pairs: Iterable[tuple[str, list[int], str | None, list[int]]], actor: str) -> list[dict]:
    """Events of merges (code, members, the code that they leave, who leaves it): what is left is split off in the same batch."""
    out = []
    for code, members, old, leaving in pairs:
        if old and old != code:
            out.append({"event_type": "SPLIT", "subject": old, "payload": {"nmc": old, "members": leaving}, "actor": actor, "reason": f"merged into {code}"})
        out.append({"event_type": "MERGED", "subject": code, "payload": {"nmc": code, "members": members}, "actor": actor})
    return out


def unmerge(spark: SparkSession, log: DataFrame, code: str, members: list[int], actor: str, reason: str) -> DataFrame:
    """log with a SPLIT of members from code; what replay gives before it is untouched."""
    new, _ = append(spark, head(log), [{"event_type": "SPLIT", "subject": code, "payload": {"nmc": code, "members": members}, "actor": actor, "reason": reason}])
    return log.unionByName(new)
