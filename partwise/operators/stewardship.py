"""What stewards decide: state transitions of proposals, substitutions, links and write-back requests, as folds over decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.operators import ledger as L
from partwise.operators import registry as R


def statuses(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """proposal_id, status, endorsed, waiting_for of every proposal (proposal_id, a_org, b_org) after all decisions.

    decisions: decision_id, proposal_id, decision (endorse, reject or distinct),
    actor, actor_cpse, actor_role. The last rejection counts from its place on:
    endorsements before it are void. endorsed: all owning organisations, or a
    registrar, have endorsed; partial: some have; open: nobody decided.
    """
    no = decisions.where("decision IN ('reject', 'distinct')").groupBy("proposal_id").agg(F.max("decision_id").alias("rejected_at"))
    later = decisions.join(no, "proposal_id", "left").where("rejected_at IS NULL OR decision_id > rejected_at")
    votes = L.endorsements(proposals, later)
    met = votes.join(no, "proposal_id", "left")
    status = F.when(F.col("complete"), "endorsed").when(F.size("endorsed") > 0, "partial").when(F.col("rejected_at").isNotNull(), "rejected").otherwise("open")
    return met.select("proposal_id", status.alias("status"), "endorsed", "waiting_for")


def constraints(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """a, b, kind of the links that decisions leave: must for merges, cannot for distinct pairs; the last decision on a pair counts."""
    told = decisions.where("decision IN ('endorse', 'distinct')").join(proposals.select("proposal_id", "a_id", "b_id"), "proposal_id")
    told = told.withColumn("decision", F.when(F.col("decision") == "endorse", "merge").otherwise("distinct"))
    must, cannot = L.links(told)
    return must.withColumn("kind", F.lit("must")).union(cannot.withColumn("kind", F.lit("cannot")))


def approved(edges: DataFrame, approvals: DataFrame) -> DataFrame:
    """Substitution edges (from_id, to_id) with status and who approved them last (approvals: from_id, to_id, actor, decision_id)."""
    last = approvals.groupBy("from_id", "to_id").agg(F.max_by("actor", "decision_id").alias("approved_by"))
    return edges.join(last, ["from_id", "to_id"], "left").withColumn("status", F.when(F.col("approved_by").isNotNull(), "approved").otherwise("proposed"))


def queued(members: DataFrame, codes: DataFrame) -> DataFrame:
    """Write-back requests, status queued, of all members of codes (nmc)."""
    return R.change_requests(members.join(codes.select("nmc").distinct(), "nmc", "left_semi")).withColumn("status", F.lit("queued"))


def with_status(requests: DataFrame, updates: DataFrame) -> DataFrame:
    """requests with the last status that updates (idempotency_key, status, at) give them."""
    last = updates.groupBy("idempotency_key").agg(F.max_by("status", "at").alias("_new"))
    return requests.join(last, "idempotency_key", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def unlinked(members: DataFrame, leaving: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members that stay, SPLIT payloads by code) when leaving (nmc, member) leave their codes."""
    gone = members.select("nmc", "member").join(leaving.select("nmc", "member").distinct(), ["nmc", "member"], "left_semi")
    events = gone.groupBy("nmc").agg(F.array_sort(F.collect_list("member")).alias("members"))
    return members.join(gone, ["nmc", "member"], "left_anti"), events.select("nmc", F.to_json(F.struct("nmc", "members")).alias("payload_json"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The last run (run_id, ...) as one row; none if there was none."""
    return runs.orderBy(F.desc("run_id")).limit(1)


def by_ids(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of table whose key is among ids, each once."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def label_summary(labels: DataFrame) -> DataFrame:
    """source, positive, negative, total of labels, and a row for all sources."""
    return labels.groupBy("source").agg(*_counts()).unionByName(labels.agg(*_counts()).withColumn("source", F.lit("*"))).select("source", "positive", "negative", "total")


def _counts() -> list:
    return [F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") != 1).alias("negative"), F.count("*").alias("total")]
