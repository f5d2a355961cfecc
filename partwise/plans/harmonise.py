"""The whole batch: canonical records, candidate pairs, verdicts, decisions, clusters, codes and ledger."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.functions import text as X
from partwise.operators import blocking as B
from partwise.operators import compare as M
from partwise.operators import extract as E
from partwise.operators import graph as G
from partwise.operators import ledger as L
from partwise.operators import registry as R


@dataclass
class Harmonised:
    records: DataFrame
    pairs: DataFrame
    clusters: DataFrame
    registry: DataFrame
    members: DataFrame
    calibration: DataFrame | None
    weights: list[float]
    funnel: dict[str, int] = field(default_factory=dict)


def records_of(items: DataFrame, lexicon: X.Lexicon | None = None) -> DataFrame:
    """Canonical records with keys, written once."""
    return G.materialise(B.with_keys(E.canonical(items, lexicon, more=B.with_text_keys)))


def verdicts(pairs: DataFrame, records: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """Pairs with rows, relation, features and score, written once."""
    solved = M.with_features(M.solved(M.compared(pairs, G.materialise(M.facts(records)))))
    return G.materialise(solved.withColumn("score", M.score(F.col("x"), weights)))


def training(pairs: DataFrame, records: DataFrame, decisions: DataFrame | None = None) -> tuple[DataFrame, list[float], DataFrame]:
    """(labelled scores, weights, thresholds) from all labels that the records and stewards' decisions give."""
    known = G.materialise(M.labelled(pairs, records, decisions).select("a_id", "b_id", F.col("a_class_code").alias("class_code"), "x", "label"))
    weights, _ = M.fit_on_all(known.select("x", "label"))
    scored = known.withColumn("score", F.round(M.score(F.col("x"), weights), 9))
    return scored, weights, M.thresholds(scored)


def harmonise(items: DataFrame, train: bool = True, mine: bool = False, vectors: bool = False, decisions: DataFrame | None = None, must: DataFrame | None = None, cannot: DataFrame | None = None) -> Harmonised:
    """items: the columns of the material view. Stewards' links go into the clustering."""
    lexicon = None
    if mine:
        lexicon = B.lexicon(B.mine_shorthand(items.select("id", X.clean(F.col("description")).alias("own_clean"))))
    records = records_of(items, lexicon)
    active = records.where("status = 'active'")
    vector = G.materialise(B.embed(active, idf=G.materialise(B.document_frequency(active)))) if vectors else None
    pairs = G.materialise(B.candidates(active, vector))
    if vector is not None:
        pairs = B.pair_cosine(pairs, vector)
    else:
        pairs = pairs.withColumn("cosine", F.lit(0.0))
    kept = G.materialise(B.survivors(pairs, active))
    judged = verdicts(kept, active)
    weights, calibration = list(M.PRIORS.values()), None
    if train:
        _, weights, calibration = training(judged, active, decisions)
        calibration = G.materialise(calibration)
        judged = judged.withColumn("score", M.score(F.col("x"), weights))
    judged = judged.withColumn("spend", M.annual_spend()).withColumn("priority", M.priority(F.col("score"), F.col("spend")))
    decided = G.materialise(M.decided(judged, calibration))
    edges = decided.where("tier = 'auto_accept' AND relation IN ('IDENTICAL', 'EQUIVALENT')").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("score").alias("weight"))
    apart = decided.where("relation = 'DISTINCT'").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    apart = apart if cannot is None else apart.union(cannot.select("a", "b"))
    clusters = G.materialise(G.cluster(active, edges, must, apart))
    registry = G.materialise(R.mint(R.golden_records(active, clusters)))
    member = G.materialise(R.members(registry, clusters))
    funnel = {"records": records.count(), "active": active.count(), "candidates": pairs.count(), "survivors": kept.count(), "decided": decided.count(), "codes": registry.count()}
    return Harmonised(records, decided, clusters, registry, member, calibration, weights, funnel)


def minted_events(done: Harmonised, actor: str = "engine") -> DataFrame:
    """MINTED and MERGED events of a run, as a log; one event per code."""
    minted = done.registry.select("nmc", F.lit("MINTED").alias("event_type"), F.to_json(F.struct("nmc", "class_code", "golden_description")).alias("payload_json"))
    merged = done.members.groupBy("nmc").agg(F.array_sort(F.collect_list("member")).alias("members")).select("nmc", F.lit("MERGED").alias("event_type"), F.to_json(F.struct("nmc", "members")).alias("payload_json"))
    numbered = G.ranked(minted.union(merged), "nmc", "event_type").withColumnRenamed("rank", "event_id")
    return L.chain_by_day(numbered.select("event_id", "event_type", "payload_json", F.lit(actor).alias("actor"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at")))
