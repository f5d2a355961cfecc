"""The registry: codes per cluster, their members, and queries over both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.functions import codes
from partwise.functions import knowledge as K
from partwise.operators import classify as C
from partwise.operators import extract as E
from partwise.operators.graph import ranked


def golden_records(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, golden_id, class_code, golden_description): of each cluster the record with the best coverage, then completeness, then smallest id."""
    met = clusters.join(records.select("id", "class_code", "coverage", "completeness", "attributes"), "id")
    best = met.groupBy("cluster_id").agg(F.max_by(F.struct("id", "class_code", "attributes"), F.struct("coverage", "completeness", (-F.col("id")).alias("i"))).alias("g"))
    return best.select("cluster_id", F.col("g.id").alias("golden_id"), F.col("g.class_code").alias("class_code"), E.golden_description(F.col("g.class_code"), F.col("g.attributes")).alias("golden_description"))


def mint(golden: DataFrame, last_serial: int = codes.FIRST_SERIAL) -> DataFrame:
    """golden with serial and nmc: codes are numbered by cluster_id, from the last serial on."""
    nsc = C.by_class({c.code: c.nsc for c in K.CLASSES.values()}, F.col("class_code"), K.CLASSES[K.GENERIC].nsc)
    numbered = ranked(golden, "cluster_id").withColumn("serial", F.lit(last_serial) + F.col("rank")).drop("rank")
    return numbered.withColumn("nmc", codes.mint(F.col("serial"), nsc))


def members(minted: DataFrame, clusters: DataFrame) -> DataFrame:
    return clusters.join(minted.select("cluster_id", "nmc", "class_code", "golden_description"), "cluster_id").select("nmc", "class_code", "golden_description", F.col("id").alias("member"))


def groups(joined: DataFrame, least_orgs: int = 1) -> DataFrame:
    """Codes with their members as an array; joined: members with records' columns. Clusters are of bounded size."""
    row = F.struct(F.col("cpse_code").alias("org"), "member", "description", "uom", "unit_price", "base_price", "stock_qty", "annual_demand", "last_movement_days")
    out = joined.groupBy("nmc", "class_code", "golden_description").agg(F.array_sort(F.collect_list(row)).alias("members"), F.count_distinct("cpse_code").alias("orgs"))
    return out.where(F.col("orgs") >= least_orgs)


def with_records(member: DataFrame, records: DataFrame) -> DataFrame:
    return member.join(records.withColumnRenamed("id", "member"), ["member"]).drop("attributes_json")


def find_code(minted: DataFrame, code: str) -> DataFrame:
    """The code in any spelling, with or without check digit."""
    core = lambda c: codes.parse(c)["core"]
    return minted.where(core(F.col("nmc")) == core(F.lit(code)))


def search(joined: DataFrame, query: str = "", class_code: str = "", org: str = "", attributes: dict[str, str] | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Codes whose description or code holds the query; all filters before paging, which is the feature."""
    if query:
        joined = joined.where(F.contains(F.upper("golden_description"), F.lit(query.upper())) | F.contains("nmc", F.lit(query)))
    if class_code:
        joined = joined.where(F.col("class_code") == class_code)
    if org:
        joined = joined.where(F.col("cpse_code") == org)
    for k, v in (attributes or {}).items():
        joined = joined.where(F.try_element_at("attributes", F.lit(k))["value"] == v)
    return joined.groupBy("nmc", "class_code", "golden_description").agg(F.count("*").alias("members")).orderBy("nmc").offset(offset).limit(limit)


def proposals(decided: DataFrame, tier: str | None = "review", relation: str | None = None, class_code: str | None = None, org: str | None = None, order: Column | str = "priority", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the queue; ties by the ids."""
    for c, v in (("tier", tier), ("relation", relation), ("a_class_code", class_code)):
        if v is not None:
            decided = decided.where(F.col(c) == v)
    if org is not None:
        decided = decided.where((F.col("a_org") == org) | (F.col("b_org") == org))
    first = F.desc(order) if isinstance(order, str) else order
    return decided.orderBy(first, "a_id", "b_id").offset(offset).limit(limit)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str, keep: list[str] | None = None) -> DataFrame:
    """old with new laid over it by keys: the last row of a key by order wins; columns of keep stay as they first were."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    at = F.struct("_age", order)
    rest = [c for c in both.columns if c not in keys and c != "_age" and c not in (keep or [])]
    picked = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("n"), *[F.min_by(c, at).alias(c) for c in (keep or [])])
    return picked.select(*keys, *(keep or []), *[F.col(f"n.{c}").alias(c) for c in rest]).select(*old.columns)


def counts(records: DataFrame, decided: DataFrame, minted: DataFrame) -> DataFrame:
    """One row of counts over the whole registry."""
    r = records.agg(F.count("*").alias("materials"), F.count_distinct("cpse_code").alias("organisations"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "quarantine").alias("quarantined"), F.count_if(F.col("status") == "excluded").alias("excluded"))
    d = decided.agg(F.count("*").alias("proposals"), *[F.count_if(F.col("tier") == t).alias(t) for t in ("auto_accept", "review", "auto_reject")], F.count_if(F.col("relation") == "SUBSTITUTABLE").alias("substitutions"))
    return r.join(d).join(minted.agg(F.count("*").alias("codes")))


def organisations(records: DataFrame) -> DataFrame:
    return records.groupBy("cpse_code").agg(F.count("*").alias("materials"), F.count_distinct("plant").alias("plants"))


def change_requests(joined: DataFrame) -> DataFrame:
    """One write-back request per member, with its idempotency key; the system's own item number is never changed."""
    traits = F.array(F.struct(F.lit("ZNMC").alias("ATNAM"), F.col("nmc").alias("ATWRT")), F.struct(F.lit("ZNMC_CLASS_CODE").alias("ATNAM"), F.col("class_code").alias("ATWRT")))
    payload = F.struct(F.struct(F.lit("ZNMC_CLASS").alias("class"), F.lit("001").alias("class_type"), traits.alias("characteristics")).alias("classification"), F.struct(F.lit("ZNMC_XREF").alias("table"), F.col("matnr").alias("MATNR"), F.col("nmc").alias("NMC")).alias("z_xref"), F.col("golden_description").alias("proposed_standard_description"), F.lit(True).alias("requires_human_approval"))
    return joined.select(F.concat_ws("|", "cpse_code", "matnr", "nmc").alias("idempotency_key"), "cpse_code", "matnr", "nmc", F.to_json(payload).alias("payload"))
