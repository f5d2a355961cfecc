"""What the registry is worth: value levers, prices, sectors, curves. Inputs are members joined with their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.functions import text as X
from partwise.functions import uom as U
from partwise.operators.graph import ranked

IDLE_DAYS = 365
REALISABLE = 0.45
UPKEEP = 850.0

# Sectors of known organisations
SECTORS = {
    "Oil & Gas": "ONGC IOCL BPCL HPCL GAIL OIL CPCL".split(), "Power": "NTPC NHPC PGCIL".split(), "Steel": "SAIL RINL".split(), "Mining": "CIL NMDC".split(), "Heavy Engineering": "BHEL HEC".split(),
}


def money(c: Column) -> Column:
    """A decimal, so that sums do not depend on their order."""
    return c.cast("decimal(38,6)")


def sector_of(org: Column, sectors: dict[str, list[str]] = SECTORS) -> Column:
    return F.coalesce(F.try_element_at(X.mapping({o: s for s, orgs in sectors.items() for o in orgs}), F.upper(F.trim(org))), F.lit("Unassigned"))


def pooling_reduction(k: Column) -> Column:
    """Square-root law: 1 - 1 / sqrt(k)."""
    return F.when(k > 1, 1 - 1 / F.sqrt(k.cast("double"))).otherwise(0.0)


def redeployment(members: DataFrame, idle_days: int = IDLE_DAYS) -> DataFrame:
    """Idle stock of one organisation that another one of the same code demands: every such pair, not netted (an upper bound)."""
    side = lambda p: members.select("nmc", *[F.col(c).alias(f"{p}_{c}") for c in ("member", "cpse_code", "stock_qty", "annual_demand", "base_price", "last_movement_days")])
    idle = side("from").where((F.col("from_stock_qty") > 0) & (F.col("from_last_movement_days") >= idle_days))
    met = idle.join(side("to").where("to_annual_demand > 0"), "nmc").where("from_cpse_code <> to_cpse_code")
    qty, price = F.least("from_stock_qty", "to_annual_demand"), F.coalesce(F.nullif("to_base_price", F.lit(0.0)), "from_base_price")
    out = met.select("nmc", "from_member", "to_member", "from_cpse_code", "to_cpse_code", qty.alias("qty"), price.alias("price"), F.round(qty * price, 2).alias("value"), F.col("from_last_movement_days").alias("idle_days"))
    return out.where("value > 0")


def pooling(members: DataFrame) -> DataFrame:
    """By code with stock at two organisations or more: stock value, pooled value by the square-root law, saving."""
    by_org = members.where("stock_qty > 0").groupBy("nmc", "cpse_code").agg(F.sum(money(F.col("stock_qty") * F.coalesce("base_price", F.lit(0.0)))).alias("value"))
    held = by_org.groupBy("nmc").agg(F.count_if(F.col("value") > 0).alias("locations"), F.count("*").alias("orgs"), F.sum("value").cast("double").alias("current")).where("orgs >= 2")
    return held.select("nmc", "locations", F.round("current", 2).alias("current"), F.round(F.col("current") * pooling_reduction(F.col("locations")), 2).alias("saving"))


def aggregation(members: DataFrame) -> DataFrame:
    """By code demanded by two organisations or more: yearly spend and the spread of prices."""
    spend = F.sum(money(F.coalesce("annual_demand", F.lit(0.0)) * F.coalesce("base_price", F.lit(0.0)))).cast("double")
    price = F.when(F.col("base_price") > 0, F.col("base_price"))
    out = members.groupBy("nmc").agg(F.count_distinct(F.when(F.col("annual_demand") > 0, F.col("cpse_code"))).alias("orgs"), F.round(spend, 2).alias("annual_spend"), F.round(F.try_divide(F.max(price), F.min(price)), 3).alias("price_spread"))
    return out.where("orgs >= 2")


def upkeep(members: DataFrame, cost: float = UPKEEP) -> DataFrame:
    n = members.agg((F.count("*") - F.count_distinct("nmc")).alias("duplicates"))
    return n.select("duplicates", (F.col("duplicates") * cost).alias("value"))


def value_model(members: DataFrame) -> DataFrame:
    """lever, measured, value of all four; aggregation is a volume and in no total."""
    total = lambda df, c, name, measured, factor=1.0: df.agg(F.round(F.coalesce(F.sum(money(F.col(c))).cast("double"), F.lit(0.0)) * factor, 2).alias("value")).select(F.lit(name).alias("lever"), F.lit(measured).alias("measured"), "value")
    # Sums over exact decimals, rounded once.
    moved = redeployment(members).withColumn("value", F.col("qty") * F.col("price"))
    bought = members.join(aggregation(members).select("nmc"), "nmc", "left_semi").select((F.coalesce("annual_demand", F.lit(0.0)) * F.coalesce("base_price", F.lit(0.0))).alias("annual_spend"))
    return (
        total(moved, "value", "redeployment", True)
        .union(total(pooling(members), "saving", "pooling", False, REALISABLE))
        .union(total(bought, "annual_spend", "aggregation", True))
        .union(total(upkeep(members), "value", "upkeep", False))
    )


def by_class(records: DataFrame) -> DataFrame:
    mean = lambda c: F.round((F.sum(F.col(c).cast("decimal(20,8)")) / F.count(c)).cast("double"), 4)
    return records.groupBy("class_code").agg(F.count("*").alias("records"), mean("coverage").alias("coverage"), mean("completeness").alias("completeness"))


def duplicate_rate(members: DataFrame) -> DataFrame:
    out = members.groupBy("class_code").agg(F.count("*").alias("members"), F.count_distinct("nmc").alias("codes"))
    return out.withColumn("duplicate_rate", F.round(1 - F.col("codes") / F.col("members"), 4))


def by_organisation(records: DataFrame) -> DataFrame:
    return records.groupBy("cpse_code").agg(F.count("*").alias("records"), *[F.count_if(F.col("status") == s).alias(s) for s in ("active", "quarantine", "excluded")])


def cross_sector(members: DataFrame, sectors: dict[str, list[str]] = SECTORS) -> DataFrame:
    """Pairs of sectors with the number of codes that both have; codes have members of bounded number."""
    each = members.select("nmc", sector_of(F.col("cpse_code"), sectors).alias("sector")).distinct()
    a, b = each.withColumnRenamed("sector", "a"), each.withColumnRenamed("sector", "b")
    return a.join(b, "nmc").where("a < b").groupBy("a", "b").agg(F.count("*").alias("codes"))


def price_anomalies(members: DataFrame, least: float = 2.5, limit: int = 25) -> DataFrame:
    """Codes whose dearest and cheapest members are far apart, and whether their units explain it; the top ones are the feature."""
    row = F.struct("cpse_code", "uom", "unit_price", "own_clean", "member")
    ends = members.where("unit_price > 0").groupBy("nmc").agg(F.min_by(row, F.struct("unit_price", "member")).alias("lo"), F.max_by(row, F.struct("unit_price", "member")).alias("hi"), F.count("*").alias("n"), F.count_distinct("cpse_code").alias("orgs"))
    unit = lambda s: U.resolve(F.col(f"{s}.uom"), F.col(f"{s}.own_clean"))
    ends = ends.where("n >= 2 AND orgs >= 2").withColumn("lu", unit("lo")).withColumn("hu", unit("hi"))
    ends = ends.withColumn("a", U.anomaly(F.col("lo.unit_price"), F.col("lu"), F.col("hi.unit_price"), F.col("hu")))
    return ends.where(F.col("a.raw_ratio") > least).select("nmc", F.col("lo.cpse_code").alias("low_org"), F.col("hi.cpse_code").alias("high_org"), "a.*").orderBy(F.desc("raw_ratio"), "nmc").limit(limit)


def value_curve(queue: DataFrame, buckets: int = 20) -> DataFrame:
    """After each of `buckets` equal shares of the queue by priority: rows reviewed and the share of spend reached."""
    rows = ranked(queue.select("a_id", "b_id", "priority", money(F.col("spend")).alias("spend")), F.desc("priority"), F.col("a_id"), F.col("b_id"), running=["spend"])
    total = queue.agg(F.count("*").alias("n"), F.sum(money(F.col("spend"))).alias("all"))
    met = rows.join(F.broadcast(total))
    bucket = F.ceil(F.col("rank") * buckets / F.col("n"))
    return met.groupBy(bucket.cast("int").alias("bucket")).agg(F.max("rank").alias("reviewed"), F.max("run_spend").cast("double").alias("spend"), F.round(F.max(F.try_divide("run_spend", "all")).cast("double"), 6).alias("share"))
