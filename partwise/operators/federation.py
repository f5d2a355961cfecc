"""What may cross an organisation's border: hashed keys, set sizes, price bands and signed bundles."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.functions import codes

# Fields that never leave a node
CONFIDENTIAL = "unit_price unit_price_base currency stock_qty stock_value vendor_id vendor_name annual_demand annual_spend last_po_date".split()
PRIVATE_KEYS = ["mfr_part_no", "vendor_matl_no"]
K_ANONYMITY = 3


def redact(records: DataFrame, fields: list[str] = CONFIDENTIAL) -> DataFrame:
    return records.drop(*fields, "base_price")


def publishable(records: DataFrame, salt: str) -> DataFrame:
    """Redacted records with keyed hashes of their keys instead of the makers' and vendors' numbers."""
    hashed = records.withColumn("hashed_keys", F.transform("keys", lambda k: codes.keyed(k, salt)))
    return redact(hashed).drop(*PRIVATE_KEYS, "keys", "identity", "raw")


def commitment(salt: str) -> str:
    """Shows that two nodes use one salt without telling it."""
    return hashlib.sha256(salt.encode()).hexdigest()[:16]


def offer(keys: DataFrame, salt: str) -> DataFrame:
    """Distinct keyed hashes of keys (key)."""
    return keys.where("key IS NOT NULL").select(codes.keyed(F.col("key"), salt).alias("h")).distinct()


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of the intersection and of what only one offer has."""
    both = a.select("h").withColumn("a", F.lit(1)).join(b.select("h").withColumn("b", F.lit(1)), "h", "full")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))


def price_bands(prices: DataFrame, key: str = "nmc", k: int = K_ANONYMITY) -> DataFrame:
    """prices (key, org, price): by key with k organisations or more, order statistics of their mean prices.

    With n means in order: p25 is number floor(n / 4), one less if n / 4 is
    whole; p75 number floor(3 n / 4), at most n - 1; the median is the mean of
    the middle two. Keys with fewer organisations are not shown at all.
    """
    mean = F.round((F.sum(F.col("price").cast("decimal(20,6)")) / F.count("price")).cast("double"), 6)
    by_org = prices.where("price IS NOT NULL").groupBy(key, "org").agg(mean.alias("m"))
    held = by_org.groupBy(key).agg(F.array_sort(F.collect_list("m")).alias("m"), F.count("*").alias("contributors")).where(F.col("contributors") >= k)
    n = F.col("contributors")
    at = lambda i: F.get("m", i.cast("int"))
    q = F.floor(n / 4)
    low = F.when(n % 4 == 0, F.greatest(q - 1, F.lit(0))).otherwise(q)
    middle = F.when(n % 2 == 1, at(F.floor(n / 2))).otherwise((at(F.floor(n / 2) - 1) + at(F.floor(n / 2))) / 2)
    return held.select(key, "contributors", at(F.lit(0)).alias("min"), at(low).alias("p25"), F.round(middle, 6).alias("median"), at(F.least(n - 1, F.floor(3 * n / 4))).alias("p75"), at(n - 1).alias("max"), F.round(F.try_divide(at(n - 1), at(F.lit(0))), 4).alias("spread"))


def broadcast_surplus(request: DataFrame, holders: DataFrame) -> DataFrame:
    """Who is told of a request (nmc, org, qty): other holders of the code, without their stock."""
    return request.withColumnRenamed("org", "asking").join(holders.select("nmc", "org"), "nmc").where("org <> asking").select("nmc", "asking", "qty", "org").distinct()


def export_bundle(published: DataFrame, node: str, key: str, most: int = 100_000) -> dict:
    """A signed bundle of at most `most` published records, made on the driver; larger sets go as files."""
    rows = [json.loads(r) for r in published.limit(most + 1).toJSON().collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} records: write them as files and sign their digests")
    body = json.dumps({"node": node, "records": rows}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return {"body": body, "sha256": hashlib.sha256(body.encode()).hexdigest(), "signature": hmac.new(key.encode(), body.encode(), hashlib.sha256).hexdigest()}


def verify_bundle(bundle: dict, key: str) -> dict:
    intact = hashlib.sha256(bundle["body"].encode()).hexdigest() == bundle["sha256"]
    signed = hmac.compare_digest(hmac.new(key.encode(), bundle["body"].encode(), hashlib.sha256).hexdigest(), bundle["signature"])
    return {"intact": intact, "signed": signed, "valid": intact and signed}


def boundary(records: DataFrame) -> dict:
    return {"leaves": [c for c in redact(records).columns if c not in PRIVATE_KEYS], "stays": [c for c in records.columns if c in CONFIDENTIAL or c in PRIVATE_KEYS], "k_anonymity": K_ANONYMITY}
