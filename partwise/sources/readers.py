"""Item masters from CSV, JSON and table exports of an ERP, all brought to one schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.operators.graph import ranked

FIELDS = "cpse_code cpse_name plant matnr description long_text uom unit_price currency stock_qty annual_demand last_movement_days mfr_name mfr_part_no vendor_id vendor_name vendor_matl_no source_system".split()
NUMBERS = ["unit_price", "stock_qty", "annual_demand", "last_movement_days"]

# Header names in the wild, by field
ALIASES = {
    "matnr": "material material_code item_code code part_number stock_code inventory_id",
    "description": "material_description item_description desc short_text name",
    "uom": "unit uom_code base_uom issue_unit",
    "unit_price": "price rate moving_avg_price std_price valuation_price",
    "stock_qty": "qty quantity on_hand soh",
    "annual_demand": "demand annual_consumption consumption",
    "mfr_name": "manufacturer make brand",
    "mfr_part_no": "mpn manufacturer_part oem_part_no",
    "vendor_name": "supplier vendor",
    "vendor_id": "supplier_id",
    "vendor_matl_no": "supplier_part_no vendor_part",
    "cpse_code": "org",
    "cpse_name": "organisation organization",
    "plant": "location site depot warehouse",
    "last_movement_days": "last_issue_days days_since_movement",
}
FIELD_OF = {alias: name for name, names in ALIASES.items() for alias in names.split()}
DELIMITERS = ",;\t|"


def header_field(header: str) -> str | None:
    name = "_".join(header.strip().lstrip("﻿").lower().replace("-", " ").split())
    return name if name in FIELDS else FIELD_OF.get(name)


def normalised(df: DataFrame, org: str = "") -> DataFrame:
    """df with its columns renamed to FIELDS; unknown ones dropped, of several for one field the last that is not empty counts.

    Text is trimmed and '' is null; numbers lose thousands commas, and those
    that cannot be read are null. Rows without a description are dropped.
    """
    by_field: dict[str, list[str]] = {}
    for c in df.columns:
        if (name := header_field(c)) is not None:
            by_field.setdefault(name, []).append(c)
    columns = []
    for name in FIELDS:
        text = F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in reversed(by_field.get(name, []))], F.lit(None).cast("string"))
        if name in NUMBERS:
            text = F.regexp_replace(text, ",", "").try_cast("double")
        if name == "cpse_code" and org:
            text = F.coalesce(text, F.lit(org))
        columns.append(text.alias(name))
    return df.select(*columns).where("description IS NOT NULL")


def unmapped(df: DataFrame) -> list[str]:
    return [c for c in df.columns if header_field(c) is None]


def read_csv(spark: SparkSession, path: str, org: str = "", limit: int | None = None) -> DataFrame:
    """CSV whose delimiter is told from its first line; limit counts rows kept."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0].value if first else ""
    sep = max(DELIMITERS, key=line.count)
    out = normalised(spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path), org)
    return out if limit is None else out.limit(limit)


ENVELOPES = ["records", "items", "value", "data", "rows"]


def read_json(spark: SparkSession, path: str, org: str = "", limit: int | None = None) -> DataFrame:
    """A JSON list, or an object that holds one as records, items, value, data, rows or d.results."""
    df = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    kinds = dict(df.dtypes)
    for name in ENVELOPES:
        if kinds.get(name, "").startswith("array<struct"):
            df = df.select(F.explode(name).alias("row")).select("row.*")
            break
    else:
        if "results:array<struct" in kinds.get("d", ""):
            df = df.select(F.explode("d.results").alias("row")).select("row.*")
    out = normalised(df, org)
    return out if limit is None else out.limit(limit)


# Columns of ERP tables and their fields
ERP_COLUMNS = {
    "MARA": {"MATNR": "matnr", "MEINS": "uom", "MFRPN": "mfr_part_no", "MFRNR": "mfr_name"},
    "MAKT": {"MAKTX": "description"},
    "MARC": {"WERKS": "plant"},
    "MBEW": {"STPRS": "unit_price", "LBKUM": "stock_qty"},
    "EINA": {"LIFNR": "vendor_id", "IDNLF": "vendor_matl_no"},
}


def read_erp_tables(spark: SparkSession, folder: str, org: str, limit: int | None = None) -> DataFrame:
    """CSV exports MARA, MAKT, MARC, MBEW and EINA joined on MATNR; of several rows of a number the last counts.

    limit applies to MARA. A row without a description takes its number. A
    table that is absent leaves its fields null.
    """

    def last(name: str) -> DataFrame | None:
        try:
            raw = spark.read.option("header", True).csv(f"{folder}/{name}.csv")
        except Exception as e:  # the reader tells an absent path by this error class
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        rows = raw.withColumn("_n", F.monotonically_increasing_id())
        names = {c: f for c, f in ERP_COLUMNS[name].items() if c in raw.columns and c != "MATNR"}
        picked = rows.groupBy(F.trim("MATNR").alias("matnr")).agg(F.max_by(F.struct(*[F.col(c).alias(f) for c, f in names.items()], "_n"), "_n").alias("r"))
        return picked.select("matnr", *[f"r.{f}" for f in names.values()], *(["r._n"] if name == "MARA" else []))

    base = last("MARA")
    if base is None:
        raise FileNotFoundError(f"{folder}/MARA.csv")
    if limit is not None:
        base = base.orderBy("_n").limit(limit)
    for name in ("MAKT", "MARC", "MBEW", "EINA"):
        other = last(name)
        base = base if other is None else base.join(other, "matnr", "left")
    out = base.drop("_n")
    return normalised(out.withColumn("description", F.coalesce(F.nullif(F.trim("description"), F.lit("")), "matnr")), org)


def ingest(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """New rows laid over known ones by (cpse_code, matnr): the last row of a key counts, ids stay; rows without a number get AUTO and their place."""
    placed = ranked(rows.withColumn("_at", F.monotonically_increasing_id()), "_at").drop("_at")
    placed = placed.withColumn("matnr", F.coalesce("matnr", F.format_string("AUTO%08d", "rank")))
    newest = placed.groupBy("cpse_code", "matnr").agg(F.max_by(F.struct(*[c for c in placed.columns if c not in ("cpse_code", "matnr")]), "rank").alias("r"), F.min("rank").alias("first"))
    newest = newest.select("cpse_code", "matnr", *[F.col(f"r.{c}").alias(c) for c in placed.columns if c not in ("cpse_code", "matnr", "rank")], "first")
    if known is None:
        return ranked(newest, "first").withColumnRenamed("rank", "id").drop("first")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first().top
    ids = known.select("cpse_code", "matnr", "id")
    old = newest.join(ids, ["cpse_code", "matnr"])
    fresh = ranked(newest.join(ids, ["cpse_code", "matnr"], "left_anti"), "first").withColumn("id", F.col("rank") + top).drop("rank")
    rest = known.join(newest.select("cpse_code", "matnr"), ["cpse_code", "matnr"], "left_anti")
    return rest.unionByName(old.unionByName(fresh).drop("first"), allowMissingColumns=True)
