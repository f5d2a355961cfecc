"""OData services of an ERP: settings, request bodies, and answers brought to the one schema.

Requests are made by whoever runs the node; answers arrive as rows of text, so
that a read is a projection over them and can be repeated.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.sources import readers, writers

# Fields of the product service and ours
PRODUCT_FIELDS = {"Product": "matnr", "ProductDescription": "description", "BaseUnit": "uom", "ManufacturerPartNumber": "mfr_part_no", "ManufacturerNumber": "mfr_name"}
READ_PATH = "/sap/opu/odata/sap/API_PRODUCT_SRV/A_Product"
WRITE_PATH = "/sap/opu/odata/sap/API_MDG_CHANGEREQUEST_SRV/A_ChangeRequest"


@dataclass(frozen=True)
class Connection:
    """Where an organisation's item master is read from, and where its change requests go."""

    org: str
    mode: str = "csv"
    folder: str = ""
    base_url: str = ""
    client: str = "100"
    system_id: str = "S4H"
    outbox: str = ""
    secrets: tuple[str, ...] = field(default=(), repr=False)

    @classmethod
    def from_config(cls, org: str, config: dict) -> Connection:
        """Settings by name; unknown ones are left out, and a mode other than csv and odata is an error."""
        known = {k: str(v) for k, v in config.items() if k in ("mode", "folder", "base_url", "client", "system_id", "outbox")}
        if known.get("mode", "csv") not in ("csv", "odata"):
            raise ValueError(f"unknown mode {known['mode']}")
        return cls(org, **known)

    def describe(self) -> dict:
        """What a node may tell of its connection; never a secret."""
        live = self.mode == "odata" and bool(self.base_url)
        return {"organisation": self.org, "mode": self.mode, "live": live, "reads": READ_PATH if live else "MARA, MAKT, MARC, MBEW, EINA", "writes": WRITE_PATH if live else "outbox"}

    def read_url(self, top: int, skip: int = 0) -> str:
        return f"{self.base_url.rstrip('/')}{READ_PATH}?" + urlencode({"$top": top, "$skip": skip, "$select": ",".join(PRODUCT_FIELDS), "$format": "json", "sap-client": self.client}, safe="$,")

    def read(self, spark: SparkSession, answers: DataFrame | None = None, limit: int | None = None) -> DataFrame:
        """The item master: answers of the service in mode odata, else the table exports in the folder."""
        if self.mode == "odata":
            return products(answers, self.org, self.system_id)
        return readers.read_erp_tables(spark, self.folder, self.org, limit)

    def submit(self, requests: DataFrame) -> DataFrame:
        """Write-back requests: bodies to be posted in mode odata, else rows of the outbox, written once each."""
        if self.mode == "odata":
            return bodies(requests, f"{self.base_url.rstrip('/')}{WRITE_PATH}?sap-client={self.client}")
        writers.write_outbox(requests, self.outbox)
        return requests.select("idempotency_key", F.lit("sent").alias("status"), F.lit("outbox").alias("transport"))


def products(answers: DataFrame, org: str, system_id: str = "S4H") -> DataFrame:
    """Rows of answers (body: JSON with d.results, or value) in the one schema; an answer that is no JSON has none. A product without a description takes its number."""
    row = "struct<" + ",".join(f"{c}:string" for c in PRODUCT_FIELDS) + ">"
    told = answers.select(F.from_json("body", f"struct<d:struct<results:array<{row}>>,value:array<{row}>>").alias("b"))
    rows = told.select(F.explode(F.coalesce(F.when(F.size("b.d.results") > 0, F.col("b.d.results")), F.col("b.value"))).alias("r"))
    named = rows.select(*[F.col(f"r.{c}").alias(f) for c, f in PRODUCT_FIELDS.items()]).withColumn("description", F.coalesce(F.nullif("description", F.lit("")), "matnr"))
    return readers.normalised(named.withColumn("source_system", F.lit(f"SAP/{system_id}")), org)


def bodies(requests: DataFrame, url: str) -> DataFrame:
    """What is posted for each request: once per idempotency key."""
    return requests.dropDuplicates(["idempotency_key"]).select("idempotency_key", F.lit("POST").alias("method"), F.lit(url).alias("url"), F.col("payload").alias("body"))


def outcomes(posted: DataFrame) -> DataFrame:
    """idempotency_key, status, external_ref of posts (idempotency_key, code, body): sent for 2xx, with the service's reference or else the key."""
    ref = F.get_json_object("body", "$.d.ChangeRequest")
    ok = F.col("code").between(200, 299)
    return posted.select("idempotency_key", F.when(ok, "sent").otherwise("failed").alias("status"), F.when(ok, F.coalesce(ref, "idempotency_key")).alias("external_ref"))
