"""Sinks: change requests, the cross-reference, and published records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_outbox(requests: DataFrame, folder: str) -> None:
    """Change requests as gzipped JSON lines, one per idempotency key; those already in the folder are not written again."""
    new = requests.dropDuplicates(["idempotency_key"])
    spark = requests.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        sent = spark.read.schema(requests.schema).json(folder).select("idempotency_key")
        new = new.join(sent, "idempotency_key", "left_anti")
    new.write.mode("append").json(folder, compression="gzip")


def write_cross_reference(members: DataFrame, folder: str) -> None:
    """Code, organisation and item number of every member as CSV with a header."""
    members.select(F.col("cpse_code"), F.col("matnr"), "nmc", "class_code", "description", "golden_description").write.mode("overwrite").option("header", True).csv(folder)


def write_lexicon(mined: DataFrame, folder: str, version: str) -> None:
    """A version of the mined shorthand; a run reads the version it names, so results never depend on what came after."""
    mined.write.mode("errorifexists").parquet(f"{folder}/version={version}")
