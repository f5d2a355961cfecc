"""State of what is learned, as plain rows: weights, thresholds, term weights, packed vectors; and tables that explain the scheme."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.functions import codes
from partwise.functions import knowledge as K
from partwise.operators import compare as M
from partwise.operators import kg

STATE = "name string, body string"


def scorer_state(weights: list[float], history: list[float] | None = None, trained_on: int = 0) -> dict:
    return {"weights": dict(zip(M.PRIORS, map(float, weights), strict=True)), "history": list(history or []), "trained_on": trained_on}


def weights_of(state: dict) -> list[float]:
    """Weights in the order of the features; one that the state lacks keeps its prior."""
    return [float(state.get("weights", {}).get(name, prior)) for name, prior in M.PRIORS.items()]


def weight_table(spark: SparkSession, weights: list[float]) -> DataFrame:
    rows = [(n, float(w), float(p), float(w) - float(p)) for (n, p), w in zip(M.PRIORS.items(), weights, strict=True)]
    return spark.createDataFrame(rows, "feature string, weight double, prior double, moved double")


def save(spark: SparkSession, path: str, **states: dict) -> None:
    """States by name, one JSON text each, as a Parquet table."""
    spark.createDataFrame([(n, json.dumps(s, sort_keys=True)) for n, s in states.items()], STATE).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> dict[str, dict]:
    return {r.name: json.loads(r.body) for r in spark.read.schema(STATE).parquet(path).collect()}


def save_table(df: DataFrame, path: str) -> None:
    """Thresholds or term weights, of any number of rows."""
    df.write.mode("overwrite").parquet(path)


def pack(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """vectors with the column as bytes: 32-bit floats, little-endian; null stays null."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(column)
            packed = pa.array([None if v is None else np.asarray(v, dtype="<f4").tobytes() for v in batch.column(at).to_pylist()], pa.binary())
            yield batch.set_column(at, column, packed)

    return vectors.mapInArrow(run, ", ".join(f"`{c}` {'binary' if c == column else t}" for c, t in vectors.dtypes))


def unpack(packed: DataFrame, column: str = "vector") -> DataFrame:

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(column)
            values = pa.array([None if v is None else np.frombuffer(v, dtype="<f4") for v in batch.column(at).to_pylist()], pa.list_(pa.float32()))
            yield batch.set_column(at, column, values)

    return packed.mapInArrow(run, ", ".join(f"`{c}` {'array<float>' if c == column else t}" for c, t in packed.dtypes))


# --- tables that explain -----------------------------------------------------


def relations(spark: SparkSession) -> DataFrame:
    """Relations between items: whether they hold both ways, and whether their items may share a code."""
    rows = [("IDENTICAL", True, True), ("EQUIVALENT", True, True), ("SUBSTITUTABLE", False, False), ("VARIANT_OF", True, False), ("DISTINCT", True, False)]
    return spark.createDataFrame(rows, "relation string, both_ways boolean, one_code boolean")


def code_parts(spark: SparkSession) -> DataFrame:
    """Parts of a code, for the first serial of class 5306."""
    one = spark.range(1).select(codes.mint(F.lit(codes.FIRST_SERIAL), F.lit("5306")).alias("c"))
    digits = F.regexp_replace("c", "[^0-9]", "")
    parts = F.array(*[F.struct(F.lit(n).alias("part"), F.substring(digits, a, k).alias("example"), F.lit(fixed).alias("permanent")) for n, a, k, fixed in (("class", 1, 4, False), ("country", 5, 2, True), ("serial", 7, 7, True), ("check", 14, 1, True))])
    return one.select(F.inline(parts))


def system_tables(spark: SparkSession) -> DataFrame:
    """How much fixed knowledge there is, by kind."""
    rows = [("classes", len(K.CLASSES)), ("attributes", sum(len(c.attributes) for c in K.CLASSES.values())), ("units", len(K.UNITS)), ("packs", len(K.PACKS)), ("shorthand", len(K.SHORTHAND))]
    return spark.createDataFrame(rows, "what string, n int").unionByName(kg.stats(spark).select("what", "n"))
