"""Operator 6, exact dedup: tree-merge of sorted digest runs, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.llm.shared import keep_rows, materialise, partitions, table, typed

KEY = ["digest", "n_bytes", "check"]


def exact_dedup(docs: DataFrame, fan_in: int = 4, rounds: int = 3) -> DataFrame:
    """Decide for every row of docs (doc_id, text) which row of its equal texts stays.

    Digests are dealt into parts by their value, and rows into fan_in^rounds
    runs by a hash of doc_id. A run of one part lies in one partition, sorted by
    digest; in each round fan_in runs of a part meet in a partition, are merged
    in that order, and become one, whose entry of a digest has the largest
    doc_id met so far and the number of rows. Entries merge only if SHA-256,
    length in bytes and an independent 64-bit hash all agree. The winners then
    go back down the same tree: an entry is looked up by at most fan_in others,
    and a text that holds a third of all rows is summed before it is dealt and
    spread over all runs of its part, so no key gathers its rows.

    One row per row of docs: doc_id, mark (xxhash64 of the text), keep_id,
    group_size, kept, text_sha256. Null texts count as empty; empty texts equal
    each other. Rows that repeat doc_id and text are rows of their own: all are
    returned, and exactly one row of a group has kept = true. A null doc_id is
    smaller than any other. An empty table gives no rows; columns besides these
    two are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    parts = partitions(docs.sparkSession)
    rows = materialise(
        typed(docs, doc_id="long", text="string").select(
            "doc_id",
            F.xxhash64("text").alias("mark"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.octet_length(text).cast("long").alias("n_bytes"),
            F.xxhash64(text).alias("check"),
            F.monotonically_increasing_id().alias("row"),
            F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("run")), F.lit(fan_in**rounds)).alias("run"),
        )
    ).withColumn("part", F.pmod("check", F.lit(parts)))

    def merged(entries: DataFrame) -> DataFrame:
        # Rows of a part and run are in one partition and in order, so the aggregate neither deals nor sorts them again.
        runs = entries.repartition("part", "run").sortWithinPartitions("part", "run", *KEY)
        return materialise(runs.groupBy("part", "run", *KEY).agg(F.max("best").alias("best"), F.sum("size").alias("size")))

    # Rows of one text and run are summed before any are dealt.
    own = rows.groupBy("part", "run", *KEY).agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("size"))
    levels = [merged(own)]
    for _ in range(rounds):
        levels.append(merged(levels[-1].withColumn("run", F.floor(F.col("run") / fan_in))))

    # Down again, for texts of more than one row only.
    winners = levels[-1].where("size > 1")
    for level in reversed(levels[:-1]):
        above = winners.select("part", *KEY, F.col("run").alias("up"), F.col("best").alias("winner"), F.col("size").alias("total"))
        below = level.withColumn("up", F.floor(F.col("run") / fan_in))
        winners = below.join(above, ["part", "up", *KEY]).select("part", *KEY, "run", F.col("winner").alias("best"), F.col("total").alias("size"))
    decided = rows.join(winners, ["part", "run", *KEY], "left")
    return decided.select(
        "doc_id",
        "mark",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_exact(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns; of rows that repeat doc_id and text one stays."""
    return keep_rows(docs, exact_dedup(docs), once=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("mark")


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
