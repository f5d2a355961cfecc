"""The same operators over streams: duplicate checks as items are created, and the ledger's state as events arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from partwise.operators import blocking as B
from partwise.operators import extract as E
from partwise.operators import service as S
from partwise.operators.graph import materialise


def canonical_stream(items: DataFrame) -> DataFrame:
    """Canonical records with keys, row by row; no state."""
    return B.with_keys(E.canonicalise(items))


def check_stream(items: DataFrame, registry: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Check each micro-batch of new items against the registry and append the matches; a batch that is run again overwrites its own files."""
    def each(batch: DataFrame, number: int) -> None:
        asked = materialise(B.with_keys(materialise(E.canonicalise(batch))))
        S.duplicate_check(asked, registry).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return items.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def membership_stream(events: DataFrame) -> DataFrame:
    """(nmc, member, seq, active) after each micro-batch, for members whose state changed.

    events: (seq, event_type MERGED or SPLIT, nmc, member). State per (nmc,
    member) is its last seq and kind, so late and repeated events change nothing.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, active = state.get if state.exists else (-1, False)
        before = active
        for pdf in batches:
            for s, kind in zip(pdf.seq, pdf.event_type, strict=True):
                if s > seq:
                    seq, active = int(s), kind == "MERGED"
        state.update((seq, active))
        if active != before:
            yield pd.DataFrame({"nmc": [key[0]], "member": [key[1]], "seq": [seq], "active": [active]})

    return events.groupBy("nmc", "member").applyInPandasWithState(fold, "nmc string, member long, seq long, active boolean", "seq long, active boolean", "update", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by kind and time window; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))


def replay_as_stream(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, some files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
