"""Helpers of the operators: inputs, vectorised words, groups.

Tables that cut lineage are written as Parquet below the folder named in
``spark.checkpoint.dir``, so that they survive lost executors.
"""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.operators import graph
from partwise.operators.graph import checkpoint_dir, components

__all__ = ["checkpoint_dir", "components"]

#: Bytes of an Arrow batch that goes to a worker, about.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile sends workers batches of BATCH_BYTES, not of 10,000 texts each, which a task would hold several times over."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, by short batches."""
    with short_batches(df.sparkSession):
        return graph.materialise(df)


def few(df: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it has at most so many rows; a larger one is joined by shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def typed(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast to the named types; columns beside them are left out."""
    return df.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])


def keep_rows(docs: DataFrame, decided: DataFrame, once: bool = False) -> DataFrame:
    """The rows of docs (doc_id, text, ...), all columns, that decided (doc_id, mark = xxhash64 of the text, kept) keeps.

    decided has as many rows of each doc_id and mark as docs; a row stays if
    any of its doc_id and mark is kept. With once, one of the rows that repeat
    both stays; which of them is not told. Columns of any name may stand beside
    doc_id and text.
    """
    told = decided.groupBy("doc_id", "mark").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    odd = materialise(told.where("NOT kept OR n > 1" if once else "NOT kept"))
    free = iter(c for c in (f"_key{i}" for i in range(len(docs.columns) + 2)) if c not in {x.lower() for x in docs.columns})
    a, b = next(free), next(free)
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(a)) & (F.xxhash64(F.col("text").cast("string")) == F.col(b))
    keyed = lambda df: few(df.select(F.col("doc_id").alias(a), F.col("mark").alias(b)))
    out = docs.join(keyed(odd), on, "left_anti")
    twice = odd.where("kept")
    if once and twice.limit(1).count():
        out = out.union(docs.join(keyed(twice), on, "left_semi").dropDuplicates(["doc_id", "text"]))
    return out


# --- memory of workers -------------------------------------------------------


@cache
def _trim() -> Callable[[int], int] | None:
    """The C library's malloc_trim, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


def release() -> None:
    """Give memory that is free back to the system: Arrow's and the C library's."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def trimmed(run: Callable, every: float = 0.5) -> Callable:
    """run, a mapInArrow function, that releases free memory at most once in so many seconds, and at its end.

    Spark keeps its workers from task to task and from stage to stage; what one
    of them held at its most would stay beside all that comes later.
    """

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = time.monotonic()
        try:
            for batch in run(batches):
                yield batch
                del batch
                if time.monotonic() - last > every:
                    release()
                    last = time.monotonic()
        finally:
            release()

    return out


# --- words of whole texts, vectorised over UTF-8 bytes -----------------------
#
# A word is a run of 0-9, a-z (after A-Z are lower-cased) and code points from
# U+0080 on; in UTF-8 these are exactly the bytes below and those from 0x80 on.

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = True
WORD[128:] = True

def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values, so that all their bits look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Random values of bytes and of places in a span.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACES: list[np.ndarray] = [np.zeros(0, np.uint64)]


def places(n: int) -> np.ndarray:
    if len(_PLACES[0]) < n:
        _PLACES[0] = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    return _PLACES[0]


BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Spans of more values are hashed by place_hashes.
LONG = 64


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0..n-1, modulo 2^64."""
    if len(_POWERS[0]) < n:
        for k, b in enumerate((BASE, pow(BASE, -1, 2**64))):
            a = np.full(n, b, dtype=np.uint64)
            a[0] = 1
            _POWERS[k] = np.cumprod(a, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def place_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Multilinear hashes: each value times a random weight of its place in the span."""
    n = ends - starts
    first = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(first, n)
    own = values[place + np.repeat(starts, n)]
    own = BYTES[own] if values.dtype == np.uint8 else mix(own + np.uint64(1))
    return np.add.reduceat(own * places(int(n.max()))[place], first)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end] (bytes, or 64-bit values) for each span; spans ascend and don't overlap.

    A polynomial modulo 2^64, from one running sum over all values. Long
    sequences of two values can cancel out in such a polynomial, so spans of
    more than LONG values are hashed by place instead.
    """
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((BYTES[values] if values.dtype == np.uint8 else mix(values + np.uint64(1))) * up[: len(values)], out=total[1:])
    out = (total[ends] - total[starts]) * down[starts]
    long = np.flatnonzero(ends - starts > LONG)
    if len(long):
        out[long] = place_hashes(values, starts[long], ends[long])
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(BASE))


class Words:
    """Words of the texts i0..i1 of a batch: hash of each, and bounds of each text's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, letters: np.ndarray = LOWER):
        self.first, self.n = first, len(offsets) - 1
        self.offsets = offsets - offsets[0]
        self.low = letters[data[offsets[0] : offsets[-1]]]
        is_word = WORD[self.low]
        before = np.zeros(len(is_word) + 1, dtype=bool)
        before[1:] = is_word
        after = before[1:].copy()
        after[:-1] = is_word[1:]
        if len(after):
            after[-1] = False
        edges = self.offsets[(self.offsets > 0) & (self.offsets < len(is_word))]
        before[edges] = False
        after[edges - 1] = False
        self.starts = np.flatnonzero(is_word & ~before[:-1])
        self.ends = np.flatnonzero(is_word & ~after) + 1
        self.hashes = span_hashes(self.low, self.starts, self.ends)
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.bounds)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k words from every word on; and whether these k words are of one text."""
        m = len(self.hashes) - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = np.zeros(m, dtype=np.uint64)
        for j in range(k):
            out = out * np.uint64(0xD6E8FEB86659FD93) + self.hashes[j : j + m]
        within = np.ones(m + k, dtype=bool)
        for j in range(1, k):
            at = self.bounds[1:-1] - j
            within[at[at >= 0]] = False
        # a text shorter than k words can be reached from several edges; all of its starts are cut above
        return mix(out), within[:m]

    def text_of(self) -> np.ndarray:
        """The text, counted in the batch, of each word."""
        return np.repeat(np.arange(self.first, self.first + self.n), self.counts)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, dtype=kind, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size bytes each; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = j


def word_chunks(column: pa.Array) -> Iterator[Words]:
    data, offsets = buffers(column)
    for i, j in chunks(offsets):
        yield Words(data, offsets[i : j + 1], i)


# --- graphs ------------------------------------------------------------------


def star_pairs(keys: DataFrame, check: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Candidate pairs (a, b), a < b, of the items that share a key.

    keys: (key, id, own), longs; check tells from the own of both, in whichever
    order, whether a pair may stay. Within a key no item meets all others: each meets two hubs, the item
    that shares keys with most others, and one drawn by a hash of key and id.
    Both are found by aggregates that combine before the shuffle, so the work
    is linear in the rows whatever a key's share of them is. As each item has
    many keys with hubs of their own, a link that one key's hubs leave out is
    found by another or by way of a hub.
    """
    # Aggregates of plain longs only, so that keys are hashed and not sorted.
    ends = [f(c).alias(f"{n}_{c}") for n, f in (("least", F.min), ("most", F.max)) for c in ("id", "own")]
    sizes = materialise(keys.groupBy("key").agg(F.count("*").alias("size"), *ends).where("size > 1"))
    # A key of two items, the usual case, has its pair at once; check is symmetric, so it does not matter whose own is the least.
    two = sizes.where("size = 2 AND least_id <> most_id")
    if check is not None:
        two = two.where(check(F.col("least_own"), F.col("most_own")))
    two = two.select(F.col("least_id").alias("a"), F.col("most_id").alias("b"))
    shared = materialise(keys.join(sizes.where("size > 2").select("key", "size"), "key"))
    degree = shared.groupBy("id").agg(F.sum("size").alias("degree"))
    ranked = shared.select("key", "id", "own").join(degree, "id")
    hubs = (
        ranked.groupBy("key")
        .agg(
            F.max(F.struct("degree", F.col("id").alias("hub"), "own")).alias("top"),
            F.min(F.struct(F.xxhash64("key", "id").alias("h"), F.col("id").alias("hub"), "own")).alias("drawn"),
        )
        .select("key", F.array(F.struct("top.hub", "top.own"), F.struct("drawn.hub", "drawn.own")).alias("hubs"))
    )
    pairs = shared.join(hubs, "key").select("id", "own", F.explode("hubs").alias("other")).where("id <> other.hub")
    if check is not None:
        pairs = pairs.where(check(F.col("own"), F.col("other.own")))
    return pairs.select(F.least("id", "other.hub").alias("a"), F.greatest("id", "other.hub").alias("b")).union(two).distinct()


def dealt(shared: DataFrame, most: int) -> DataFrame:
    """Rows of shared (key, size, id, ...) with columns i, j and side, dealt into groups (key, i, j) of about 2 * most rows at most.

    A key of more than most rows is dealt into blocks; each block meets itself
    and every other block in groups of their own. side is -1 where all rows of
    the group are to meet, otherwise the block: 0 is to meet 1.
    """
    dealt = shared.withColumn("_blocks", F.ceil(F.col("size") / F.lit(most))).withColumn("_own", F.pmod(F.xxhash64("id"), "_blocks"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    side = F.when(F.col("_own") == F.col("_other"), -1).when(F.col("_own") < F.col("_other"), 0).otherwise(1)
    return dealt.withColumns({"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other"), "side": side}).drop("_blocks", "_own", "_other", "size")


def in_groups(rows: DataFrame, keys: list[str], run: Callable, out: str) -> DataFrame:
    """rows through mapInArrow, those of each value of keys one after the other; see grouped."""
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(trimmed(run), out)


def grouped(batches: Iterator[pa.RecordBatch], keys: int, most: int = 1 << 62) -> Iterator[tuple[pa.RecordBatch, np.ndarray, bool]]:
    """Batches of whole groups, the bounds of the groups in them, and whether they are pieces of one group of more than most rows.

    A group is a run of rows of equal first columns, keys of them, longs.
    """
    held: list[pa.RecordBatch] = []
    waiting, cut = 0, False

    def joined(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        batch = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        return batch, np.concatenate([[0], changes(batch), [batch.num_rows]])

    def changes(batch: pa.RecordBatch) -> np.ndarray:
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        return np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        same = bool(held) and all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in range(keys))
        starts = changes(batch)
        if not same:
            if held:
                yield *joined(held), cut
            held, waiting, cut = [], 0, False
        if len(starts):
            last = int(starts[-1])
            if cut:
                first = int(starts[0])
                yield *joined([*held, batch.slice(0, first)]), True
                held = []
                if last > first:
                    yield *joined([batch.slice(first, last - first)]), False
            else:
                yield *joined([*held, batch.slice(0, last)]), False
            held, waiting, cut = [batch.slice(last)], batch.num_rows - last, False
        else:
            held.append(batch)
            waiting += batch.num_rows
            if waiting > most:
                cut = True
                yield *joined(held), True
                held, waiting = [batch.slice(batch.num_rows - 1)], 1
    if held:
        yield *joined(held), cut


class Forest:
    """Disjoint sets of 0..n-1; items of equal roots begin in one set."""

    def __init__(self, roots: np.ndarray):
        _, first, own = np.unique(roots, return_index=True, return_inverse=True)
        self.up = first[own].tolist()

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.top(x)] = self.top(y)


def across(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """shared with the root of each id; only keys whose ids have different roots."""
    rooted = materialise(shared.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    return rooted.join(rooted.groupBy("key").agg(F.min("root").alias("_l"), F.max("root").alias("_m"), F.count("*").alias("size")).where("_l <> _m").select("key", "size"), "key")
