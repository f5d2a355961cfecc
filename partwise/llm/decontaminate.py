"""Operator 3, benchmark decontamination by winnowing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.llm.shared import Words, buffers, keep_rows, materialise, table, trimmed, typed, word_chunks

OUT = "doc_id long, mark long, n_words long, items array<string>, starts array<long>, ends array<long>"


def winnow(words: Words, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Selected word positions, and the hashes of k words from there.

    Of every n - k + 1 consecutive k-grams of one text the smallest is
    selected, the last of equal ones. Two texts that share n consecutive words
    select the same k-gram inside them.
    """
    grams, _ = words.grams(k)
    _, whole = words.grams(n)
    at = np.flatnonzero(whole)
    if not len(at):
        return at, grams[:0]
    best, pos = grams[at], at
    for j in range(1, n - k + 1):
        later = grams[at + j]
        take = later <= best
        best = np.where(take, later, best)
        pos = np.where(take, at + j, pos)
    pos = np.unique(pos)
    return pos, grams[pos]


#: Size of the bitmaps that are asked first.
BITS = 1 << 22


class Keys:
    """A set of 64-bit keys: a bitmap, and a sorted array unless the bitmap may answer alone."""

    def __init__(self, keys: np.ndarray, exact: bool = True):
        self.keys = np.unique(keys) if exact else None
        self.bits = np.zeros(BITS, dtype=bool)
        self.bits[(keys & np.uint64(BITS - 1)).astype(np.int64)] = True

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = self.bits[(keys & np.uint64(BITS - 1)).astype(np.int64)]
        if self.keys is not None and out.any():
            near = np.flatnonzero(out)
            at = np.searchsorted(self.keys, keys[near])
            out[near] = self.keys[np.minimum(at, len(self.keys) - 1)] == keys[near]
        return out


class Lookup(Keys):
    """The values of 64-bit keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        super().__init__(keys)
        pairs = np.unique(np.stack([keys, values.astype(np.uint64)], axis=1), axis=0)
        self.all, self.values = np.ascontiguousarray(pairs[:, 0]), pairs[:, 1].astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into keys, value) of every match."""
        lo, hi = np.searchsorted(self.all, keys, "left"), np.searchsorted(self.all, keys, "right")
        n = hi - lo
        first = np.repeat(lo - (np.cumsum(n) - n), n)
        return np.repeat(np.arange(len(keys)), n), self.values[first + np.arange(n.sum())]


class Fingerprints:
    """Winnowed fingerprints and windows of benchmark items."""

    def __init__(self, items: list[tuple[str | None, str]], n: int, k: int):
        self.ids, self.n, self.k = [i for i, _ in items], n, k
        data, offsets = buffers(pa.array([t for _, t in items], pa.large_string()))
        words = Words(data, offsets, 0)
        self.keys = Keys(winnow(words, k, n)[1])
        self.windows: dict[int, Lookup] = {}
        for length, (at, grams) in windows(words, n).items():
            self.windows[length] = Lookup(grams, words.text_of()[at])

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the places of words' texts where a window of an item occurs; and pairs of text and item, each once."""
        starts, ends, named = [], [], [np.zeros((0, 2), np.int64)]
        for length, lookup in self.windows.items():
            at, grams = candidates(words, length, self.n, self.k, self.keys)
            found = np.flatnonzero(lookup.holds(grams))
            starts.append(at[found])
            ends.append(at[found] + length)
            # One text and one window count once, however often they meet.
            text = np.searchsorted(words.bounds, at[found], "right") - 1
            key = np.unique(np.stack([text.astype(np.uint64), grams[found]], axis=1), axis=0)
            row, item = lookup.find(np.ascontiguousarray(key[:, 1]))
            named.append(np.unique(np.stack([key[row, 0].astype(np.int64), item], axis=1), axis=0))
        named = np.unique(np.concatenate(named), axis=0)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *starts]), np.concatenate([none, *ends]), named[:, 0], named[:, 1]


def windows(words: Words, n: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: positions and hashes of the windows of words' texts: n words each, or a whole shorter text."""
    out = {}
    for length in sorted({min(n, int(c)) for c in words.counts if c}):
        grams, within = words.grams(length)
        at = np.flatnonzero(within) if length == n else words.bounds[:-1][words.counts == length]
        out[length] = (at, grams[at])
    return out


def candidates(words: Words, length: int, n: int, k: int, keys: Keys) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of length words that may be a window: of n words, only those around a fingerprint that keys has."""
    grams, within = words.grams(length)
    if length < n:
        at = np.flatnonzero(within)
    else:
        pos, own = winnow(words, k, n)
        pos = pos[keys.holds(own)]
        at = np.unique((pos[:, None] - np.arange(n - k + 1)[None, :]).ravel())
        at = at[(at >= 0) & (at < len(within))]
        at = at[within[at]]
    return at, grams[at]


def scan(index: Fingerprints):
    """mapInArrow function over (doc_id, text, mark)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, runs, names = np.zeros(batch.num_rows, np.int64), {}, {}
            for words in word_chunks(batch.column(1)):
                n_words[words.first : words.first + words.n] = words.counts
                start, end, text, item = index.hits(words)
                for t, i in zip(text.tolist(), item.tolist(), strict=True):
                    names.setdefault(words.first + t, set()).add(index.ids[i])
                text = np.searchsorted(words.bounds, start, "right") - 1
                order = np.lexsort((start, text))
                for one in np.split(order, np.flatnonzero(np.diff(text[order])) + 1) if len(order) else []:
                    t = int(text[one[0]])
                    s, e = start[one], np.maximum.accumulate(end[one])
                    new = np.concatenate([[True], s[1:] > e[:-1]])
                    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])
                    runs[words.first + t] = ((s[new] - words.bounds[t]).tolist(), (e[last] - words.bounds[t]).tolist())
            rows = range(batch.num_rows)
            items = [sorted(names.get(i, ()), key=lambda x: (x is None, x or "")) for i in rows]
            columns = [batch.column(0), batch.column(2), pa.array(n_words), pa.array(items, pa.list_(pa.string()))]
            columns += [pa.array([runs.get(i, ([], []))[j] for i in rows], pa.list_(pa.int64())) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "n_words", "items", "starts", "ends"])

    return run


def item_windows(items: DataFrame, n: int, k: int) -> DataFrame:
    """length, hash, item_id and mark (a fingerprint, 0 for a short item) of the windows of items (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_chunks(batch.column(1)):
                ids = batch.column(0).slice(words.first, words.n)
                for length, (at, grams) in windows(words, n).items():
                    pos, keys = winnow(words, k, n) if length == n else (at, np.zeros(len(at), np.uint64))
                    text = np.searchsorted(words.bounds, np.concatenate([at, pos]), "right") - 1
                    # The windows (fingerprint 0), and the fingerprints (window 0).
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(text), length, np.int32)),
                            pa.array(np.concatenate([grams, np.zeros(len(pos), np.uint64)]).view(np.int64)),
                            ids.take(pa.array(text)),
                            pa.array(np.concatenate([np.zeros(len(at), np.uint64), keys]).view(np.int64)),
                        ],
                        names=["length", "hash", "item_id", "mark"],
                    )

    return items.mapInArrow(trimmed(run), "length int, hash long, item_id string, mark long")


def doc_windows(docs: DataFrame, lengths: list[int], keys: Keys, n: int, k: int) -> DataFrame:
    """doc_id, mark, start, length and hash of the places of docs (doc_id, text, mark) that may be a window; and per row one of length 0 whose start is the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_chunks(batch.column(1)):
                rows, starts, sizes, hashes = [np.arange(words.n)], [words.counts], [np.zeros(words.n, np.int32)], [np.zeros(words.n, np.uint64)]
                for length in lengths:
                    at, grams = candidates(words, length, n, k, keys)
                    text = np.searchsorted(words.bounds, at, "right") - 1
                    rows.append(text)
                    starts.append(at - words.bounds[text])
                    sizes.append(np.full(len(at), length, np.int32))
                    hashes.append(grams)
                take = pa.array(np.concatenate(rows) + words.first)
                columns = [pa.array(np.concatenate(starts)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(hashes).view(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), *columns], names=["doc_id", "mark", "start", "length", "hash"])

    return docs.mapInArrow(trimmed(run), "doc_id long, mark long, start long, length int, hash long")


def joined(docs: DataFrame, items: DataFrame, n: int, k: int) -> DataFrame:
    """What scan finds, by a shuffle join of windows: for items of any size. Fingerprints reach docs as a bitmap of fixed size."""
    found = materialise(item_windows(items, n, k))
    bits = found.where("mark <> 0").select(F.col("mark").bitwiseAND(F.lit(BITS - 1)).alias("bit")).distinct().collect()
    lengths = sorted(r.length for r in found.select("length").distinct().collect())
    keys = Keys(np.array([r.bit for r in bits], dtype=np.uint64), exact=False)
    spots = materialise(doc_windows(docs, lengths, keys, n, k))
    named = found.where("hash <> 0").select("length", "hash", "item_id").distinct()
    met = materialise(spots.where("length > 0").join(named, ["length", "hash"]).select("doc_id", "mark", "start", "length", "item_id"))
    runs = met.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("runs"))
    # The last run is kept apart while it grows, so that each place is looked at once.
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    begin = F.struct(empty.alias("done"), F.get("runs", 0).alias("now"))

    def grow(acc: Column, r: Column) -> Column:
        new = F.struct(acc["now"]["start"].alias("start"), F.greatest(acc["now"]["end"], r["end"]).alias("end"))
        return F.when(r["start"] <= acc["now"]["end"], F.struct(acc["done"].alias("done"), new.alias("now"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), r.alias("now")))

    runs = runs.select("doc_id", "mark", F.aggregate("runs", begin, grow, lambda a: F.concat(a["done"], F.array(a["now"]))).alias("runs"))
    ids = met.select("doc_id", "mark", "item_id").distinct().groupBy("doc_id", "mark").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("item_id")).alias("items"))
    null = F.lit(None).cast("array<string>")
    ids = ids.select("doc_id", "mark", F.when(F.col("n") > F.size("items"), F.concat("items", F.array(F.lit(None).cast("string")))).otherwise(F.coalesce("items", null)).alias("items"))
    side = lambda df, c: df.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), *c)
    on = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))
    rows = spots.where("length = 0").select("doc_id", "mark", F.col("start").alias("n_words"))
    rows = rows.join(side(runs, ["runs"]), on, "left").drop("d", "m").join(side(ids, ["items"]), on, "left").drop("d", "m")
    return rows.select(
        "doc_id",
        "mark",
        "n_words",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col("runs.start"), F.array().cast("array<bigint>")).alias("starts"),
        F.coalesce(F.col("runs.end"), F.array().cast("array<bigint>")).alias("ends"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, k: int = 5, block_bytes: int = 16 << 20) -> DataFrame:
    """Words of docs (doc_id, text) that stand in an occurrence of a window of n consecutive words of items (item_id, text).

    An item of fewer words, but not none, is one window. Returns one row per
    row of docs: doc_id, mark (a hash of the text), n_words, n_hit, n_items,
    items_sha256, contaminated, items, and starts and ends of the hit runs of
    words.

    Both sides are winnowed. A fingerprint of a text that the items have too is
    extended: the windows around it are looked up among the items' windows, so
    a text of one word a thousand times costs no more than another. Items of up
    to block_bytes are fingerprinted on the driver and sent to the executors:
    docs are read once and not shuffled. Larger ones are joined by shuffles.

    Null texts have no words. Items of null text are left out; items of a null
    id count as one without a name; repeated rows of items count once. Rows
    that repeat a doc_id are judged each by its own text. Without items nothing
    is hit; without docs there are no rows.
    """
    items = typed(items, item_id="string", text="string").where("text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item_id"), F.lit(0)) + 64)).first()[0] or 0
    docs = typed(docs, doc_id="long", text="string").withColumn("mark", F.xxhash64("text"))
    if size <= block_bytes:
        rows = sorted(((r.item_id, r.text) for r in items.collect()), key=lambda r: (r[0] or "", r[1]))
        found = docs.mapInArrow(trimmed(scan(Fingerprints(rows, n, k))), OUT)
    else:
        found = joined(docs, items, n, k)
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id",
        "mark",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
        "items",
        "starts",
        "ends",
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs without a hit, with all their columns; each row is judged by its own text."""
    return keep_rows(docs, decontaminate(docs, items).select("doc_id", "mark", (~F.col("contaminated")).alias("kept")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("mark", "items", "starts", "ends")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
         FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN wins USING (n, g)),
spots AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN named USING (doc_id)
"""
