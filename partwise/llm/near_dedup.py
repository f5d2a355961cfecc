"""Operator 2, MinHash near-dedup by ProbMinHash, banding and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.llm.shared import Forest, Words, across, components, dealt, few, grouped, in_groups, keep_rows, materialise, mix, star_pairs, table, trimmed, typed, word_chunks

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text counted in words, hash, times) of each distinct shingle of k words, by text; a shorter text is one shingle."""
    grams, within = words.grams(k)
    at = np.flatnonzero(within)
    text, value = np.searchsorted(words.bounds, at, "right") - 1, grams[at]
    for n in range(1, k):
        short = np.flatnonzero(words.counts == n)
        if len(short):
            own, _ = words.grams(n)
            text, value = np.concatenate([text, short]), np.concatenate([value, own[words.bounds[short]]])
    _, first, times = np.unique(mix(value + text.astype(np.uint64) * GOLDEN), return_index=True, return_counts=True)
    text, value = text[first], value[first]
    order = np.lexsort((value, text))
    return text[order], value[order], times[order]


def prob_min_hash(text: np.ndarray, value: np.ndarray, times: np.ndarray, n_texts: int, k: int) -> np.ndarray:
    """ProbMinHash signatures, n_texts x k: of each register the shingle that arrives first.

    Shingle d of weight w is a Poisson process of rate w: its arrivals are
    exponential steps and each falls on a random register, both drawn from the
    shingle's hash. Two texts agree in a register with the probability Jaccard
    similarity of their weights. Arrivals are drawn in rounds for all shingles
    at once; a shingle stops when its next arrival is later than every register
    of its text, so a long text ends after about k ln k arrivals.
    """
    best = np.full(n_texts * k, np.inf)
    owner = np.zeros(n_texts * k, dtype=np.uint64)
    arrival, state, rate = np.zeros(len(text)), value.copy(), times.astype(float)
    rounds = 0
    while len(text):
        rounds += 1
        state = state + GOLDEN
        draw = mix(state)
        arrival = arrival - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        at = text * k + (mix(draw ^ GOLDEN) % np.uint64(k)).astype(np.int64)
        np.minimum.at(best, at, arrival)
        won = arrival == best[at]
        owner[at[won]] = value[won]
        if rounds < 4 or rounds % 4 == 0:
            limit = best.reshape(n_texts, k).max(axis=1)
            on = arrival < limit[text]
            text, value, state, rate, arrival = text[on], value[on], state[on], rate[on], arrival[on]
    return owner.reshape(n_texts, k)


def sketches(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """Per row of docs (doc_id, text, mark): doc_id, mark, c1 and c2 (128 bits of its shingles and times; null without words), keys (one per band), signature (a byte of each register)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN)
        for batch in batches:
            for words in word_chunks(batch.column(1)):
                text, value, times = shingles(words, k)
                registers = prob_min_hash(text, value, times, words.n, bands * rows)
                signature = registers.reshape(words.n, bands, rows)
                key = np.zeros((words.n, bands), np.uint64) + salt
                for j in range(rows):
                    key = mix(key * np.uint64(0xD6E8FEB86659FD93) + signature[:, :, j])
                none = words.counts == 0
                own = batch.slice(words.first, words.n)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column(0),
                        own.column(2),
                        *[pa.array(class_ids(text, value, times, words.n, c), mask=none) for c in (0, 1)],
                        pa.ListArray.from_arrays(pa.array(np.arange(words.n + 1, dtype=np.int32) * bands), pa.array(key.view(np.int64).ravel())),
                        pa.array([bytes(x) for x in mix(registers).astype(np.uint8)], pa.binary()),
                    ],
                    names=["doc_id", "mark", "c1", "c2", "keys", "signature"],
                )

    return docs.mapInArrow(trimmed(run), "doc_id long, mark long, c1 long, c2 long, keys array<long>, signature binary")


def class_ids(text: np.ndarray, value: np.ndarray, times: np.ndarray, n_texts: int, salt: int) -> np.ndarray:
    """One hash of all shingles and times of each text."""
    part = np.concatenate([[np.uint64(0)], np.cumsum(mix(mix(value + np.uint64(salt)) * GOLDEN + times.astype(np.uint64)))])
    bounds = np.searchsorted(text, np.arange(n_texts + 1))
    return mix(part[bounds[1:]] - part[bounds[:-1]]).view(np.int64)


def shingle_lists(texts: DataFrame, k: int) -> DataFrame:
    """id, shingles and times of each row of texts (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_chunks(batch.column(1)):
                text, value, times = shingles(words, k)
                bounds = pa.array(np.searchsorted(text, np.arange(words.n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (value.view(np.int64), times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.first, words.n), *lists], names=["id", "shingles", "times"])

    return texts.mapInArrow(trimmed(run), "id long, shingles array<long>, times array<int>")


def similarities(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> tuple[float, float]:
    """Jaccard similarity of the sets x and y (sorted), and probability Jaccard similarity of their weights."""
    both = np.searchsorted(x, y)
    both = np.flatnonzero((both < len(x)) & (x[np.minimum(both, len(x) - 1)] == y)) if len(x) else np.zeros(0, np.int64)
    n = len(both)
    jaccard = n / max(1, len(x) + len(y) - n)
    if (wx == 1).all() and (wy == 1).all():
        return jaccard, jaccard
    at = np.searchsorted(x, y[both])
    a, b = wx[at].astype(float), wy[both].astype(float)
    only_x, only_y = wx.sum() - a.sum(), wy.sum() - b.sum()
    # Sum over d' of max(x_d' / x_d, y_d' / y_d): x_d' is the larger term where x_d' / y_d' >= x_d / y_d.
    ratio = a / b
    order = np.argsort(ratio)
    below = np.searchsorted(ratio[order], ratio, "left")
    from_x = np.concatenate([np.cumsum(a[order][::-1])[::-1], [0.0]])[below] + only_x
    from_y = np.concatenate([[0.0], np.cumsum(b[order])])[below] + only_y
    return jaccard, float((1 / (from_x / a + from_y / b)).sum())


class Lists:
    """Shingles and times of the rows of two list columns."""

    def __init__(self, shingles: pa.Array, times: pa.Array):
        self.bounds = shingles.offsets.to_numpy().tolist()
        self.values, self.times = shingles.values.to_numpy().view(np.uint64), times.values.to_numpy()

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.bounds[i], self.bounds[i + 1])
        return self.values[own], self.times[own]


def verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, and shingles and times of both) with either similarity of threshold or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = Lists(batch.column(2), batch.column(3)), Lists(batch.column(4), batch.column(5))
            mask = pa.array([max(similarities(*x[r], *y[r])) >= threshold for r in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return pairs.mapInArrow(trimmed(run), "a long, b long")


def forest_links(groups: DataFrame, threshold: float, least: float) -> DataFrame:
    """Verified links (a, b) that connect what is similar in each group of groups (key, i, j, side, id, root, signature, shingles, times).

    Candidates are the pairs of a group of which least of the registers agree,
    the most alike first. A pair that links of the group connect already is not
    verified again. 1 - either similarity is a metric (it is the chance that a
    hash differs), so a pair is out unverified if the distances of both to one
    row of the group, the pivot, differ by more than 1 - threshold.
    """

    def links(side: np.ndarray, ids: np.ndarray, roots: np.ndarray, bytes_: np.ndarray, lists: Lists, base: int) -> Iterator[tuple[int, int]]:
        n, need = len(ids), least * bytes_.shape[1]
        found = []
        for x in range(n - 1):
            agree = (bytes_[x + 1 :] == bytes_[x]).sum(axis=1)
            y = np.flatnonzero(agree >= need)
            found.append(np.stack([agree[y], np.full(len(y), x), y + x + 1], axis=1))
        found = np.concatenate([np.zeros((0, 3), np.int64), *found])
        x, y = found[:, 1], found[:, 2]
        found = found[((side[x] < 0) | (side[x] != side[y])) & (roots[x] != roots[y])]
        if not len(found):
            return
        pivot = int(np.bincount(found[:, 1:].ravel(), minlength=n).argmax())
        to_pivot = np.array([similarities(*lists[base + pivot], *lists[base + i]) for i in range(n)]) if len(found) > 2 * n else None
        if to_pivot is not None:
            apart = np.abs(to_pivot[found[:, 1]] - to_pivot[found[:, 2]]).min(axis=1)
            found = found[apart <= 1 - threshold + 1e-9]
        forest = Forest(roots)
        for _, a, b in found[np.argsort(-found[:, 0], kind="stable")].tolist():
            if forest.top(a) != forest.top(b) and max(similarities(*lists[base + a], *lists[base + b])) >= threshold:
                forest.join(a, b)
                yield int(min(ids[a], ids[b])), int(max(ids[a], ids[b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds, _ in grouped(batches, 3):
            side, ids, roots = (batch.column(k).to_numpy() for k in (3, 4, 5))
            bytes_ = np.frombuffer(b"".join(batch.column(6).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
            lists = Lists(batch.column(7), batch.column(8))
            found = [link for s, e in zip(bounds[:-1], bounds[1:], strict=True) for link in links(side[s:e], ids[s:e], roots[s:e], bytes_[s:e], lists, int(s))]
            pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    rows = groups.select("key", "i", "j", "side", "id", "root", "signature", "shingles", "times")
    return in_groups(rows, ["key", "i", "j"], run, "a long, b long").distinct()


def near_dedup(docs: DataFrame, k: int = 5, threshold: float = 0.8, bands: int = 20, rows: int = 4, most: int = 2048, least: float = 0.65) -> DataFrame:
    """Near duplicates of docs (doc_id, text), one row each: doc_id, mark, class_id, class_size, cluster_id, kept.

    Shingles are k lower-case words, weighted by how often they occur; a text
    of fewer words is one shingle. Texts with equal shingles and weights are one
    class (class_id: its smallest doc_id). Classes that share a band of their
    ProbMinHash signatures are candidates; a pair is linked if the Jaccard
    similarity of its shingles, or the probability Jaccard similarity of their
    weights, both computed exactly, is threshold or more. cluster_id is the
    smallest doc_id of the connected classes, and one row of that doc_id is kept.

    With 20 bands of 4, a pair of similarity 0.8 shares no band with
    probability 0.00003, and agrees in fewer than least of the 80 registers
    with 0.0003. All classes of a band key meet, in one group as far as there
    are at most most of them; those of larger keys meet two hubs first, and
    then, block by block, all that are still in other clusters. Classes that
    verified links connect already are not compared again, so no cluster
    depends on hubs or on a key's size. A class is counted once however many
    rows it has.

    Texts without words, null included, are clusters of their own. Rows that
    repeat a doc_id are judged by their own texts (mark, a hash of the text,
    tells them apart); of rows that repeat both one is kept. A null doc_id
    counts as larger than any other. An empty table gives no rows.
    """
    docs = typed(docs, doc_id="long", text="string").withColumn("mark", F.xxhash64("text"))
    rows_of = materialise(sketches(docs, k, bands, rows).withColumn("row", F.monotonically_increasing_id()))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "row")
    classes = materialise(rows_of.where("c1 IS NOT NULL").groupBy("c1", "c2").agg(F.min(order).alias("best"), F.count("*").alias("class_size")))
    ids = classes.select(F.col("best.row").alias("row"))
    stands = rows_of.join(few(ids), "row", "left_semi").withColumnRenamed("row", "id")
    keys = stands.select(F.explode(F.array_distinct("keys")).alias("key"), "id")
    sizes = materialise(keys.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("a"), F.max("id").alias("b")).where("size > 1"))
    shared = materialise(keys.join(sizes.where("size > 2").select("key", "size"), "key"))
    two = sizes.where("size = 2").select("a", "b")
    large = shared.where(F.col("size") > most)
    hot = large.limit(1).count() > 0
    pairs = materialise((two.union(star_pairs(large.select("key", "id", F.lit(None).cast("long").alias("own")))) if hot else two).distinct())

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(shared.select("id")).distinct()
    wanted = materialise(stands.join(wanted, "id", "left_semi").select("id", F.col("doc_id").alias("_doc_id"), F.col("mark").alias("_mark"), "signature"))
    texts = docs.join(few(wanted.drop("signature")), F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("mark") == F.col("_mark"))).select("id", "text")
    lists = materialise(shingle_lists(texts, k).dropDuplicates(["id"]))
    side = lambda c, n: lists.select(F.col("id").alias(c), F.col("shingles").alias(f"s{n}"), F.col("times").alias(f"t{n}"))
    both = pairs.join(side("a", 1), "a").join(side("b", 2), "b").select("a", "b", "s1", "t1", "s2", "t2")
    payload = lists.join(wanted.select("id", "signature"), "id")

    one = F.lit(0).cast("long")
    small = shared.where(F.col("size") <= most).select("key", "id", one.alias("i"), one.alias("j"), F.lit(-1).alias("side"), F.col("id").alias("root"))
    links = materialise(verified(both, threshold).union(forest_links(small.join(payload, "id"), threshold, least)).distinct())
    if hot:
        apart = across(large.drop("size"), components(links))
        links = materialise(links.union(forest_links(dealt(apart, most).join(payload, "id"), threshold, least)).distinct())

    known = classes.select("c1", "c2", "best", "class_size", F.col("best.row").alias("id")).join(components(links), "id", "left").withColumn("root", F.coalesce("root", "id"))
    clusters = known.groupBy("root").agg(F.min("best").alias("kept"))
    known = materialise(known.join(clusters, "root").select("c1", "c2", F.col("best.doc_id").alias("class_id"), "class_size", "kept"))
    out = rows_of.select("doc_id", "mark", "row", "c1", "c2").join(known, ["c1", "c2"], "left")
    own = F.col("kept").isNull()
    return out.select(
        "doc_id",
        "mark",
        F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.when(own, F.col("doc_id")).otherwise(F.col("kept.doc_id")).alias("cluster_id"),
        (own | (F.col("row") == F.col("kept.row"))).alias("kept"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that near_dedup keeps, with all their columns; of rows that repeat doc_id and text one stays."""
    return keep_rows(docs, near_dedup(docs), once=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).drop("mark")
