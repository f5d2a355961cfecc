"""Candidate pairs: keys of records, self-joins over blocks, and vectors."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.functions import codes
from partwise.functions import knowledge as K
from partwise.functions import text as X

from partwise.operators.graph import materialise, per_value

STRUCTURAL = ["mpn", "vmn", "attr", "blk", "dim", "std"]
PRIMARY = ["thread", "nominal_size", "bore_mm", "designation", "csa_sqmm"]
CUTOFF = 0.42


def letters(c: Column) -> Column:
    return F.regexp_replace(X.basic(c), "[^A-Z0-9]", "")


def identity_keys() -> Column:
    """Keys that a maker's or a vendor's number gives."""
    maker, part, vendor, number = (letters(F.col(c)) for c in ("mfr_name", "mfr_part_no", "vendor_id", "vendor_matl_no"))
    by_part = F.when(F.length(part) >= 4, F.concat(F.lit("mpn:"), F.when(maker == "", "*").otherwise(maker), F.lit("|"), part))
    by_vendor = F.when((vendor != "") & (F.length(number) >= 3), F.concat(F.lit("vmn:"), vendor, F.lit("|"), number))
    return F.array_compact(F.array(by_part, by_vendor))


def value_of(key: str) -> Column:
    return F.try_element_at("attributes", F.lit(key))["value"]


def attribute_keys() -> Column:
    """Keys of the primary dimension with and without the material, of the standard, and of all blocking attributes."""
    first = letters(F.coalesce(*[value_of(k) for k in PRIMARY], F.lit("")))
    some, code = F.coalesce(*[value_of(k) for k in PRIMARY]).isNotNull(), F.col("class_code")
    material = letters(F.coalesce(value_of("material"), value_of("insulation"), F.lit("")))
    combo = F.lit("")
    for c in K.CLASSES.values():
        combo = F.when(code == c.code, F.concat_ws("|", *[F.when(value_of(k).isNotNull(), letters(value_of(k))) for k in c.keys("B")])).otherwise(combo)
    return F.array_compact(
        F.array(
            F.when(some, F.concat_ws("|", F.concat(F.lit("attr:"), code), first, material)),
            F.when(some, F.concat_ws("|", F.concat(F.lit("dim:"), code), first)),
            F.when(some & value_of("standard").isNotNull(), F.concat_ws("|", F.concat(F.lit("std:"), letters(value_of("standard"))), first)),
            F.when(F.length(combo) >= 4, F.concat_ws("|", F.concat(F.lit("blk:"), code), combo)),
        )
    )


def token_keys(most: int = 3) -> Column:
    """The longest tokens, then alphabetically, that have a digit or five letters."""
    words = F.array_distinct(F.filter(X.content_tokens(F.col("own_clean")), lambda t: t.rlike("[0-9]") | (F.length(t) >= 5)))
    order = F.array_sort(F.transform(words, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    keys = F.transform(F.slice(order, 1, most), lambda s: letters(s["t"]))
    return F.transform(F.filter(keys, lambda k: F.length(k) >= 3), lambda k: F.concat(F.lit("tok:"), k))


def with_text_keys(texts: DataFrame) -> DataFrame:
    """Texts that were read, with the keys that they give."""
    return texts.withColumn("text_keys", F.concat(attribute_keys(), token_keys()))


def with_keys(records: DataFrame) -> DataFrame:
    """Canonical records with identity and keys (identity, attribute and token keys, each once)."""
    step = records.withColumn("identity", identity_keys())
    told = F.col("text_keys") if "text_keys" in records.columns else F.concat(attribute_keys(), token_keys())
    return step.withColumn("keys", F.array_distinct(F.concat("identity", told))).drop("text_keys")


def hashed_keys(salt: str) -> Column:
    return F.transform("keys", lambda k: F.substring(F.sha2(F.concat(F.lit(f"{salt}|"), k), 256), 1, 24))


def key_pairs(records: DataFrame, most: int | None = 400, across: bool = True) -> DataFrame:
    """Pairs (a_id < b_id) of records (id, cpse_code, keys) that share a key, with the kinds of keys they share.

    A key of more than `most` records tells nothing and is left out before the
    join, which bounds the pairs of each key (None: no bound); across: only
    pairs of different organisations.
    """
    keyed = records.select("id", F.col("cpse_code").alias("org"), F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= 2 if most is None else F.col("n").between(2, most)).select("key")
    kept = keyed.join(sizes, "key", "left_semi")
    a, b = kept.select("key", F.col("id").alias("a_id"), F.col("org").alias("oa")), kept.select("key", F.col("id").alias("b_id"), F.col("org").alias("ob"))
    met = a.join(b, "key").where((F.col("a_id") < F.col("b_id")) & ((F.col("oa") != F.col("ob")) if across else F.lit(True)))
    return met.groupBy("a_id", "b_id").agg(F.array_sort(F.collect_set(F.substring_index("key", ":", 1))).alias("strategies"))


def candidates(records: DataFrame, vectors: DataFrame | None = None, top_k: int = 50, most: int = 400) -> DataFrame:
    """key_pairs, joined by the pairs that are near as vectors (kind ann)."""
    pairs = key_pairs(records, most)
    if vectors is None:
        return pairs
    near = nearest(vectors, top_k + 1).where(F.col("cosine") >= CUTOFF)
    near = near.select(F.least("id", "other").alias("a_id"), F.greatest("id", "other").alias("b_id")).distinct().withColumn("strategies", F.array(F.lit("ann")))
    return pairs.unionByName(near).groupBy("a_id", "b_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("strategies")))).alias("strategies"))


def strategy_mix(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode("strategies").alias("strategy")).groupBy("strategy").agg(F.count("*").alias("pairs"))


def recall(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of truth (a_id, b_id) that pairs hold."""
    hit = truth.join(pairs.select("a_id", "b_id").withColumn("hit", F.lit(1)), ["a_id", "b_id"], "left")
    return hit.agg(F.count("*").alias("truth"), F.count("hit").alias("found"), F.round(F.try_divide(F.count("hit"), F.count("*")), 6).alias("recall"))


def survivors(pairs: DataFrame, records: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Pairs (with cosine) that share a structural key or an identity key, or are near enough."""
    side = lambda c: records.select(F.col("id").alias(f"{c}_id"), F.col("identity").alias(f"identity_{c}"))
    met = pairs.join(side("a"), "a_id").join(side("b"), "b_id")
    keep = F.arrays_overlap("strategies", X.strings(STRUCTURAL)) | F.arrays_overlap("identity_a", "identity_b") | (F.col("cosine") >= cutoff)
    return met.where(keep).drop("identity_a", "identity_b")


# --- vectors -----------------------------------------------------------------


def features(normal: Column) -> Column:
    """Words, pairs of neighbouring words, and 3- and 4-grams of a normalised text, repeats kept."""
    words = X.tokens(normal)
    n = F.size(words)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.lit("b:"), F.element_at(words, i), F.lit("_"), F.element_at(words, F.least(i + 1, n))))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.transform(words, lambda w: F.concat(F.lit("w:"), w)), pairs, F.transform(X.char_ngrams(normal, 3, 4), lambda g: F.concat(F.lit("c:"), g)))


def document_frequency(records: DataFrame) -> DataFrame:
    """feature, df and idf = ln((n + 1) / (df + 0.5)) + 1 over all records (normal)."""
    texts = materialise(records.groupBy("normal").agg(F.count("*").alias("n")))
    n = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    df = texts.select("n", F.explode(F.array_distinct(features(F.col("normal")))).alias("feature")).groupBy("feature").agg(F.sum("n").alias("df"))
    return df.withColumn("idf", F.log((F.lit(float(max(n, 1))) + 1) / (F.col("df") + 0.5)) + 1)


def embed(records: DataFrame, dim: int = 256, idf: DataFrame | None = None) -> DataFrame:
    """id, org and a vector of unit length: signed sums of feature weights by a hash of the feature.

    With idf, weights come from it by a join on the feature; without it a word
    weighs 1.6 and anything else 0.6. Each different text is made once, and
    without idf its features stay in one partition.
    """
    usual = F.when(F.startswith("feature", F.lit("w:")), 1.6).otherwise(0.6)

    def vectors(texts: DataFrame) -> DataFrame:
        numbered = materialise(texts.withColumn("t", F.monotonically_increasing_id()))
        parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), texts.sparkSession.sparkContext.defaultParallelism)
        each = numbered.repartition(parts, "t").select("t", F.explode(features(F.col("normal"))).alias("feature")).groupBy("t", "feature").agg(F.count("*").alias("n"))
        if idf is not None:
            each = each.join(idf.select("feature", "idf"), "feature", "left").withColumn("weight", F.coalesce("idf", usual))
        else:
            each = each.withColumn("weight", usual)
        code = F.conv(F.substring(F.md5("feature"), 1, 8), 16, 10).cast("long")
        sign = F.when(F.substring(F.md5(F.concat(F.lit("sign|"), "feature")), 1, 1).rlike("[02468ace]"), 1.0).otherwise(-1.0)
        sums = each.groupBy("t", F.pmod(code, F.lit(dim)).cast("int").alias("bucket")).agg(F.sum(sign * F.col("weight") * F.col("n")).alias("v"))
        dense = sums.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
        values = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_divide(F.try_element_at("m", i), F.col("size")), F.lit(0.0)).cast("float"))
        return numbered.join(dense.select("t", values.alias("vector")), "t").select("normal", "vector")

    return per_value(records.select("id", F.col("cpse_code").alias("org"), "normal"), ["normal"], vectors).select("id", "org", "vector")


def _matrix(lists: pa.Array, rows: int) -> np.ndarray:
    """Rows of unit length; those without a length stay 0."""
    m = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1) if rows else np.zeros((0, 1))
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _top(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the k largest finite values of each row, ties to the smaller column; only those that are no less than the k-th are sorted."""
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None] if k < s.shape[1] else -np.inf
    row, column = np.nonzero((s >= least) & np.isfinite(s))
    value = s[row, column]
    order = np.lexsort((column, -value, row))
    row, column, value = row[order], column[order], value[order]
    start = np.searchsorted(row, np.arange(len(s)))
    kept = np.arange(len(row)) - start[row] < k
    return row[kept], column[kept], value[kept]


def _best(dealt: DataFrame, k: int, across: bool) -> DataFrame:
    """Top k by cosine of each query among the vectors that share a block with it; dealt: block, other, query, id, org, vector."""

    def run(table: pa.Table) -> pa.Table:
        mask = table.column("query").to_numpy()

        def side(rows: np.ndarray) -> tuple:
            part = table.filter(pa.array(rows))
            return part.column("id").to_numpy(), np.array(part.column("org").to_pylist(), dtype=object), _matrix(part.column("vector").combine_chunks(), part.num_rows)

        qi, qo, qm = side(mask)
        vi, vo, vm = side(~mask)
        ids, others, scores = [], [], []
        if len(qi) and len(vi):
            order = np.argsort(vi)
            vi, vo, vm = vi[order], vo[order], vm[order]
            for at in range(0, len(qi), 512):
                part = slice(at, at + 512)
                s = np.round(qm[part] @ vm.T, 12)
                s[qi[part][:, None] == vi[None, :]] = -np.inf
                if across:
                    s[qo[part][:, None] == vo[None, :]] = -np.inf
                row, best, values = _top(s, k)
                ids.append(qi[part][row])
                others.append(vi[best])
                scores.append(values)
        cat = lambda xs, t: pa.array(np.concatenate(xs) if xs else np.zeros(0), t)
        return pa.table({"id": cat(ids, pa.int64()), "other": cat(others, pa.int64()), "cosine": cat(scores, pa.float64())})

    local = dealt.select("block", "other", "query", "id", "org", "vector").groupBy("block", "other").applyInArrow(run, "id long, other long, cosine double")
    best = local.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("c"), F.col("other")))), 1, k).alias("best"))
    return best.select("id", F.explode("best").alias("b")).select("id", F.col("b.other").alias("other"), (-F.col("b.c")).alias("cosine"))


def nearest(vectors: DataFrame, k: int, queries: DataFrame | None = None, blocks: int | None = None, across: bool = True, most: int = 20_000) -> DataFrame:
    """Exact top k by cosine of each query among all vectors (id, org, vector): id, other, cosine.

    Queries and vectors are dealt into blocks, of about most rows unless their
    number is given; each pair of blocks is one matrix product in one task, of
    which a query keeps its k best, and the bests of all blocks are merged. Ties
    go to the smaller id. The work is that of all queries with all vectors; for
    a large registry use nearest_in_cells.
    """
    asked = vectors if queries is None else queries
    own = blocks or max(4, -(-vectors.count() // most))
    asking = blocks or max(-(-asked.count() // most), -(-16 // own))
    deal = lambda df, name, n: df.select(F.col("id"), F.coalesce("org", F.lit("")).alias("org"), "vector", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(name))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = deal(asked, "block", asking).withColumn("other", each(own)).withColumn("query", F.lit(True))
    v = deal(vectors, "other", own).withColumn("block", each(asking)).withColumn("query", F.lit(False))
    return _best(q.unionByName(v), k, across)


def centres(vectors: DataFrame, cells: int, sample: int = 20_000, rounds: int = 8) -> np.ndarray:
    """Unit centres of cells by spherical k-means on about sample vectors, drawn by a hash of the id: a bounded, stated sample."""
    share = min(1.0, sample / max(1, vectors.count()))
    rows = vectors.where(F.pmod(F.xxhash64("id", F.lit("centre")), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))).select("id", "vector").orderBy("id").toArrow()
    m = _matrix(rows.column("vector").combine_chunks(), rows.num_rows)
    out = m[np.random.default_rng(0).permutation(len(m))[:cells]]
    for _ in range(rounds if len(m) else 0):
        own = (m @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, m)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(size > 0, sums / np.maximum(size, 1e-12), out)
    return out


def nearest_in_cells(vectors: DataFrame, k: int, queries: DataFrame | None = None, cells: int | None = None, probes: int | None = None, across: bool = True, most: int = 20_000) -> DataFrame:
    """nearest by an inverted file: every vector lies in the cell of its nearest centre, and a query is held against those of the nearest probes cells, exactly.

    Centres are fitted on a bounded sample, every vector is indexed. cells: the
    square root of the number of vectors; probes: two thirds of them, which is
    what vectors without any clusters need for a recall of 0.9 (measured: 0.92
    at 0.6 of the cells); where vectors cluster, a few per cent do. A cell of more than most
    vectors is dealt into blocks that all of its queries meet.
    """
    cells = cells or max(1, int(vectors.count() ** 0.5))
    middle = centres(vectors, cells)
    probes = probes or max(8, -(-2 * len(middle) // 3))

    def placed(df: DataFrame, n: int) -> DataFrame:
        def run(batches):
            for batch in batches:
                near = np.argsort(-(_matrix(batch.column(2), batch.num_rows) @ middle.T), axis=1, kind="stable")[:, :n] if len(middle) and batch.num_rows else np.zeros((batch.num_rows, 0), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["id", "org", "vector", "cells"])

        rows = df.select("id", F.coalesce("org", F.lit("")).alias("org"), F.col("vector").cast("array<float>").alias("vector"))
        return rows.mapInArrow(run, "id long, org string, vector array<float>, cells array<int>").withColumn("block", F.explode("cells")).drop("cells")

    indexed = materialise(placed(vectors, 1))
    sizes = materialise(indexed.groupBy("block").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("blocks")))
    v = indexed.join(F.broadcast(sizes), "block").withColumn("other", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("query", F.lit(False))
    asked = placed(vectors if queries is None else queries, min(probes, max(1, len(middle))))
    q = asked.join(F.broadcast(sizes), "block").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("query", F.lit(True))
    return _best(q.drop("blocks").unionByName(v.drop("blocks")), k, across)


def pair_cosine(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs with cosine, both vectors being of unit length."""
    side = lambda c: vectors.select(F.col("id").alias(f"{c}_id"), F.col("vector").alias(f"v{c}"))
    met = pairs.join(side("a"), "a_id", "left").join(side("b"), "b_id", "left")
    return met.withColumn("cosine", F.coalesce(codes.dot(F.col("va"), F.col("vb")), F.lit(0.0))).drop("va", "vb")


# --- shorthand ---------------------------------------------------------------


def plausible(short: Column, long: Column) -> Column:
    """Whether short can abbreviate long: shorter, of three letters or more, the same first letter, and a prefix, a subsequence, or a prefix of the consonants."""
    inside = F.array_join(F.transform(F.split(short, ""), lambda c: F.regexp_replace(c, r"([^A-Za-z0-9])", r"\\$1")), ".*")
    return (
        (F.length(short) < F.length(long))
        & (F.length(short) >= 3)
        & (F.substring(short, 1, 1) == F.substring(long, 1, 1))
        & F.substring(short, 1, 1).rlike("[A-Za-z]")
        & (F.startswith(long, short) | F.rlike(long, F.concat(F.lit("^"), inside)) | F.startswith(F.translate(long, "AEIOU", ""), short))
    )


def mine_shorthand(records: DataFrame, min_count: int = 2, min_lift: float = 1.2, most: int | None = 400, bucket: int | None = 60) -> DataFrame:
    """short, long, count, lift: shorthand that stands where a longer word stands in descriptions otherwise alike.

    records: (id, own_clean). Records of 2 to 24 content tokens that share one
    of their three longest ones are compared, where 2 to bucket records share
    it (None: any number); they may differ in one or two tokens a side and
    share three or more. A pair of tokens counts if it is plausible; lift is
    the share of rows that it counts for over that by chance. Known shorthand
    is left out; each short has its best long, and the most best stay (None: all).
    """
    rows = records.select("id", X.content_tokens(F.col("own_clean")).alias("words")).where(F.size("words").between(2, 24))
    rows = materialise(rows.select("id", F.array_distinct("words").alias("words")))
    anchors = F.slice(F.array_sort(F.transform(F.filter("words", lambda t: F.length(t) >= 3), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), 1, 3)
    keyed = rows.select("id", "words", F.explode(F.transform(anchors, lambda s: s["t"])).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1" if bucket is None else F.col("n").between(2, bucket)).select("key")
    kept = keyed.join(sizes, "key", "left_semi")
    a, b = (kept.select("key", F.col("id").alias(f"{c}_id"), F.col("words").alias(f"w{c}")) for c in "ab")
    x, y = F.array_except("wa", "wb"), F.array_except("wb", "wa")
    near = F.size(x).between(1, 2) & F.size(y).between(1, 2) & (F.size(F.array_intersect("wa", "wb")) >= 3)
    pairs = a.join(b, "key").where(F.col("a_id") < F.col("b_id")).where(near).select("a_id", "b_id", x.alias("x"), y.alias("ys")).distinct()
    differ = pairs.select(F.explode("x").alias("x"), "ys").select("x", F.explode("ys").alias("y"))
    short = F.when(F.length("x") < F.length("y"), F.struct(F.col("x").alias("short"), F.col("y").alias("long"))).otherwise(F.struct(F.col("y").alias("short"), F.col("x").alias("long")))
    counts = differ.select(short.alias("s")).select("s.*").where(plausible(F.col("short"), F.col("long"))).groupBy("short", "long").agg(F.count("*").alias("count"))
    counts = counts.where((F.col("count") >= min_count) & ~F.col("short").isin(list(K.SHORTHAND)))
    n = F.lit(float(max(rows.count(), 1)))
    frequency = rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("f"))
    lifted = counts.join(frequency.select(F.col("word").alias("short"), F.col("f").alias("fs")), "short").join(frequency.select(F.col("word").alias("long"), F.col("f").alias("fl")), "long")
    lift = F.round((F.col("count") / n) / ((F.col("fs") / n) * (F.col("fl") / n)), 6)
    lifted = lifted.withColumn("lift", lift).where(F.col("lift") >= min_lift).withColumn("worth", F.log("lift") * F.col("count"))
    best = lifted.groupBy("short").agg(F.max_by(F.struct("long", "count", "lift", "worth"), F.struct("worth", "long", "count")).alias("b"))
    out = best.select("short", "b.long", "b.count", "b.lift", "b.worth").orderBy(F.desc("worth"), F.desc("short"))
    return (out if most is None else out.limit(most)).drop("worth")


def lexicon(mined: DataFrame) -> X.Lexicon:
    """Mined shorthand, of bounded size, as a map for the expressions of functions.text."""
    return {r.short: r.long for r in mined.collect()}
