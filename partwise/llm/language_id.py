"""Operator 5, language ID: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.llm.shared import LOWER, buffers, keep_rows, mix, short_batches, table, trimmed, typed

BUCKETS = 1 << 14
GRAMS = (1, 2, 3)
UNKNOWN = "und"


#: Letters as they are, A-Z lower-cased; digits and signs of ASCII as one space.
CLASSES = LOWER[:128].astype(np.uint32)
CLASSES[:97] = CLASSES[123:128] = 32
CLASSES[65:91] = np.arange(97, 123)
#: Odd multipliers of the characters of an n-gram, and of its hash.
PLACES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
LAST = np.uint32(0x27D4EB2F)


def characters(data: np.ndarray) -> np.ndarray:
    """Code points of one text's UTF-8 bytes; those of ASCII by CLASSES."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    return np.where(codes < 128, CLASSES[np.minimum(codes, 127)], codes)


def counted(data: np.ndarray) -> np.ndarray:
    """How often each bucket occurs among the n-grams of one text's characters."""
    codes = characters(data)
    out = np.zeros(BUCKETS, dtype=np.int64)
    total = np.zeros(len(codes), dtype=np.uint32)
    for n in GRAMS:
        if len(codes) < n:
            break
        total = total[: len(codes) - n + 1] + codes[n - 1 :] * PLACES[n - 1] + np.uint32(n)
        mixed = (total ^ (total >> np.uint32(15))) * LAST
        out += np.bincount(mixed >> np.uint32(18), minlength=BUCKETS)
    return out


def tf(counts: np.ndarray) -> np.ndarray:
    return np.log1p(counts).astype(np.float32)


def has_letter(data: np.ndarray) -> bool:
    if ((data | 32) - 97 < 26).any():
        return True
    return bool((data >= 128).any()) and any(map(str.isalpha, data.tobytes().decode("utf-8", "replace")))


@dataclass
class Model:
    """Weights of one language each (rows: buckets, with idf in them), biases, idf and temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def predict(self, data: np.ndarray) -> tuple[str, float]:
        if not len(data) or not self.languages or not has_letter(data):
            return UNKNOWN, 0.0
        x = tf(counted(data)) * self.idf
        z = (x @ self.weights / max(float(np.sqrt(x @ x)), 1e-9) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader, proximal, with per-coordinate rates and elastic-net penalties.

    rows: (buckets, values) of each example, the last bucket being the bias.
    Returns weights (BUCKETS x n_classes) and bias.
    """
    z, n = np.zeros((BUCKETS + 1, n_classes)), np.zeros((BUCKETS + 1, n_classes))
    target = np.eye(n_classes)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x = rows[i]
            w = weights(z[at], n[at])
            score = x @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            g = x[:, None] * (p - target[y[i]])[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(z, n)
    return w[:-1], w[-1]


def calibrated(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on examples that were not fitted."""
    even = 1 / (len(y) + 2)  # of the weight is on all languages alike, so that faultless examples don't make it certain

    def loss(t: float) -> float:
        z = scores / t
        z = z - z.max(axis=1, keepdims=True)
        total = np.log(np.exp(z).sum(axis=1))
        return float((total - (1 - even) * z[np.arange(len(y)), y] - even * z.mean(axis=1)).mean())

    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 200))
    return float(grid[np.argmin([loss(t) for t in grid])]) if len(y) else 1.0


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all rows of docs (text); and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            rows += batch.num_rows
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                if b > a:
                    seen += counted(data[a:b]) > 0
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], rows))], names=["bucket", "n"])

    with short_batches(docs.sparkSession):
        total = docs.select("text").mapInArrow(trimmed(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in total:
        if r.bucket >= 0:
            out[r.bucket] = r.n
    return out, next((r.n for r in total if r.bucket < 0), 0)


def sparse_counts(docs: DataFrame) -> DataFrame:
    """lang, doc_id, buckets and counts of each row of docs (doc_id, lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            got = [counted(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            at = [np.flatnonzero(c) for c in got]
            columns = [pa.array(at, pa.list_(pa.int16())), pa.array([c[i].astype(np.int32) for c, i in zip(got, at, strict=True)], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "lang", "buckets", "counts"])

    return docs.select("doc_id", "lang", "text").mapInArrow(trimmed(run), "doc_id long, lang string, buckets array<short>, counts array<int>")


def fit(docs: DataFrame, sample: int = 500, calibration: float = 0.2) -> Model:
    """Learn from the labelled rows of docs (doc_id, text, lang).

    Document frequencies cover all of them. The weights are fitted on about
    sample rows of each language (all of a language with fewer), drawn by a hash
    of doc_id and text; a share of those, drawn likewise, only sets the temperature. What
    comes to the driver is bounded by sample, BUCKETS and the number of languages.
    """
    docs = typed(docs, doc_id="long", text="string", lang="string").where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), np.ones(BUCKETS), 1.0)
    seen, n = document_frequency(docs)
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + np.float32(0.05)
    share = F.lit(0.0)
    for language, size in sizes.items():
        share = F.when(F.col("lang") == language, min(1.0, sample / size)).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("fit")), F.lit(1_000_000)) / 1_000_000
    with short_batches(docs.sparkSession):
        rows = sparse_counts(docs.where(draw < share)).collect()
    rows.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.lang))
    examples, y, held = [], [], []
    for r in rows:
        at = np.array(r.buckets, np.int64)
        x = tf(np.array(r.counts)) * idf[at]
        examples.append((np.append(at, BUCKETS), np.append(x / max(float(np.sqrt(x @ x)), 1e-9), 1.0)))
        y.append(languages.index(r.lang))
        held.append(int(mix(np.array([r.doc_id or 0], np.int64).view(np.uint64))[0] % np.uint64(1000)) < 1000 * calibration)
    y, held = np.array(y, np.int64), np.array(held, bool)
    if held.all():
        held[:] = False
    weights, bias = ftrl([e for e, h in zip(examples, held, strict=True) if not h], y[~held], len(languages))
    scores = np.array([x[:-1] @ weights[at[:-1]] + bias for (at, x), h in zip(examples, held, strict=True) if h]).reshape(-1, len(languages))
    return Model(languages, weights.astype(np.float32), bias, idf, calibrated(scores, y[held]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, mark (xxhash64 of the text), lang_pred, score of every row of docs (doc_id, text), from its whole text.

    und with score 0 for a text that is null or has no letter, and for every
    text if nothing was learned. Rows are judged one by one; an empty table
    gives none.
    """
    bc = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            got = [bc.value.predict(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "mark", "lang_pred", "score"])

    return typed(docs, doc_id="long", text="string").withColumn("mark", F.xxhash64("text")).mapInArrow(trimmed(run), "doc_id long, mark long, lang_pred string, score double")


def fold() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


def language_id(docs: DataFrame) -> DataFrame:
    """Predict the language of every row of docs; rows of fold 2 teach nothing. doc_id, mark, held_out, lang_pred, score.

    A null doc_id is of no fold and may teach; repeated rows are judged, and
    may teach, each by itself. See fit and predict for null texts and labels.
    """
    model = fit(docs.where(fold().isNull() | (fold() != 2)))
    return predict(docs, model).select("doc_id", "mark", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose language is not und: those of a null text or one without letters go, and all if nothing can be learned."""
    return keep_rows(docs, language_id(docs).select("doc_id", "mark", (F.col("lang_pred") != UNKNOWN).alias("kept")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents")).drop("mark")
