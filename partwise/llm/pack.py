"""Operator 9, best-fit packing: Martello-Toth dominance reduction, then best fit, over counts of lengths."""

from __future__ import annotations

import bisect
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partwise.llm.shared import buffers, chunks, materialise, mix, release, span_hashes, table, trimmed, typed

# --- tokens ------------------------------------------------------------------

#: Code points of Unicode's White_Space property (fixed values of the standard).
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4


@cache
def kinds() -> np.ndarray:
    """The kind of every code point, as the tokenizer's split pattern tells them apart."""
    first = np.frombuffer("".join([unicodedata.category(c)[0] for c in map(chr, range(0x110000))]).encode(), np.uint8)
    out = np.where(first == ord("L"), LETTER, np.where(first == ord("N"), NUMBER, OTHER)).astype(np.uint8)
    out[SPACES] = SPACE
    return out


class Encoder:
    """Ids of whole texts by a byte-level BPE file of `tokenizers`, without added special tokens.

    Texts are split into the tokenizer's words by array operations over code
    points; each distinct word is encoded once. A text with the string of a
    special token in it is left to the library.
    """

    def __init__(self, path: str, cached: int = 200_000):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        vocabulary = {t: i for t, i in self.whole.get_vocab(with_added_tokens=False).items()}
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        symbols = byte_symbols()
        ranks = {bytes(symbols[c] for c in t): i for t, i in vocabulary.items() if t not in self.special}
        self.bpe = Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.cached, self.known = cached, {}

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and bounds of each text's ids."""
        raw = data[offsets[0] : offsets[-1]].tobytes()
        text = raw.decode("utf-8", "replace")
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        bounds = lead[offsets - offsets[0]]
        starts, ends = split_words(points, bounds)
        _, index, inverse = np.unique(span_hashes(points, starts, ends), return_index=True, return_inverse=True)
        # Words of one hash are told apart by their lengths and by another sum; the words themselves are the keys of the cache.
        other = np.add.reduceat(mix(points.astype(np.uint64)), starts) if len(starts) else starts
        if (((ends - starts) != (ends - starts)[index][inverse]) | (other != other[index][inverse])).any():
            index, inverse = np.arange(len(starts)), np.arange(len(starts))
        if len(self.known) > self.cached:
            self.known.clear()
        known, encode = self.known, self.bpe.encode_ordinary
        found = [text[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist(), strict=True)]
        ids = list(map(known.get, found))
        for k in [k for k, x in enumerate(ids) if x is None]:
            ids[k] = known[found[k]] = array("I", encode(found[k])).tobytes()
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat = np.frombuffer(b"".join(ids), np.uint32)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
        n = size[inverse]
        until = np.cumsum(n)
        out = flat[np.repeat(begin[inverse] - (until - n), n) + np.arange(n.sum())] if len(n) else flat
        per_text = np.concatenate([[0], until])[np.searchsorted(starts, bounds)]
        if any(s in text for s in self.special):
            parts = [out[a:b] for a, b in zip(per_text[:-1], per_text[1:], strict=True)]
            for k in range(len(parts)):
                own = text[bounds[k] : bounds[k + 1]]
                if any(s in own for s in self.special):
                    parts[k] = np.array(self.whole.encode(own, add_special_tokens=False).ids, np.uint32)
            per_text = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            out = np.concatenate(parts)
        return out, per_text


def byte_symbols() -> dict[str, int]:
    """The printable symbol of each byte in byte-level vocabularies: itself where printable, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def split_words(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the words of the byte-level split pattern in texts that follow each other.

    Runs of one kind are words; one space before a run belongs to it; of a run
    of white space before something else the last is apart; 's and the like
    begin a word where a run of other signs would.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = kinds()[np.minimum(points, 0x10FFFF)]
    begins = np.zeros(n + 1, dtype=bool)
    begins[bounds] = True
    start = begins.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # White space at i that something else of the same text follows.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~begins[1:n])
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    marks = np.flatnonzero((points[:-1] == 0x27) & start[: n - 1])
    if len(marks):
        stop = bounds[np.searchsorted(bounds, marks, "right")]
        for tail in CONTRACTIONS:
            fits = marks + len(tail) < stop
            for j, c in enumerate(tail):
                fits &= points[np.minimum(marks + 1 + j, n - 1)] == ord(c)
            at = marks[fits]
            for j in range(len(tail)):
                start[at + 1 + j] = False
            start[at + 1 + len(tail)] = True
    starts = np.flatnonzero(start[:n])
    return starts, np.append(starts[1:], n)


def tokenised(docs: DataFrame, path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, piece, start, length, ids_crc32. A longer document's first piece takes what is over."""
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        release()  # what reading the file took
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, j in chunks(offsets):
                doc, piece, start, length, crc = [], [], [], [], []
                ids, bounds = encoder.encode(data, offsets[i : j + 1])
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    own = np.append(ids[a:b], end_id).astype("<u4")
                    cut = len(own) % capacity if len(own) > capacity else len(own)
                    edges = [0, *range(cut or capacity, len(own), capacity), len(own)]
                    for number, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        doc.append(i + k)
                        piece.append(number)
                        start.append(s)
                        length.append(e - s)
                        crc.append(zlib.crc32(own[s:e].tobytes()))
                columns = [batch.column(0).take(pa.array(doc, pa.int64())), *(pa.array(x, f.type) for x, f in zip((piece, start, length, crc), list(out)[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return typed(docs, doc_id="long", text="string").mapInArrow(trimmed(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- packing -----------------------------------------------------------------


class Plan:
    """How many bins of which pattern; a pattern is a chain of (length, times)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.bins: list[tuple[tuple, int]] = []  # (chain, count); chain: (before, length, times) or None

    def rows(self) -> np.ndarray:
        """length, first rank, count of bins, first bin, offset, times of each place, by length and first rank."""
        used: dict[int, int] = {}
        out, bin_at = [], 0
        for chain, count in self.bins:
            parts = []
            while chain is not None:
                parts.append(chain[1:])
                chain = chain[0]
            offset = 0
            for length, times in reversed(parts):
                rank = used.get(length, 0)
                out.append((length, rank, count, bin_at, offset, times))
                used[length] = rank + count * times
                offset += length * times
            bin_at += count
        return np.array(sorted(out), dtype=np.int64).reshape(-1, 6)


def reduce_by_dominance(counts: dict[int, int], plan: Plan) -> None:
    """Fix sets that dominate every other with their largest item; counts and plan are changed.

    The items are taken from the longest down. For an item j let k be the
    longest other that fits beside it. {j} dominates if nothing fits. {j, k}
    dominates if it fills the bin, if no two others fit beside j, or if at most
    two fit and no two that do are longer together than k. {j, k, b}, b being
    the longest that fits beside both, dominates if at most two others fit
    beside j and b is as long as the shorter of any two that do. An item
    without such a set stays for best fit.
    """
    cap = plan.capacity
    left = sorted(counts)

    def longest(limit: int) -> int:
        at = bisect.bisect_right(left, limit)
        return left[at - 1] if at else 0

    def take(lengths: list[int], times: int) -> None:
        chain = None
        for x in lengths:
            chain = (chain, x, 1)
            counts[x] -= times
            if not counts[x]:
                del counts[x]
                left.pop(bisect.bisect_left(left, x))
        plan.bins.append((chain, times))

    def smallest(n: int, without: int) -> int | None:
        """Sum of the n smallest items besides one of length without; None if there are fewer."""
        total = 0
        for x in left:
            here = min(n, counts[x] - (x == without))
            total, n = total + here * x, n - here
            if not n:
                return total
        return None

    for j in sorted(counts, reverse=True):
        while counts.get(j):
            room = cap - j
            one = longest(room)
            if one == j and counts[j] == 1:
                at = bisect.bisect_left(left, j)
                one = left[at - 1] if at else 0
            if not one:
                take([j], counts[j] if longest(room) == 0 else 1)
                continue
            times = counts[j] // 2 if one == j else min(counts[j], counts[one])
            two, three = smallest(2, j), smallest(3, j)
            if one == room or two is None or two > room:
                take([j, one], times)
                continue
            if three is not None and three <= room:
                break  # three others fit: no rule
            pair = best_pair(left, counts, room, j)
            if one >= pair[0]:
                take([j, one], 1)
                continue
            beside = longest(room - one)
            if beside and beside >= pair[1] and counts[beside] > (beside == j) + (beside == one):
                take([j, one, beside], 1)
                continue
            break


def best_pair(left: list[int], counts: dict[int, int], room: int, j: int) -> tuple[int, int]:
    """Of two items besides one j that fit in room together: the largest sum, and the longest that the shorter can be."""
    most, shorter = 0, 0
    own = lambda x: counts[x] - (x == j)
    hi = bisect.bisect_right(left, room) - 1
    for lo in range(hi + 1):
        while hi >= lo and left[lo] + left[hi] > room:
            hi -= 1
        if hi < lo:
            break
        if own(left[lo]) < 1:
            continue
        at = hi
        while at >= lo and (own(left[at]) < 1 or (at == lo and own(left[lo]) < 2)):
            at -= 1
        if at >= lo:
            most, shorter = max(most, left[lo] + left[at]), left[lo]
    return most, shorter


def best_fit(counts: dict[int, int], plan: Plan) -> None:
    """Best fit of the lengths from the longest down: each into the fullest bin that it fits, else into a new one.

    Equal items and equal bins are handled together, so the work follows the
    number of lengths and not that of items.
    """
    bins: dict[int, list[tuple[tuple, int]]] = {}
    rooms: list[int] = []

    def put(room: int, chain: tuple, count: int) -> None:
        if count:
            if room not in bins:
                bisect.insort(rooms, room)
                bins[room] = []
            bins[room].append((chain, count))

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            at = bisect.bisect_left(rooms, x)
            if at < len(rooms):
                room = rooms[at]
                chain, count = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(at)
            else:
                room, chain, count = plan.capacity, None, n
            each = room // x
            full = min(count, n // each)
            put(room - each * x, (chain, x, each), full)
            n, count = n - full * each, count - full
            if n and count:  # one bin more takes the rest; n < each
                put(room - n * x, (chain, x, n), 1)
                n, count = 0, count - 1
            if chain is not None:
                put(room, chain, count)
    for room in rooms:
        plan.bins += bins[room]


def plan_of(counts: dict[int, int], capacity: int) -> Plan:
    """counts: items by length, 1..capacity."""
    counts, plan = {k: v for k, v in counts.items() if v}, Plan(capacity)
    if full := counts.pop(capacity, 0):
        plan.bins.append(((None, capacity, 1), full))
    reduce_by_dominance(counts, plan)
    best_fit(counts, plan)
    return plan


def placed(plan: np.ndarray):
    """mapInArrow function that adds sequence_id and offset to (..., length, ..., rank)."""
    wide = np.int64(1) << 40
    key = plan[:, 0] * wide + plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            row = plan[np.searchsorted(key, length * wide + rank, "right") - 1]
            step, which = np.divmod(rank - row[:, 1], row[:, 2])
            columns = [*batch.columns[:5], pa.array(row[:, 3] + which), pa.array(row[:, 4] + step * length)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, per_part: int = 1 << 20) -> DataFrame:
    """Pack docs (doc_id, text) into sequences of at most capacity tokens; one row per piece of a document.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only
    the counts of the lengths, at most capacity numbers, come to the driver;
    there they are packed. A piece is then placed by its rank among those of
    its length. Ranks are counted within parts by a hash of the document, of
    about per_part pieces of a length at most, and carried on from sums by part,
    so a length that many pieces share is not ranked in one task. The plan that is sent out has at most a few rows for
    each pair of lengths, however many documents there are.

    Null texts are empty: a document of one end token. Rows that repeat a
    doc_id are documents of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = materialise(tokenised(docs, tokenizer, capacity, end_id))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = max(256, -(-max(counts.values(), default=0) // per_part))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    rows = plan_of(counts, capacity).rows()
    spread = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spread = spread.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("own", F.row_number().over(own) - 1).join(spread, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).alias("rank"))
    if not len(rows):
        return spark.createDataFrame([], "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return ranked.mapInArrow(trimmed(placed(rows)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
