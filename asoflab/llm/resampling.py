"""Target-distribution importance resampling of documents, hashed n-grams of words as features.

Words are runs of ASCII letters and digits or of characters beyond ASCII, lower-cased by
ASCII rules. A document's features are all runs of ``shortest`` to ``longest`` consecutive
words, joined by one space, repeats counted. Feature hashes are CRC-32 modulo ``buckets``.
A bucket's gain is the smoothed log ratio of its share in the target and in the documents;
a document's weight is the sum of its features' gains. Documents of at least ``least_words``
words are drawn by weight plus Gumbel noise from a hash of seed and id, which is sampling
without replacement by weight.

CRC-32 by position table (``crc32_of_spans``): a CRC is linear over XOR, so a span's is the XOR
of one contribution a byte, looked up by (distance from the span's end, byte), and of a
constant for its length that carries the start and end values. All spans of a batch are done
by one gather and one ``bitwise_xor.reduceat``. Spans longer than the table are cut into
blocks, the odd one first, and folded: the CRC so far, shifted by a block, is XORed with the
next block's.

Two passes over the texts: one counts buckets, which travel as one row of ``buckets`` numbers
a batch, and one scores. The gains, ``buckets`` numbers, are the only thing the driver holds.
Ranks come from a sort by ranges; no task gets all documents.

Null and empty texts have no features, weight 0 and are not drawn. A null doc_id counts as the
empty text in the hash and comes last among ties; rows of a repeated id are drawn one by one.
An empty target or table gives gains from the smoothing alone or no rows. Only doc_id and text
are read, so other columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Distances from the end that the table has; longer spans are folded.
REACH = 64
#: Bytes of spans that are looked up at once, and bytes of text that are cut into words at once.
STRIDE, CHUNK = 1 << 20, 1 << 22


def position_table(reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """Contributions [distance from the end, byte], and the constants of lengths 0 to reach."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(POLYNOMIAL), x >> 1)
    rows, start, constants = [x], np.uint32(0xFFFFFFFF), [0]
    for _ in range(reach):
        rows.append(rows[0][rows[-1] & 255] ^ (rows[-1] >> 8))
        start = rows[0][start & np.uint32(255)] ^ (start >> np.uint32(8))
        constants.append(int(start) ^ 0xFFFFFFFF)
    return np.array(rows[:reach]), np.array(constants, np.uint32)


TABLE, CONSTANTS = position_table()
FLAT = TABLE.ravel()


def _plain(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XOR of the contributions of each span of 1 to REACH bytes, without the constants."""
    lengths = ends - starts
    bounds = np.cumsum(lengths)
    out = np.empty(len(starts), np.uint32)
    first = 0
    while first < len(starts):
        done = bounds[first] - lengths[first]
        last = max(first + 1, int(np.searchsorted(bounds, done + STRIDE, "right")))
        n = lengths[first:last]
        at = bounds[first:last] - n - done
        inner = np.arange(int(n.sum())) - np.repeat(at, n)
        byte = data[inner + np.repeat(starts[first:last], n)]
        distance = np.repeat(n - 1, n) - inner
        out[first:last] = np.bitwise_xor.reduceat(FLAT[distance * 256 + byte], at)
        first = last
    return out


def _shifted(x: np.ndarray) -> np.ndarray:
    """The plain CRC x once REACH more bytes follow, without their own contributions."""
    return TABLE[REACH - 1, x & 255] ^ TABLE[REACH - 2, x >> 8 & 255] ^ TABLE[REACH - 3, x >> 16 & 255] ^ TABLE[REACH - 4, x >> 24]


def crc32_of_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] for each span, as zlib.crc32 has it; spans may be empty, long or overlap."""
    lengths = ends - starts
    short = lengths <= REACH
    out = np.zeros(len(starts), np.uint32)
    some = short & (lengths > 0)
    out[some] = _plain(data, starts[some], ends[some]) ^ CONSTANTS[lengths[some]]
    long = np.flatnonzero(~short)
    if len(long):
        blocks = -(-lengths[long] // REACH)
        head = lengths[long] - (blocks - 1) * REACH
        first = np.cumsum(blocks) - blocks
        inner = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
        end = np.repeat(starts[long] + head, blocks) + inner * REACH
        parts = _plain(data, np.where(inner == 0, np.repeat(starts[long], blocks), end - REACH), end)
        # the start value enters with the head's constant and is shifted along with it
        state = parts[first] ^ CONSTANTS[head] ^ np.uint32(0xFFFFFFFF)
        for k in range(1, int(blocks.max())):
            on = np.flatnonzero(blocks > k)
            state[on] = _shifted(state[on]) ^ parts[first[on] + k]
        out[long] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Bytes lower-cased, and which of them belong to words."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[128:] = True
    return lower, word


LOWER, WORD = _classes()


def features(data: np.ndarray, ends: np.ndarray, shortest: int, longest: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for each length of run (text of each feature, its CRC-32).

    data: the texts' bytes, each text followed by a line end; ends: behind each text's line end.
    """
    low = LOWER[data]
    inside = WORD[low]
    closing = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1  # the byte behind each word
    kept = inside.copy()
    kept[closing] = True
    low[closing] = 32
    joined = low[kept]  # words with one space behind each
    stop = np.flatnonzero(joined == 32)
    begin = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
    until = np.searchsorted(closing, ends)
    n_words = np.diff(until, prepend=0)
    text = np.repeat(np.arange(len(ends)), n_words)
    out = []
    for n in range(shortest, longest + 1):
        if len(stop) < n:
            break
        same = text[: len(stop) - n + 1] == text[n - 1 :]
        out.append((text[: len(stop) - n + 1][same], crc32_of_spans(joined, begin[: len(stop) - n + 1][same], stop[n - 1 :][same])))
    return n_words, out


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, ends): a chunk has about CHUNK bytes, or one text."""
    kind = pa.large_string()
    lined = pc.binary_join_element_wise(pc.fill_null(texts.cast(kind), ""), pa.scalar("\n", kind), pa.scalar("", kind))
    if not len(lined):
        return
    offsets = np.frombuffer(lined.buffers()[1], np.int64)[lined.offset : lined.offset + len(lined) + 1]
    data = np.frombuffer(lined.buffers()[2], np.uint8)
    first = 0
    while first < len(lined):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first + 1 : last + 1] - offsets[first]
        first = last


def _counting(shortest: int, longest: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, data, ends in _chunks(b.column(0)):
                for _, crc in features(data, ends, shortest, longest)[1]:
                    held += np.bincount(crc % buckets, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([held.astype("<i8").tobytes()], pa.binary())], ["held"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for b in batches:
        for x in b.column(0).to_pylist():
            one = np.frombuffer(x, "<i8")
            held = one if held is None else held + one
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held.astype("<i8").tobytes()], pa.binary())], ["held"])


def counts(texts: DataFrame, shortest: int, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket. Each task adds up its own; tens of rows are left for the driver."""
    held = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counting(shortest, longest, buckets), "held binary")
    held = held.repartition(16).mapInArrow(_added, "held binary")
    return sum((np.frombuffer(r["held"], "<i8") for r in held.collect()), np.zeros(buckets, np.int64))


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) of each bucket."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for t, s in zip(target.tolist(), source.tolist(), strict=True)], np.int64)


def _weighing(gain: np.ndarray, shortest: int, longest: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, ends in _chunks(b.column(1)):
                n_words, found = features(data, ends, shortest, longest)
                n, weight = np.zeros(last - first, np.int64), np.zeros(last - first, np.int64)
                for text, crc in found:
                    edges = np.searchsorted(text, np.arange(last - first + 1))
                    sums = np.concatenate([[0], np.cumsum(gain[crc % len(gain)])])
                    n += np.diff(edges)
                    weight += np.diff(sums[edges])
                ids = b.column(0).slice(first, last - first)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return run


def resampled(
    docs: DataFrame, target: DataFrame, shortest: int = 1, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs(doc_id, text); rank is null where it is not drawn."""
    spark = docs.sparkSession
    common.importable(spark)
    gain = gains(counts(target, shortest, longest, buckets), counts(docs, shortest, longest, buckets))
    fields = "doc_id long, n_words long, n_features long, weight long"
    weighed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_weighing(gain, shortest, longest), fields)
    number = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(number, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = common.written(weighed.withColumn("score", F.col("weight") + noise), "scored")
    able = F.col("n_words") >= least_words
    most = percent * scored.where(able).count() // 100
    ranked = common.global_places(scored.where(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank").cast("long")))
    return ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
