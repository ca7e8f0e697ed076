"""Substring dedup over words by a compressed FM-index per shard.

Words are hashed to symbols and cut into segments that meet by anchor (see ``anchors``). Each shard
builds an FM-index of its segments: the Burrows-Wheeler transform in a wavelet matrix of packed
bits. The segments are streamed against it by backward search, all windows in step; a search ends
when nothing but the window itself matches, and the number of matched words is its matching
statistic. Windows whose statistic reaches the threshold are intervals of the suffix order; the
earliest document and place among an interval's equal windows stays.

A word in a window of 20 words that also starts earlier (smaller doc_id, or the same document
nearer its start) is removed. Windows are judged on the input.

Null text has no words. Rows with a null doc_id are neither judged nor searched and kept whole.
Rows that share a doc_id count as one document at one place: they don't repeat each other, and
what is removed from one is removed from all. An empty table gives an empty result. Whole texts are
read, and texts of any length are worked off in pieces. Extra columns are ignored by
``repeated_words`` and kept by ``without_repeats``.

Symbols are 8-bit word hashes. Windows that agree in all 20 are held equal only if 32 bits of a
hash over their whole words agree too, which settles windows that differ in a word at the edge.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Plan, Sender, Shard, by_shard, plan, union
from .common import Scratch, byte_words, hashed_words, parts, trim

WINDOW = 20
ANCHOR = 5
CHUNK = 1_000_000
SHARDS_PER_PARTITION = 4


class Bits:
    """A packed bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class FMIndex:
    """Backward search over a text of bytes, whose 0 bytes separate segments."""

    LEVELS = 8

    def __init__(self, text: np.ndarray, depth: int):
        """The suffixes are sorted by their first ``depth`` bytes, enough for patterns up to that."""
        n = len(text)
        padded = np.zeros(n + depth + 8, np.uint64)
        padded[:n] = text
        keys = []
        for lo in range(0, depth, 8):
            k = np.zeros(n, np.uint64)
            for i in range(lo, min(lo + 8, depth)):
                k = (k << np.uint64(8)) | padded[i : i + n]
            keys.append(k)
        self.sa = np.lexsort(keys[::-1])
        symbols = text[self.sa - 1]
        self.starts = np.zeros(257, np.int64)
        np.cumsum(np.bincount(text, minlength=256), out=self.starts[1:])
        self.levels, self.zeros = [], []
        self.base = np.zeros(256, np.int64)  # where the path of each symbol from position 0 ends
        every = np.arange(256)
        for level in range(self.LEVELS - 1, -1, -1):
            bits = (symbols >> level) & 1
            self.levels.append(Bits(bits))
            z = int(n - bits.sum())
            self.zeros.append(z)
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
            ones = self.levels[-1].rank(self.base)
            self.base = np.where((every >> level) & 1, z + ones, self.base - ones)

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of c + pattern from those of the patterns."""
        both, cc = np.concatenate([lo, hi]), np.concatenate([c, c])
        for level, bits, z in zip(range(self.LEVELS - 1, -1, -1), self.levels, self.zeros):
            ones = bits.rank(both)
            both = np.where((cc >> level) & 1, z + ones, both - ones)
        both += (self.starts[:-1] - self.base)[cc]
        return both[: len(lo)], both[len(lo) :]


def matching_statistics(index: FMIndex, text: np.ndarray, at: np.ndarray, window: int):
    """How many symbols, up to ``window``, of each window ending match somewhere else as well.

    Returns (statistic, lo, hi): for windows that match whole, their interval of suffixes.
    """
    stat = np.zeros(len(at), np.int64)
    lo_out, hi_out = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for begin in range(0, len(at), 1 << 18):
        live = np.arange(begin, min(len(at), begin + (1 << 18)))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(text), np.int64)
        for step in range(1, window + 1):
            lo, hi = index.extend(text[at[live] + window - step].astype(np.int64), lo, hi)
            more = hi - lo > 1
            live, lo, hi = live[more], lo[more], hi[more]
            stat[live] = step
            if not len(live):
                break
        lo_out[live], hi_out[live] = lo, hi
    return stat, lo_out, hi_out


def _judge(window: int):
    def run(s: Shard):
        none = (np.empty(0, np.int64),) * 3
        if not len(s.length):
            return none
        # a 0 after every segment; doc and place of each symbol
        ends = np.cumsum(s.length + 1)
        start = ends - s.length - 1
        text = np.zeros(int(ends[-1]), np.uint8)
        inside = np.ones(len(text), bool)
        inside[ends - 1] = False
        text[inside] = s.symbols
        seg = np.repeat(np.arange(len(s.length)), s.length + 1)
        offset = np.arange(len(text)) - start[seg]
        at = np.flatnonzero(offset <= s.length[seg] - window)
        index = FMIndex(text, window)
        stat, lo, hi = matching_statistics(index, text, at, window)
        hit = stat >= window
        at, lo = at[hit], lo[hit]
        if not len(at):
            return none
        # windows of one interval are equal if their checks agree too; the oldest of them stays
        check = s.checks[hit]
        doc, place = s.doc[seg[at]], s.place[seg[at]] + offset[at]
        order = np.lexsort((place, doc, check, lo))
        at, lo, check, doc, place = at[order], lo[order], check[order], doc[order], place[order]
        new = np.ones(len(at), bool)
        new[1:] = (lo[1:] != lo[:-1]) | (check[1:] != check[:-1])
        oldest = np.flatnonzero(new)[np.cumsum(new) - 1]
        late = (doc != doc[oldest]) | (place != place[oldest])
        return doc[late], place[late], place[late] + window

    return run


def _read(batches):
    for b in batches:
        for doc, h in zip(b.column("doc_id").to_pylist(), hashed_words(b.column("text"))):
            yield doc, h, ((h >> np.uint64(33)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def _send(window: int, anchor: int, how: Plan):
    def run(batches):
        sender = Sender(window, anchor, how, True, CHUNK, checks=True)
        for row in _read(batches):
            yield from sender.add(*row)
        yield from sender.flush()
        trim()

    return run


def repeated_spans(spark: SparkSession, docs: DataFrame, scratch: Scratch, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, spans): the word spans to remove, a list of int64 pairs as bytes from each shard."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    how = plan(texts, scratch, _read, window, anchor, True, CHUNK, parts(spark) * SHARDS_PER_PARTITION)
    sent = texts.mapInArrow(_send(window, anchor, how), "shard int, blob binary")
    met = sent.repartition(parts(spark), "shard").sortWithinPartitions("shard")
    return met.mapInArrow(by_shard(_judge(window), window), "doc_id long, spans binary")


def _finish():
    def run(batches):
        for b in batches:
            rows = []
            for doc, text, blobs in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("blobs").to_pylist()):
                words, kept = byte_words(text), []
                at = 0
                for lo, hi in union(blobs).tolist():
                    kept += words[at:lo]
                    at = hi
                kept += words[at:]
                rows.append((doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _with_spans(spark: SparkSession, docs: DataFrame, window: int) -> DataFrame:
    scratch = Scratch(spark, "fmindex")
    spans = scratch.save(repeated_spans(spark, docs, scratch, window), "spans")
    lists = spans.groupBy("doc_id").agg(F.collect_list("spans").alias("blobs"))
    return lists.select(F.col("doc_id").alias("__d"), "blobs")


def repeated_words(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    lists = _with_spans(spark, docs, window)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.join(lists, F.col("doc_id") == F.col("__d"), "left").select("doc_id", "text", "blobs")
    return out.mapInArrow(_finish(), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated windows cut from the text; a text with none is left as it is."""
    lists = _with_spans(spark, docs, window).withColumnRenamed("blobs", "__blobs")
    names, kind = docs.columns, docs.schema

    def run(batches):
        for b in batches:
            cols = {n: b.column(n) for n in names}
            if b.num_rows:
                out = []
                for text, blobs in zip(b.column("text").to_pylist(), b.column("__blobs").to_pylist()):
                    spans = union(blobs)
                    if len(spans):
                        words, kept, at = byte_words(text), [], 0
                        for lo, hi in spans.tolist():
                            kept += words[at:lo]
                            at = hi
                        text = b" ".join(kept + words[at:]).decode("utf-8", "surrogatepass")
                    out.append(text)
                cols["text"] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names)

    joined = docs.join(lists, docs["doc_id"].cast("long") == lists["__d"], "left").drop("__d")
    out = joined.mapInArrow(run, kind)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(kind["n_chars"].dataType))
    return out.select(*names)
