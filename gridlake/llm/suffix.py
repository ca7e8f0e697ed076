"""Substring dedup over bytes by suffix sorting with bucket-pointer refinement.

Texts are cut into segments that meet by anchor (see ``anchors``). Of a shard's equal segments one is
sorted, and only if another text has its anchor. A shard sorts its suffixes: they start in buckets
by their first bytes, 8 or as many as a sort key holds beside a place (5 or 6 of most texts), and a
bucket is refined by sorting its members on the bucket numbers of later offsets. Each pass uses the
numbers the last one left, so the depth doubles, and a last pass at a smaller offset reaches 400.
Suffixes that share a bucket then agree in 400 bytes.

A byte covered by a 400-byte string that also starts anywhere else, the same document included, is
removed, in every place. Overlaps count, and strings are judged on the input.

Null text is empty. Rows with a null doc_id are neither judged nor searched and kept whole. Rows
that share a doc_id count as separate places that lose the same bytes. An empty table gives an empty
result. Whole texts are read, and texts of any length are worked off in pieces. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Plan, Sender, Shard, by_shard, plan, ragged, union
from .common import Scratch, parts, trim

WINDOW = 400
ANCHOR = 64
Q = 8
CHUNK = 1_000_000
SHARDS_PER_PARTITION = 16

_VALUES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)


def _tie(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, of ``bits`` bits, and where in it a key differs from the one before.

    Keys that leave room for their place are sorted with it, which is far quicker than an order of them.
    """
    room = max(1, (len(key) - 1).bit_length())
    new = np.ones(len(key), bool)
    if bits + room <= 64:
        room = np.uint64(room)
        both = (key.astype(np.uint64) << room) | np.arange(len(key), dtype=np.uint64)
        both.sort()
        order = (both & ((np.uint64(1) << room) - np.uint64(1))).astype(np.int32)
        key = both >> room
    else:
        order = np.argsort(key)
        key = key[order]
    new[1:] = key[1:] != key[:-1]
    return order, new


def _start(text: np.ndarray, left: np.ndarray, depth: int) -> tuple[int, np.ndarray, np.ndarray, int]:
    """(symbols, positions, keys, bits of a key): as many first symbols as a key holds beside a place, Q at most.

    Symbols are numbered by what occurs in the text, which keeps their order.
    """
    n = len(text)
    occurs = np.bincount(text, minlength=256) > 0
    bits = max(1, (int(occurs.sum()) - 1).bit_length())
    have = max(1, min(Q, depth, (64 - max(1, (n - 1).bit_length())) // bits))
    padded = np.zeros(n + have, np.uint64)
    padded[:n] = (np.cumsum(occurs) - 1).astype(np.uint64)[text]
    key = np.zeros(n, np.uint64)
    for i in range(have):
        key = (key << np.uint64(bits)) | padded[i : i + n]
    at = np.flatnonzero(left >= have).astype(np.int32)
    return have, at, key[at], bits * have


def refine(text: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Bucket number of the ``depth`` bytes at each position that another position shares, else -1.

    ``ends``: for each position the end of its segment. Numbers are in the order of the strings. A
    position leaves as soon as it is alone in its bucket, or what follows it is: nothing deeper can
    match it then.
    """
    n = len(text)
    left = (ends - np.arange(n)).astype(np.int32)
    bucket = np.full(n, -1, np.int32)
    have, at, key, bits = _start(text, left, depth)
    while True:
        order, new = _tie(key, bits)
        shared = ~new
        shared[:-1] |= ~new[1:]
        bucket[:] = -1
        at = at[order[shared]]
        number = np.cumsum(new[shared], dtype=np.int32) - np.int32(1)
        bucket[at] = number
        if have >= depth or not len(at):
            return bucket
        step = min(have, depth - have)
        most = int(number[-1]).bit_length()
        then = np.where(left[at] >= have + step, bucket[np.minimum(at + step, n - 1)], -1)
        on = np.flatnonzero(then >= 0)
        if not len(on):
            bucket[:] = -1
            return bucket
        at = at[on]
        key, bits = (number[on].astype(np.int64) << most) | then[on], 2 * most
        have += step


def _classes(s: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each segment, segments of each class, first segment of each class); equal segments are a class."""
    raw, end = s.symbols.tobytes(), np.cumsum(s.length)
    seen: dict[bytes, int] = {}
    cls = np.array([seen.setdefault(raw[lo:hi], len(seen)) for lo, hi in zip((end - s.length).tolist(), end.tolist())], np.int64)
    first = np.full(len(seen), len(cls), np.int64)
    np.minimum.at(first, cls, np.arange(len(cls)))
    return cls, np.bincount(cls, minlength=len(seen)), first


def _judge(window: int):
    """Equal segments are repeated throughout and stand for one another, so each text is sorted once; a
    segment whose anchor no other text has can't hold a window of another."""

    def run(s: Shard):
        if not len(s.length):
            return (np.empty(0, np.int64),) * 3
        cls, times, first = _classes(s)
        copied = times[cls] > 1
        out = [(s.doc[copied], s.place[copied], s.place[copied] + s.length[copied])]
        _, anchor, texts = np.unique(s.anchor[first], return_inverse=True, return_counts=True)
        take = first[texts[anchor] > 1]
        if len(take):
            length = s.length[take]
            end = np.cumsum(length)
            start = end - length
            seg = np.repeat(np.arange(len(take)), length)
            symbols = s.symbols[ragged((np.cumsum(s.length) - s.length)[take], length)]
            at = np.flatnonzero(refine(symbols, end[seg], window) >= 0)
            at = at[~copied[take[seg[at]]]]
            # windows in a row make one span
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (seg[at[1:]] != seg[at[:-1]])
            lo, hi = at[new], at[np.append(new[1:], True)[: len(at)]]
            mine = take[seg[lo]]
            base = s.place[mine] - start[seg[lo]]
            out.append((s.doc[mine], base + lo, base + hi + window))
        return tuple(map(np.concatenate, zip(*out)))

    return run


def _read(batches):
    for b in batches:
        for doc, raw in zip(b.column("doc_id").to_pylist(), b.column("raw").to_pylist()):
            symbols = np.frombuffer(raw or b"", np.uint8)
            yield doc, _VALUES[symbols], symbols


def _send(window: int, anchor: int, how: Plan):
    def run(batches):
        sender = Sender(window, anchor, how, False, CHUNK)
        for row in _read(batches):
            yield from sender.add(*row)
        yield from sender.flush()
        trim()

    return run


def repeated_byte_spans(spark: SparkSession, docs: DataFrame, scratch: Scratch, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, spans): the byte spans to remove, a list of int64 pairs as bytes from each shard."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw")).where("doc_id is not null")
    how = plan(texts, scratch, _read, window, anchor, False, CHUNK, parts(spark) * SHARDS_PER_PARTITION)
    sent = texts.mapInArrow(_send(window, anchor, how), "shard int, blob binary")
    met = sent.repartition(parts(spark), "shard").sortWithinPartitions("shard")
    return met.mapInArrow(by_shard(_judge(window)), "doc_id long, spans binary")


def _finish(batches):
    for b in batches:
        rows = []
        for doc, raw, blobs in zip(b.column("doc_id").to_pylist(), b.column("raw").to_pylist(), b.column("blobs").to_pylist()):
            raw, spans = raw or b"", union(blobs)
            digest, at = hashlib.sha256(), 0
            for lo, hi in spans.tolist():
                digest.update(raw[at:lo])
                at = hi
            digest.update(raw[at:])
            rows.append((doc, len(raw), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), digest.hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_bytes(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    scratch = Scratch(spark, "suffix")
    spans = scratch.save(repeated_byte_spans(spark, docs, scratch, window), "spans")
    lists = spans.groupBy(F.col("doc_id").alias("__d")).agg(F.collect_list("spans").alias("blobs"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw"))
    out = texts.join(lists, F.col("doc_id") == F.col("__d"), "left").select("doc_id", "raw", "blobs")
    return out.mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
