"""Cutting sequences at content-chosen anchors, so that equal windows meet in one shard.

Every window of W symbols is assigned its anchor: the k-gram in it with the least hash. Consecutive
windows with one anchor make a segment. Equal windows have equal anchors wherever they stand, so
sending each segment to the shard of its anchor's hash brings all equal windows together, and each
shard can be searched alone. A window belongs to exactly one segment.

Segments of one task that are equal throughout are sent once (the earliest by document and place);
the others are told apart by a flag or settled on the spot, so a passage copied into a third of all
documents is sent once by each task. Of first segments alone (``first_only``), one met again in the
same document at the same place is that segment, a repeated row's, and doesn't repeat it. Long sequences are worked off in pieces that overlap by W - 1,
which changes no window.

Anchors that many segments have in common would fill a shard. A first pass counts the segments of
all anchors in 2**CELL_BITS cells (``plan``), and windows then take an anchor in a crowded cell only
if they hold no other; such a window is a segment by itself whose anchor is its own hash. Any choice
that looks at a window's content alone brings equal windows together, so results don't depend on
the counts. There are several shards for each shuffle partition, and more if the symbols that the
first pass counted would overfill them; a task unpacks a shard in parts of about PART_BYTES, by anchor.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, groups, mix64, sliding_min, trim

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)

#: Segments are counted in 2**CELL_BITS cells of anchors. A cell is crowded if it has over CROWD
#: segments and over 1 / MOST_CROWDS of all, so at most MOST_CROWDS cells are, which tasks are told of.
#: Each task tells of the cells that hold over half that share of its own segments.
CELL_BITS = 22
CROWD = 20_000
SHARD_SYMBOLS = 64_000_000
PART_BYTES = 16_000_000
MOST_CROWDS = 1 << 18

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        done, step = 1, base
        while done < size:  # base**done, by doubling
            have[done : 2 * done] = have[:done] * np.uint64(step)
            step = step * step % 2**64
            done *= 2
        _powers[base] = have
    return have[:n]


class Rolling:
    """Hashes of any window of a sequence, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(BASE, n), out=self.sums[1:])
        self.back = powers(INVERSE, max(n, 1))

    def every(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix64((self.sums[k:] - self.sums[:n]) * self.back[:n])

    def at(self, start: np.ndarray, k: int) -> np.ndarray:
        return mix64((self.sums[start + k] - self.sums[start]) * self.back[start])


def cells(anchor: np.ndarray) -> np.ndarray:
    return (anchor >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def cut(values: np.ndarray, piece: np.ndarray, window: int, k: int, crowded: np.ndarray | None = None):
    """Segments of a concatenation of pieces: (start, windows, anchor hash, content key, Rolling).

    ``piece`` numbers the piece of each position; windows across pieces don't count. ``crowded`` tells
    the cells whose anchors are avoided.
    """
    n = len(values) - window + 1
    empty = np.empty(0, np.int64)
    roll = Rolling(values)
    if n <= 0:
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), roll
    bits = np.uint64(max(1, int(len(values)).bit_length()))
    grams = roll.every(k)
    rank = grams
    if crowded is not None:  # the others come first
        top = np.uint64(63)
        rank = (grams >> np.uint64(1)) | (crowded[cells(grams)].astype(np.uint64) << top)
    packed = (rank >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(packed, window - k + 1)
    valid = piece[:n] == piece[window - 1 :]
    new = least[1:] != least[:-1]
    if crowded is not None:
        alone = (least >> top).astype(bool)
        new |= alone[1:]
    first = valid.copy()
    first[1:] &= new | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= new | ~valid[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    anchor = grams[(least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)]
    if crowded is not None:
        anchor = np.where(alone[start], roll.at(start, window), anchor)
    # a segment is at most 2W - k long, so its first and last windows cover it
    key = mix64(roll.at(start, window) * np.uint64(3) + mix64(roll.at(end, window) ^ (end - start).astype(np.uint64)))
    return start, end - start + 1, anchor, key, roll


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, ..., start + length - 1 of every pair, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    out = np.ones(total, np.int64)
    ends = np.cumsum(lengths)
    out[0] = starts[0]
    out[ends[:-1]] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(out)


class Plan(NamedTuple):
    shards: int
    crowded: np.ndarray  # numbers of the cells whose anchors are avoided


class Sender:
    """Collects pieces of sequences and yields blobs for shards.

    Rows are (shard, blob): a blob holds segments as arrays of anchor, document, place, length, a
    flag (an equal segment was settled in this task) and the symbols; with ``checks`` also 32 bits of
    each window's hash, for symbols that stand for more than one value. Settled segments go as spans.
    """

    def __init__(self, window: int, k: int, plan: Plan, first_only: bool, chunk: int, checks: bool = False):
        self.window, self.k, self.shards, self.first_only, self.chunk = window, k, plan.shards, first_only, chunk
        self.checks, self.crowded = checks, None
        if len(plan.crowded):
            self.crowded = np.zeros(1 << CELL_BITS, bool)
            self.crowded[plan.crowded] = True
        self.packer = zstandard.ZstdCompressor(level=1)
        self.held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, doc: int, values: np.ndarray, symbols: np.ndarray):
        for lo in range(0, max(1, len(values) - self.window + 1), self.chunk):
            hi = lo + self.chunk + self.window - 1
            if len(values) - lo >= self.window:
                self.held.append((doc, lo, values[lo:hi], symbols[lo:hi]))
                self.size += min(len(values), hi) - lo
            if self.size >= self.chunk:
                yield from self.flush()

    def _joined(self):
        """The values, pieces and pieces' ends of what is held, which is then let go."""
        lengths = np.array([len(v) for _, _, v, _ in self.held])
        piece = np.repeat(np.arange(len(self.held)), lengths)
        values = np.concatenate([h[2] for h in self.held])
        self.last, self.held, self.size = self.held, [], 0
        return values, piece, np.cumsum(lengths) - lengths

    def flush(self):
        if not self.held:
            return
        values, piece, ends = self._joined()
        held, self.last = self.last, []
        symbols = np.concatenate([h[3] for h in held])
        offset = np.array([lo for _, lo, _, _ in held]) - ends
        docs = np.array([d for d, _, _, _ in held], np.int64)
        start, count, anchor, key, roll = cut(values, piece, self.window, self.k, self.crowded)
        if not len(start):
            return
        doc, place = docs[piece[start]], start + offset[piece[start]]
        order = np.lexsort((place, doc, key))
        again = np.zeros(len(order), bool)
        again[1:] = key[order[1:]] == key[order[:-1]]
        twice = again.copy()
        twice[:-1] |= again[1:]
        same = np.zeros(len(order), bool)
        same[1:] = again[1:] & (doc[order[1:]] == doc[order[:-1]]) & (place[order[1:]] == place[order[:-1]])
        settled, flag = order[again & ~same], np.zeros(len(order), bool)
        flag[order[twice]] = True
        send = np.sort(order[~again])
        span = settled if self.first_only else np.flatnonzero(flag)
        shard = (anchor % np.uint64(self.shards)).astype(np.int64)
        check = (roll.every(self.window) >> np.uint64(32)).astype(np.uint32) if self.checks else None
        yield from self._blobs(send, shard, anchor, doc, place, count, flag, start, symbols, span, check)

    def _blobs(self, send, shard, anchor, doc, place, count, flag, start, symbols, span, check):
        length = count + self.window - 1
        by = send[np.argsort(shard[send], kind="stable")]
        edges = np.flatnonzero(np.diff(shard[by], prepend=-1))
        rows: list[tuple[int, bytes]] = []
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(by)]):
            at = by[lo:hi]
            parts = (np.array([len(at)], np.int64), (anchor[at] >> np.uint64(32)).astype(np.uint32), doc[at], place[at].astype(np.int64), length[at].astype(np.int32), flag[at], symbols[ragged(start[at], length[at])])
            if check is not None:
                parts += (check[ragged(start[at], count[at])],)
            rows.append((int(shard[at[0]]), self.packer.compress(b"".join(p.tobytes() for p in parts))))
        if len(span):
            home = (mix64(doc[span].view(np.uint64)) % np.uint64(self.shards)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            edges = np.flatnonzero(np.diff(home[order], prepend=-1))
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(order)]):
                at = span[order[lo:hi]]
                parts = (np.array([-len(at)], np.int64), doc[at], place[at].astype(np.int64), (place[at] + length[at]).astype(np.int64))
                rows.append((int(home[order[lo]]), self.packer.compress(b"".join(p.tobytes() for p in parts))))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "blob"])


class Tally(Sender):
    """Counts, in place of blobs, the segments that a Sender would send, by cell of their anchor, and their symbols."""

    def __init__(self, window: int, k: int, first_only: bool, chunk: int):
        super().__init__(window, k, Plan(1, np.empty(0, np.int64)), first_only, chunk)
        self.n, self.symbols = np.zeros(1 << CELL_BITS, np.int64), 0

    def flush(self):
        if self.held:
            values, piece, _ = self._joined()
            _, count, anchor, key, _ = cut(values, piece, self.window, self.k)
            _, once = np.unique(key, return_index=True)
            at, n = np.unique(cells(anchor[once]), return_counts=True)
            self.n[at] += n
            self.symbols += int((count[once] + self.window - 1).sum())
        return iter(())

    def total(self) -> pa.RecordBatch:
        # a cell with over 1 / MOST_CROWDS of all segments has half that share in the tasks that tell of it
        at = np.flatnonzero(self.n > self.n.sum() // (2 * MOST_CROWDS))
        cells = np.concatenate([[-2, -1], at])
        return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.concatenate([[self.n.sum(), self.symbols], self.n[at]]))], ["cell", "n"])


def plan(texts: DataFrame, scratch: Scratch, read, window: int, k: int, first_only: bool, chunk: int, least_shards: int) -> Plan:
    """What the pass over all ``texts`` shows; ``read`` gives (doc, values, symbols) of Arrow batches."""

    def count(batches):
        tally = Tally(window, k, first_only, chunk)
        for row in read(batches):
            for _ in tally.add(*row):
                pass
        for _ in tally.flush():
            pass
        yield tally.total()
        trim()

    counts = scratch.save(texts.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "anchors")
    segments, symbols = counts.agg(*[F.sum(F.when(F.col("cell") == c, F.col("n"))) for c in (-2, -1)]).first()
    many = counts.where((F.col("cell") >= 0) & (F.col("n") > max(CROWD, (segments or 0) // MOST_CROWDS))).select("cell")
    crowded = np.array(sorted(r.cell for r in many.collect()), np.int64)
    scratch.drop(counts)
    return Plan(max(least_shards, -(-(symbols or 0) // SHARD_SYMBOLS)), crowded)


class Shard:
    """What a shard received: segments whose anchor came more than once, and settled spans."""

    def __init__(self, blobs: list[bytes], window: int = 0, part: int = 0, parts: int = 1):
        """The segments whose anchor falls to ``part``. With ``window``, the blobs hold checks of windows of that length."""
        unpack = zstandard.ZstdDecompressor().decompress
        cols: list[list[np.ndarray]] = [[] for _ in range(7)]
        spans: list[list[np.ndarray]] = [[] for _ in range(3)]
        for b in blobs:
            raw = unpack(b)
            n, at = int(np.frombuffer(raw, np.int64, 1)[0]), 8
            kinds = (np.uint32, np.int64, np.int64, np.int32, np.bool_) if n > 0 else (np.int64,) * 3
            got = []
            for kind in kinds:
                got.append(np.frombuffer(raw, kind, abs(n), at))
                at += abs(n) * np.dtype(kind).itemsize
            if n < 0:
                if not part:
                    for x, into in zip(got, spans):
                        into.append(x)
                continue
            length = got[3].astype(np.int64)
            size = int(length.sum())
            got += [np.frombuffer(raw, np.uint8, size, at), np.frombuffer(raw, np.uint32, -1 if window else 0, at + size if window else 0)]
            if parts > 1:
                mine = np.flatnonzero(got[0] % np.uint32(parts) == part)
                held, count = ragged((np.cumsum(length) - length)[mine], length[mine]), length - window + 1
                checks = got[6][ragged((np.cumsum(count) - count)[mine], count[mine])] if window else got[6]
                got = [x[mine] for x in got[:5]] + [got[5][held], checks]
            for x, into in zip(got, cols):
                into.append(x)
        join = lambda c, kind: np.concatenate(c) if c else np.empty(0, kind)
        self.spans = tuple(join(c, np.int64) for c in spans)
        anchor, doc, place, length, flag = (join(c, k) for c, k in zip(cols, (np.uint32, np.int64, np.int64, np.int32, bool)))
        symbols = join(cols[5], np.uint8)
        start = np.cumsum(length, dtype=np.int64) - length
        _, inverse, times = np.unique(anchor, return_inverse=True, return_counts=True)
        keep = np.flatnonzero(times[inverse] > 1) if len(anchor) else np.empty(0, int)
        self.anchor, self.doc, self.place, self.length, self.flag = anchor[keep], doc[keep], place[keep], length[keep].astype(np.int64), flag[keep]
        if window:
            count = length.astype(np.int64) - window + 1
            self.checks = join(cols[6], np.uint32)[ragged((np.cumsum(count) - count)[keep], count[keep])] if len(keep) else join([], np.uint32)
        self.symbols = symbols[ragged(start[keep], self.length)] if len(keep) else symbols[:0]


def spans_of(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Merged spans of each document, as one row of int64 pairs."""
    order = np.lexsort((hi, lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    out_doc, out = [], []
    for a, b in zip(np.flatnonzero(new).tolist(), [*np.flatnonzero(new)[1:].tolist(), len(doc)]):
        out_doc.append(int(doc[a]))
        out.append(merged(lo[a:b], hi[a:b]).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(out_doc, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "spans"])


def merged(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Union of half-open spans as maximal runs, shape (n, 2); touching spans make one run."""
    if not len(lo):
        return np.empty((0, 2), np.int64)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    first = np.ones(len(lo), bool)
    first[1:] = lo[1:] > hi[:-1]
    last = np.append(first[1:], True)
    return np.stack([lo[first], hi[last]], 1).astype(np.int64)


def by_shard(judge, window: int = 0):
    """A mapInArrow function: judge(Shard) gives (doc, lo, hi) to remove; settled spans are added.

    With ``window``, the blobs hold checks of windows of that length.
    """

    def run(batches):
        for _, t in groups(batches, "shard"):
            blobs = t.column("blob").to_pylist()
            parts = -(-sum(map(zstandard.frame_content_size, blobs)) // PART_BYTES)
            for part in range(parts):
                shard = Shard(blobs, window, part, parts)
                doc, lo, hi = (np.concatenate(p) for p in zip(judge(shard), shard.spans))
                if len(doc):
                    yield spans_of(doc, lo, hi)
        trim()

    return run


def union(blobs) -> np.ndarray:
    """The union of a document's spans from all shards."""
    got = [np.frombuffer(b, np.int64).reshape(-1, 2) for b in blobs or []]
    if not got:
        return np.empty((0, 2), np.int64)
    both = np.concatenate(got)
    return merged(both[:, 0], both[:, 1])
