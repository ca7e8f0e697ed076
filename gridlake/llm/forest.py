"""MinHash near-dedup by an LSH forest.

A document's set holds its distinct 5-word shingles (words lower-cased in A-Z; a shorter text is one
shingle). Documents with equal sets are one class, stood for by its smallest doc_id. Each tree of
the forest orders the classes by a sequence of min-hashes. Neighbours by longest common prefix are
candidates: a region of classes with a common prefix is taken whole if it is small, else one level
deeper, and at the last level in runs of the sorted order, which goes on with the signature's other
hashes so that the closest classes are neighbours. In a region, pairs whose sketches agree enough to
reach the threshold with a wide margin are linked by a spanning forest.

What the candidate links connect is then verified on full sets: each small candidate cluster is
brought together once; the members of a larger one meet in their regions, tree by tree. So hot
groups are split into bounded blocks and no block emits all its pairs. Sorted orders are
range-partitioned, so a hot region spreads over tasks.

Classes of a region that was not taken whole (too large, or at the edge of a task) have not all met.
They get an exact join: sets that reach the threshold share one of their rarest shingles, as many
as the threshold lets a set lack, plus one. Those that share such a shingle and are not yet connected
meet in blocks of at most two squares of about SQUARE sets. Rows of this join grow with the square
of such a group only as far as its members are unconnected, divided by SQUARE.

Null or empty text, or white space only, has an empty set: ``n_shingles`` 0, linked with nothing.
Repeated rows are the same document. Rows that share a doc_id but not the text are the same vertex
(the largest set's size is reported); they stay or go together. Rows with a null doc_id can't be told
apart by it: ``near_duplicates`` gives one row for them, linked with nothing, and ``keep_first`` keeps
them all. An empty table gives an empty result. Very long texts are read
whole; one text's set must fit in memory. Extra columns are ignored.

Chance of a miss: a pair at Jaccard 0.85 shares a tree's first 3 levels with probability 0.61, so
16 trees miss it with probability 3e-7. The one sketch, which all trees share, hides it with probability
1e-9 more. Both hold for independent min-hashes. The trees, the shallowest level and the sketches' cut follow
from the threshold, so that a pair at 0.80 is missed no oftener (21 trees).
"""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, Scratch, components, groups, hashed_words, mix64, parts, trim, window_hash

SHINGLE = 5
THRESHOLD = (85, 100)
#: Prefix lengths at which a region is taken whole if it is small enough; the first is the longest of
#: these that needs no more trees than MOST.
SHALLOW, DEEPER, MOST = (3, 2, 1), (5, 8), 24
#: The chance that a pair at the threshold shares the first prefix in no tree.
MISS = 3e-7
REGION = 256
CLUSTER = 256
#: Sets on each side of a block of the exact join.
SQUARE = 256
#: Shingles are counted in 2**COUNTERS cells to tell the rare ones; a shared cell costs time only.
COUNTERS = 18
#: The chance that the 4-bit sketches of a pair at the threshold agree too little to make it a candidate.
SKETCH_MISS = 1e-9


class Plan(NamedTuple):
    trees: int
    depths: tuple[int, ...]
    cut: int  # pairs whose sketches agree in fewer places are not candidates


def plan(num: int, den: int) -> Plan:
    """What finds the pairs at Jaccard num / den with the chances of a miss above."""
    if not 0 < num <= den:
        raise ValueError("the threshold must be above 0 and at most 1")
    j = num / den
    for first in SHALLOW:
        trees = 1 if num == den else math.ceil(math.log(MISS) / math.log1p(-(j**first)))
        if trees <= MOST:
            break
    n, p = trees * DEEPER[-1], (1 + 15 * j) / 16
    cut, below = 0, (1 - p) ** n  # below: the chance of at most ``cut`` agreements
    while below <= SKETCH_MISS and cut < n:
        cut += 1
        below += math.comb(n, cut) * p**cut * (1 - p) ** (n - cut)
    return Plan(trees, (first, *DEEPER), cut)


def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1)


def shingle_sets(texts: pa.Array):
    """Sorted distinct 64-bit hashes of each text's set."""
    for h in hashed_words(texts, lower=True):
        yield np.unique(window_hash(h, min(SHINGLE, len(h))) ^ np.uint64(min(SHINGLE, len(h)))) if len(h) else h


def minhash(s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Minima of the set under odd multipliers; half of them read a hash's upper 32 bits, half its lower."""
    out = np.full(len(seeds), 2**32 - 1, np.uint32)
    half = len(seeds) // 2
    for lo in range(0, len(s), 512):
        x = s[lo : lo + 512]
        for at, bits in ((slice(half), x >> np.uint64(32)), (slice(half, None), x)):
            np.minimum(out[at], (seeds[at, None] * bits.astype(np.uint32)).min(1), out=out[at])
    return out.astype(np.uint64)


def _sketch(plan: Plan):
    def run(batches):
        seeds = _seeds(plan.trees * plan.depths[-1])
        for b in batches:
            cols: list[list] = [[] for _ in range(4 + len(plan.depths))]
            for doc, s in zip(b.column("doc_id").to_pylist(), shingle_sets(b.column("text"))):
                row = [doc, len(s), None, None] + [None] * len(plan.depths)
                if len(s):
                    m = mix64(minhash(s, seeds)).reshape(plan.trees, plan.depths[-1])
                    nibble = (m.reshape(-1) & np.uint64(15)).astype(np.uint8)
                    row[2] = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    row[3] = (nibble[0::2] | (nibble[1::2] << 4)).tobytes()
                    h = np.arange(plan.trees, dtype=np.uint64)
                    at = 0
                    for k, d in enumerate(plan.depths):
                        for i in range(at, d):
                            h = mix64(h ^ m[:, i]) + np.uint64(d)
                        at = d
                        row[4 + k] = h.view(np.int64).tolist()
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()] + [pa.list_(pa.int64())] * len(plan.depths)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n", "digest", "sketch", *[f"p{d}" for d in plan.depths]])
        trim()

    return run


def _regions(batches, depths: tuple[int, ...]):
    """Blocks of the sorted order: yields (ids, sketches, block key), and (ids, None, 0) for regions not taken whole."""
    names = [f"k{d}" for d in depths]

    def cut(keys: list[np.ndarray], lo: int, hi: int, level: int):
        if hi - lo <= REGION:
            yield lo, hi
        elif level + 1 < len(keys):
            k = keys[level + 1][lo:hi]
            edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), hi - lo]
            for a, b in zip(edges, edges[1:]):
                yield from cut(keys, lo + a, lo + b, level + 1)
        else:
            for a in range(lo, hi, REGION):
                yield a, min(hi, a + REGION)

    found = groups(batches, names[0])
    region, first = next(found, None), True
    while region:
        (key, t), region = region, next(found, None)
        # the first and last region of a task may go on in another one
        if first or not region or t.num_rows > REGION:
            yield t.column("doc_id").to_numpy(), None, 0
        first = False
        if t.num_rows < 2:
            continue
        keys = [t.column(c).to_numpy() for c in names]
        ids = t.column("doc_id").to_numpy()
        raw = np.stack([np.frombuffer(x, np.uint8) for x in t.column("sketch").to_pylist()])
        raw = np.hstack([raw & 15, raw >> 4])
        for lo, hi in cut(keys, 0, t.num_rows, 0):
            if hi - lo >= 2:
                block = mix64(np.array([key], np.int64).view(np.uint64) ^ mix64(np.array([ids[lo]], np.int64).view(np.uint64)))
                yield ids[lo:hi], raw[lo:hi], int(block.view(np.int64)[0])


def _candidates(plan: Plan):
    """A spanning forest of each block's likely links: (a, b, block); (a, a, 0) for classes that have not met all of their region."""

    def run(batches):
        rows: list[tuple] = []
        for ids, raw, block in _regions(batches, plan.depths):
            if raw is None:
                for lo in range(0, len(ids), 20_000):
                    part = pa.array(ids[lo : lo + 20_000], pa.int64())
                    yield pa.RecordBatch.from_arrays([part, part, pa.array(np.zeros(len(part), np.int64))], ["a", "b", "block"])
                continue
            n = len(ids)
            same = np.zeros((n, n))
            for i in range(n - 1):
                same[i, i + 1 :] = (raw[i] == raw[i + 1 :]).sum(1)
            i, j = np.nonzero(np.triu(same >= plan.cut, 1))
            order = np.argsort(-same[i, j], kind="stable")
            forest, apart = Forest(), n - 1
            for a, b in zip(ids[i[order]].tolist(), ids[j[order]].tolist()):
                if forest.join(a, b):
                    rows.append((min(a, b), max(a, b), block))
                    apart -= 1
                    if not apart:
                        break
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["a", "b", "block"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["a", "b", "block"])

    return run


def _sets(batches):
    """Each document's set once for each block it belongs to."""
    for b in batches:
        block, doc, sets = [], [], []
        for d, s, blocks in zip(b.column("doc_id").to_pylist(), shingle_sets(b.column("text")), b.column("blocks").to_pylist()):
            s = s.tobytes()
            for x in blocks:
                block.append(x)
                doc.append(d)
                sets.append(s)
            if sum(map(len, sets)) > 32_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(doc, pa.int64()), pa.array(sets, pa.binary())], ["block", "doc_id", "s"])
                block, doc, sets = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(doc, pa.int64()), pa.array(sets, pa.binary())], ["block", "doc_id", "s"])


def _linked(ids: list[int], sets: list[np.ndarray], num: int, den: int) -> Forest:
    """The links among whole sets: den * |intersection| >= num * |union|."""
    forest, n = Forest(), len(ids)
    size = np.array([len(s) for s in sets])
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if den * common >= num * (size.sum() - common):
            forest.join(*ids)
        return forest
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[at] > 1
    place = np.cumsum(count > 1) - 1
    row, col = owner[shared], place[at[shared]]
    common = np.zeros((n, n), np.float32)
    for lo in range(0, int(col.max()) + 1 if len(col) else 0, 8192):
        hit = (col >= lo) & (col < lo + 8192)
        m = np.zeros((n, min(8192, int(col.max()) + 1 - lo)), np.float32)
        m[row[hit], col[hit] - lo] = 1
        common += m @ m.T
    common = np.rint(common).astype(np.int64)
    i, j = np.nonzero(np.triu(den * common >= num * (size[:, None] + size[None] - common), 1))
    for a, b in zip(i.tolist(), j.tolist()):
        forest.join(ids[a], ids[b])
    return forest


def _verify(num: int, den: int):
    def run(batches):
        out: list[tuple[int, int]] = []
        for _, t in groups(batches, "block"):
            # a doc_id has several sets if its rows' texts differ
            seen = sorted(set(zip(t.column("doc_id").to_pylist(), t.column("s").to_pylist())))
            if len(seen) > 1:
                forest = _linked([i for i, _ in seen], [np.frombuffer(s, np.uint64) for _, s in seen], num, den)
                out += [(x, forest.root(x)) for x in forest.up if forest.root(x) != x]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
        trim()

    return run


def _whole_sets(batches):
    for b in batches:
        docs, sets, held = [], [], 0
        for d, s in zip(b.column("doc_id").to_pylist(), shingle_sets(b.column("text"))):
            docs.append(d)
            sets.append(s.tobytes())
            held += len(sets[-1])
            if held > 32_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sets, pa.binary())], ["doc_id", "s"])
                docs, sets, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sets, pa.binary())], ["doc_id", "s"])


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - COUNTERS)).astype(np.int64)


def _count(batches):
    """How often the shingles of each cell were met in this task."""
    total = np.zeros(1 << COUNTERS, np.int64)
    for b in batches:
        for s in b.column("s").to_pylist():
            np.add.at(total, _cells(np.frombuffer(s, np.uint64)), 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])


def _rarest(times: np.ndarray, num: int, den: int):
    """The rarest shingles of each set, of which sets that reach the threshold share one."""

    def run(batches):
        for b in batches:
            ids, of, out = [], [], []
            for d, c, raw in zip(b.column("doc_id").to_pylist(), b.column("component").to_pylist(), b.column("s").to_pylist()):
                s = np.frombuffer(raw, np.uint64)
                if len(s):
                    # links have at least ceil(num * n / den) shingles in common
                    rare = s[np.lexsort((s, times[_cells(s)]))[: len(s) + num * len(s) // -den + 1]]
                    ids.append(np.full(len(rare), d, np.int64))
                    of.append(np.full(len(rare), c, np.int64))
                    out.append(rare.view(np.int64))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out, ids, of)], ["shingle", "id", "component"])

    return run


def _exact_links(spark: SparkSession, scratch: Scratch, unmet: DataFrame, verified: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links that connect classes of ``unmet`` (doc_id, text) which ``verified`` leaves apart, by an exact join."""
    of = components(spark, verified, scratch).withColumnRenamed("id", "doc_id")
    sets = unmet.mapInArrow(_whole_sets, "doc_id long, s binary").distinct()
    sets = sets.join(of, "doc_id", "left").select("doc_id", "s", F.coalesce("component", "doc_id").alias("component"))
    sets = scratch.save(sets, "unmet")
    times = np.zeros(1 << COUNTERS, np.int64)
    # at most a row for each cell, as two columns of numbers in one job
    counted = sets.select("s").mapInArrow(_count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    times[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    rare = scratch.save(sets.mapInArrow(_rarest(times, *threshold), "shingle long, id long, component long").distinct(), "rare")
    # under each shingle its largest component is cut into squares, and the other sets into others
    ids = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"ids{k}") for k in (0, 1)]
    held = rare.groupBy("shingle", "component").agg(F.count("*").alias("n"), *ids).groupBy("shingle")
    held = held.agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"), F.bit_xor("ids0").alias("ids0"), F.bit_xor("ids1").alias("ids1")).where("n > most.n")
    # shingles of one passage are often held by the same sets, which need to meet under one of them alone
    held = held.groupBy("most", "n", "ids0", "ids1").agg(F.min("shingle").alias("shingle"))
    squares = lambda n: F.ceil(n / SQUARE).cast("long")
    held = held.select("shingle", F.col("most.component").alias("main"), squares(F.col("most.n")).alias("mains"), squares(F.col("n") - F.col("most.n")).alias("rest"))
    held = scratch.save(held, "held")  # read twice below
    at = rare.join(held, "shingle").withColumn("is_main", F.col("component") == F.col("main"))
    at = at.withColumn("square", F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("rest"))))
    at = at.withColumn("square", F.when(F.col("is_main"), F.col("rest") + F.col("square")).otherwise(F.col("square")))
    # squares of the largest component meet those of the rest alone, which meet all
    others = F.sequence(F.lit(0).cast("long"), F.col("rest") + F.when(F.col("is_main"), F.lit(0)).otherwise(F.col("mains")) - 1)
    at = at.select("id", "component", "shingle", "square", F.explode(others).alias("other")).where("square <> other")
    at = at.select("id", "component", F.xxhash64("shingle", F.least("square", "other"), F.greatest("square", "other")).alias("block"))
    blocks = at.groupBy("block").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("block")
    wanted = at.join(blocks, "block").groupBy("id").agg(F.collect_set("block").alias("blocks"))
    met = sets.join(wanted, F.col("doc_id") == F.col("id")).select(F.explode("blocks").alias("block"), "doc_id", "s")
    met = met.repartition(parts(spark) * 2, "block").sortWithinPartitions("block")
    return scratch.save(met.mapInArrow(_verify(*threshold), "a long, b long"), "exact")


def near_duplicates(spark: SparkSession, docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    scratch, how = Scratch(spark, "forest"), plan(*threshold)
    depths = how.depths
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id long, n long, digest binary, sketch binary, " + ", ".join(f"p{d} array<long>" for d in depths)
    sketches = scratch.save(docs.mapInArrow(_sketch(how), kinds), "sketches")
    usable = sketches.where("n > 0 and doc_id is not null")
    classes = scratch.save(usable.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    one = classes.select(F.col("digest").alias("d"), "rep")
    reps = usable.join(one, (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("rep"))).dropDuplicates(["digest"])
    trees = F.arrays_zip(*[F.col(f"p{d}").alias(f"k{d}") for d in depths])
    # past the deepest prefix a tree's order goes on with the signature, from the next tree's hashes around
    turn = (F.col("pos") + 1) * (depths[-1] // 2)
    turned = F.concat(F.substring(F.col("sketch"), turn + 1, F.length("sketch")), F.substring(F.col("sketch"), F.lit(1), turn)).alias("sketch")
    keys = [f"k{d}" for d in depths] + ["sketch"]
    order = reps.select("doc_id", "sketch", F.posexplode(trees)).select("doc_id", turned, "col.*")
    order = order.repartitionByRange(parts(spark) * 2, *keys).sortWithinPartitions(*keys, "doc_id")
    found = scratch.save(order.mapInArrow(_candidates(how), "a long, b long, block long"), "candidates")
    links, unmet = found.where("a <> b"), found.where("a = b").select(F.col("a").alias("id")).distinct()

    cluster = scratch.save(components(spark, links, scratch), "clusters")
    size = cluster.groupBy("component").agg(F.count("*").alias("members"))
    member = cluster.join(size, "component")
    whole = member.where(F.col("members") <= CLUSTER).select("id", F.col("component").alias("block"))
    ends = links.select(F.explode(F.array("a", "b")).alias("id"), "block").distinct()
    split = ends.join(member.where(F.col("members") > CLUSTER).select("id"), "id").select("id", "block")
    # a cluster's number and a region's hash are kept apart by their sign
    blocks = whole.select("id", F.col("block")).unionByName(split.select("id", (F.abs(F.col("block")) * -1 - 1).alias("block")))
    wanted = blocks.groupBy("id").agg(F.collect_list("block").alias("blocks"))
    wanted = wanted.join(unmet.withColumn("unmet", F.lit(True)), "id", "full")
    # the texts are read and joined once, for the blocks and for the exact join
    texts = scratch.save(docs.join(wanted.withColumnRenamed("id", "doc_id"), "doc_id"), "texts")
    sets = texts.where("blocks is not null").select("doc_id", "text", "blocks").mapInArrow(_sets, "block long, doc_id long, s binary")
    met = sets.repartition(parts(spark) * 2, "block").sortWithinPartitions("block")
    verified = scratch.save(met.mapInArrow(_verify(*threshold), "a long, b long"), "links")

    exact = _exact_links(spark, scratch, texts.where("unmet").select("doc_id", "text"), verified, threshold)
    of = components(spark, verified.unionByName(exact), scratch).select(F.col("id").alias("rep"), "component")
    of = classes.join(of, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    named = F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")
    out = sketches.select("doc_id", "n", named).join(of, "digest", "left")
    return out.groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min(F.coalesce("component", "doc_id")).alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def _set_digest(text: str | None) -> bytes:
    return hashlib.blake2b(next(shingle_sets(pa.array([text], pa.string()))).tobytes(), digest_size=16).digest()


def keep_first(spark: SparkSession, docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stand for their group (the smallest doc_id), with their columns.

    Of rows with one doc_id and equal sets, one with the least text stays; rows of one doc_id whose
    sets differ all stay, and so do all rows with a null doc_id.
    """
    scratch = Scratch(spark, "first")
    # written out, so that neither join below holds the plan of the other or of the links
    dups = scratch.save(near_duplicates(spark, docs, threshold).where("not kept and doc_id is not null").select(F.col("doc_id").alias("__id")), "dups")
    many = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.count("*").alias("n")).where("n > 1").select("__id")
    many = scratch.save(many.join(dups, "__id", "left_anti"), "many")
    once = docs.join(dups.unionByName(many), F.col("doc_id") == F.col("__id"), "left_anti")
    again = docs.join(many, F.col("doc_id") == F.col("__id"), "left_semi")
    row = F.struct(*docs.columns).alias("row")
    again = again.select(row, F.udf(_set_digest, "binary")("text").alias("digest")).groupBy("row.doc_id", "digest")
    again = again.agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row"))
    return once.unionByName(again.select("row.*"))
