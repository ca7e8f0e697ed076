"""Embedding near-dedup by lattice hashing.

Unit vectors are projected at random to a few 8-dimensional blocks per table and each block is
decoded to the nearest point of the E8 lattice; a vector's cell is the tuple of its points. Vectors
in one cell, or in the neighbouring cells that a vector's decoding was closest to, are candidates;
every candidate pair is verified by cosine in double precision.

Equal vectors are first collapsed into one with a count, so copies cost nothing. A pair that meets
in several cells is counted in the first of them alone, which each cell tells from the cells that
both vectors carry along; so a cell sends the numbers of links of its vectors and the tree that
connects them, never its pairs, and none is capped. A cell of more than SQUARE vectors is dealt out
as pairs of squares, each a key of its own. Vectors that are null, empty, zero or
hold null or non-finite components, link with nothing (nor do vectors of different lengths). Repeated
rows count once. Of a vec_id with several different vectors, each is a vector that the others can
link with, but not with one another; n_links is the largest of theirs, component_id the smallest. A
null vec_id gives one row, linked with nothing. An empty table gives an empty result. Extra columns are ignored.

Recall: a pair at cosine 0.95 is 0.31 apart; the chance to meet in none of the tables is measured
by the tests against brute force.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, groups, mix64, parts

TABLES = 10
BLOCKS = 2
PROBES = 2
SCALE = 0.8
#: A cell with more vectors is split into squares of about this many, each pair of squares on its own.
SQUARE = 512
#: Rows of one matrix of cosines.
STRIP = 256


def e8_decode(x: np.ndarray) -> np.ndarray:
    """Twice the nearest E8 point of each row of x (integers): the better of D8 and D8 + 1/2."""

    def d8(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        odd = (r.sum(1) % 2) != 0
        gap = y - r
        worst = np.abs(gap).argmax(1)
        rows = np.flatnonzero(odd)
        r[rows, worst[rows]] += np.where(gap[rows, worst[rows]] >= 0, 1, -1)
        return r

    a, b = d8(x), d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.rint(2 * np.where(nearer[:, None], a, b)).astype(np.int64)


def e8_roots() -> np.ndarray:
    """Twice the 240 shortest vectors of E8: the steps to the neighbouring cells."""
    out = []
    for i in range(8):
        for j in range(i):
            for s in (2, -2):
                for t in (2, -2):
                    v = [0] * 8
                    v[i], v[j] = s, t
                    out.append(v)
    out += [[1 if bits >> k & 1 else -1 for k in range(8)] for bits in range(256) if (8 - bin(bits).count("1")) % 2 == 0]
    return np.array(out, np.int64)


def _key(points: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit key of each row of integers."""
    h = np.full(len(points), (table + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for c in points.T:
        h = mix64(h ^ (c.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
    return h.view(np.int64)


def _tables(dim: int, tables: int, blocks: int, scale: float):
    """(projection to 8 * blocks dimensions, shift) of each table; the same for every task."""
    out = []
    for t in range(tables):
        rng = np.random.default_rng(1000 + t)
        a = rng.standard_normal((dim, 8 * blocks)) / scale / np.sqrt(max(dim, 1)) * np.sqrt(8)
        out.append((a, rng.uniform(0, 1, 8 * blocks)))
    return out


def cells(u: np.ndarray, tables: int, blocks: int, probes: int, scale: float):
    """For each table (home keys, probed keys [n, probes]): the cells around each unit vector."""
    roots = e8_roots()
    for t, (a, shift) in enumerate(_tables(u.shape[1], tables, blocks, scale)):
        y = u @ a + shift
        points, steps, costs = [], [], []
        for b in range(blocks):
            part = y[:, 8 * b : 8 * b + 8]
            p = e8_decode(part)
            gap = part - p / 2
            # the squared distance to the neighbour p + r/2 less that to p, |r/2|^2 being 2
            cost = 2 - 2 * (gap @ (roots / 2).T)
            best = np.argpartition(cost, probes, axis=1)[:, :probes]
            points.append(p)
            steps.append(best)
            costs.append(np.take_along_axis(cost, best, 1))
        home = np.hstack(points)
        cost = np.hstack(costs)
        order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        near = []
        for j in range(probes):
            moved = home.copy()
            for b in range(blocks):
                at = (order[:, j] // probes) == b
                pick = steps[b][at, order[at, j] % probes]
                moved[at, 8 * b : 8 * b + 8] += roots[pick]
            near.append(_key(moved, t))
        yield _key(home, t), np.stack(near, 1) if near else np.empty((len(u), 0), np.int64)


def _array(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(raw, kind).astype(float)


def _place(kind: str, tables: int, blocks: int, probes: int, scale: float):
    """Each vector with the keys of its cells, home first in each table, and 32 bits of every key as bytes."""

    def run(batches):
        for b in batches:
            raw = b.column("v")
            lists = [_array(x, kind) for x in raw.to_pylist()]
            size = np.array([len(x) for x in lists])
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                u = np.stack([lists[i] for i in at])
                u = u / np.linalg.norm(u, axis=1, keepdims=True)
                around = np.hstack([np.column_stack([home, near]) for home, near in cells(u, tables, blocks, probes, scale)]) ^ np.int64(dim)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * around.shape[1], pa.int32()), pa.array(around.ravel()))
                short = [x.tobytes() for x in _short(around)]
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(take) for c in ("cls", "id", "copies", "v")], keys, pa.array(short, pa.binary())], ["cls", "id", "copies", "v", "keys", "cells"])

    return run


def _short(keys: np.ndarray) -> np.ndarray:
    return (keys & np.int64(0xFFFFFFFF)).astype(np.uint32)


def _first_here(around: np.ndarray, a: np.ndarray, b: np.ndarray, cell: np.uint32, table: int) -> np.ndarray:
    """Of pairs of vectors that meet in ``cell``, the numbers of those for which it is the first place where they do.

    ``around``: the cells of all vectors, [vector, table, home and visited]; a, b: the pairs' vectors.
    Two vectors meet in a cell that is home to at least one of them. Tables count in order, and the
    cells of one table by their number. Cells are told apart by 32 bits, which fails for one pair in
    10 ** 8 or so: such a pair can go uncounted, which adds nothing to speak of to the misses of the
    lattice itself.
    """
    left = np.arange(len(a))
    for t in range(table):
        c = around[:, t]
        left = left[c[a[left], 0] != c[b[left], 0]]
        p, q = c[a[left]], c[b[left]]
        left = left[~((p[:, :1] == q).any(1) | (q[:, :1] == p).any(1))]
    c = around[:, table]
    p, q = c[a[left]], c[b[left]]
    at_p, at_q = (p[:, :1] == q).any(1), (q[:, :1] == p).any(1)
    return left[np.where(at_p & at_q, np.minimum(p[:, 0], q[:, 0]), np.where(at_p, p[:, 0], q[:, 0])) == cell]


def _tree(root: np.ndarray, a: np.ndarray, b: np.ndarray):
    """The pairs (a, b) that connect what ``root``, which is updated, leaves apart."""
    while True:
        apart = np.flatnonzero(root[a] != root[b])
        if not len(apart):
            return
        for k in apart[:64].tolist():
            x, y = root[a[k]], root[b[k]]
            if x != y:
                root[root == max(x, y)] = min(x, y)
                yield a[k], b[k]


def _verify(kind: str, threshold: float, tables: int, probes: int):
    """Links in a cell, or between two squares of it: (cls, a, b, links).

    Rows with a class count the vectors, copies included, that it is linked with and met here first;
    rows with ids a and b are the tree that connects the linked ones.
    """
    names = ["cls", "a", "b", "links"]

    def run(batches):
        total: dict[int, int] = {}
        edges: list[tuple[int, int]] = []

        def rows():
            n, m = [None] * len(total), [None] * len(edges)
            out = ([*total, *m], [*n, *[a for a, _ in edges]], [*n, *[b for _, b in edges]], [*total.values(), *m])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

        for _, t in groups(batches, "block"):
            cell, table = t.column("cell")[0].as_py(), t.column("tab")[0].as_py()
            probe = t.column("probe").to_numpy(zero_copy_only=False)
            if t.num_rows < 2 or probe.all():
                continue
            square, other = t.column("square").to_numpy(), t.column("other").to_numpy()
            cls, ids, copies = (t.column(c).to_numpy() for c in ("cls", "id", "copies"))
            around = np.stack([np.frombuffer(x, np.uint32).reshape(tables, 1 + probes) for x in t.column("cells").to_pylist()])
            x = np.stack([_array(v, kind) for v in t.column("v").to_pylist()])
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            one = square[0] == other[0]
            # within one square every pair once; of two, the pairs across
            left = np.arange(len(ids)) if one else np.flatnonzero(square < other)
            right = left if one else np.flatnonzero(square > other)
            n, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for lo in range(0, len(left), STRIP):
                strip = left[lo : lo + STRIP]
                i, j = np.nonzero(x[strip] @ x[right].T >= threshold)
                i, j = strip[i], right[j]
                ok = ~(probe[i] & probe[j]) & (ids[i] != ids[j])
                if one:
                    ok &= i < j
                i, j = i[ok], j[ok]
                for cut in range(0, len(i), 65_536):
                    a, b = i[cut : cut + 65_536], j[cut : cut + 65_536]
                    new = _first_here(around, a, b, _short(np.array([cell]))[0], table)
                    a, b = a[new], b[new]
                    np.add.at(n, a, copies[b])
                    np.add.at(n, b, copies[a])
                    edges += [(int(ids[p]), int(ids[q])) for p, q in _tree(root, a, b)]
            for k in np.flatnonzero(n).tolist():
                key = int(cls[k])
                total[key] = total.get(key, 0) + int(n[k])
            if len(total) + len(edges) > 100_000:
                yield rows()
                total.clear()
                edges.clear()
        if total or edges:
            yield rows()

    return run


def _dealt(around: DataFrame, probes: int, scratch: Scratch) -> DataFrame:
    """A row for each vector and cell, and in crowded cells for each pair of squares that it belongs to.

    ``block`` is the key of a cell, or of a square of it (``square`` = ``other``) or pair of squares.
    """
    crowd = around.select(F.explode("keys").alias("c")).groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") > SQUARE)
    crowd = scratch.save(crowd.select("c", F.ceil(F.col("n") / SQUARE).cast("int").alias("squares")), "crowd")
    got = around.select("cls", "id", "copies", "v", "cells", F.posexplode("keys").alias("pos", "cell"))
    got = got.join(crowd, F.col("cell") == F.col("c"), "left").withColumn("squares", F.coalesce("squares", F.lit(1)))
    got = got.withColumn("square", F.pmod(F.xxhash64("cls"), F.col("squares")).cast("int"))
    got = got.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("squares") - 1)))
    pair = F.xxhash64("cell", F.least("square", "other"), F.greatest("square", "other"))
    width = 1 + probes
    return got.select(
        F.when(F.col("squares") == 1, F.col("cell")).otherwise(pair).alias("block"), "cell", F.floor(F.col("pos") / width).cast("int").alias("tab"),
        (F.col("pos") % width > 0).alias("probe"), "square", "other", "cls", "id", "copies", "cells", "v",
    )


def _clean(kind: str):
    """Vectors as bytes of their own type; null for those that link with nothing."""

    def run(batches):
        for b in batches:
            out = []
            for v in b.column("v").to_pylist():
                x = np.array(v, float) if v and None not in v else None
                out.append(x.astype(kind).tobytes() if x is not None and np.isfinite(x).all() and 0 < np.linalg.norm(x) < np.inf else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "v"])

    return run


def vector_links(spark: SparkSession, table: DataFrame, threshold: float, scratch: Scratch, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE) -> tuple[DataFrame, DataFrame]:
    """(vectors: vec_id, v and its class: id, copies, cls; links as ``_verify`` gives them)."""
    # floats stay floats on the way; the cosine is computed in double either way
    kind = "<f4" if table.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    vectors = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    vectors = vectors.mapInArrow(_clean(kind), "vec_id long, v binary").distinct()
    vectors = scratch.save(vectors, "vectors")
    usable = vectors.where("v is not null and vec_id is not null")
    reps = usable.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    # numbers written once with their rows; two classes can have one id if its rows' vectors differ
    reps = scratch.save(reps.withColumn("cls", F.monotonically_increasing_id()), "classes")
    around = reps.select("cls", "id", "copies", "v").mapInArrow(_place(kind, tables, blocks, probes, scale), "cls long, id long, copies long, v binary, keys array<long>, cells binary")
    around = scratch.save(around, "cells")
    meet = _dealt(around, probes, scratch).repartition(parts(spark) * 2, "block").sortWithinPartitions("block")
    links = scratch.save(meet.mapInArrow(_verify(kind, threshold, tables, probes), "cls long, a long, b long, links long"), "links")
    return vectors.join(reps, "v", "left"), links


def embedding_near_dups(spark: SparkSession, table: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector of ``table`` (vec_id, embedding)."""
    scratch = Scratch(spark, "lattice")
    vectors, links = vector_links(spark, table, threshold, scratch)
    degree = links.where("cls is not null").groupBy("cls").agg(F.sum("links").alias("others"))
    of = components(spark, links.where("cls is null").select("a", "b"), scratch)
    out = vectors.join(degree, "cls", "left").join(of, "id", "left")
    out = out.select(
        "vec_id",
        (F.coalesce("others", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.coalesce("component", "id", "vec_id").alias("component_id"),
    )
    out = out.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
