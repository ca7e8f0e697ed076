"""Helpers shared by the training-data operators: words, scratch tables, connected components."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Only a local session may go without the setting; it then gets a temporary folder.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="gridlake-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


class Scratch:
    """Parquet tables in the shared folder that cut lineage between the steps of one operator call.

    A written table outlives any executor, so a lost task is read again rather than recomputed from
    the start. Tables are dropped as soon as a later step has replaced them, or by ``release``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n = spark, 0
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.release)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        # small row groups: a writer holds one, and a task may write beside Python workers
        df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
        trim_driver(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._delete(getattr(df, "scratch_path", None))

    def release(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str | None) -> None:
        if not path:
            return
        if path.startswith(("file:", "/")):
            shutil.rmtree(re.sub(r"^file:/*", "/", path), ignore_errors=True)
            return
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; the folder is the cluster's to clean
            return


def trim() -> None:
    """Give free memory back to the system: workers wait for their next task with what they once held."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Seconds that pass at least between two rounds of ``trim_driver``.
TRIM_EVERY = 3.0
_trimmed = 0.0


def trim_driver(spark: SparkSession) -> str | None:
    """Give the driver's free memory back to the system; what its JVM said, or None if it wasn't asked.

    A long session plans and compiles much that is soon done with. The heap shrinks when it is
    collected, and Spark then removes the shuffles and broadcasts of finished steps; the native memory
    that the compilers have freed stays with the process until it is trimmed.
    """
    global _trimmed
    if time.monotonic() - _trimmed < TRIM_EVERY:
        return None
    said = None
    try:
        jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        jvm.java.lang.System.gc()
        # through reflection, as the bean's own class is not open to py4j
        kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        array = lambda kind, *x: _fill(gateway.new_array(kind, len(x)), x)
        lang = jvm.java.lang
        invoke = lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(lang.Class, *map(lang.Class.forName, kinds)))
        bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        call = array(lang.Object, bean, "systemTrimNativeHeap", array(lang.Object), array(lang.String))
        said = invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), call)
    except Exception:  # another JVM or C library, which has no such command
        pass
    trim()
    _trimmed = time.monotonic()
    return said


def _fill(array, values):
    for i, x in enumerate(values):
        array[i] = x
    return array


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Random 64-bit values for each byte at each of 64 places in a word.
PLACES = 64
_BYTES = np.random.default_rng(23).integers(0, 2**64, PLACES * 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that are hashed at once.
HASH_BYTES = 1 << 18


def _word_hashes(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in adjacent texts, and the number of words before each text and in all.

    A word's hash is the sum of its bytes' values at their places, mixed with its length.
    """
    inside = (b != 32) & ((b < 9) | (b > 13))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(b)]
    first[heads] = inside[heads]
    at = np.flatnonzero(inside)
    start = np.flatnonzero(first)
    before = np.searchsorted(start, offsets)
    if not len(start):
        return np.empty(0, np.uint64), before
    word = np.searchsorted(at, start)
    length = np.diff(word, append=len(at))
    place = np.arange(len(at)) - np.repeat(word, length)
    cell = ((place & (PLACES - 1)) << 8) | b[at]
    value = _BYTES[cell]
    if length.max() > PLACES:
        value = value * (2 * mix64((place // PLACES).astype(np.uint64)) + np.uint64(1))
    return mix64(np.add.reduceat(value, word) ^ (length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), before


def hashed_words(texts: pa.Array, lower: bool = False):
    """The hashes of the words of each text of a column, in order; null has none. ``lower``: A-Z count as a-z."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if offsets[-1] else np.empty(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + HASH_BYTES, side="right")) - 1)
        raw = data[offsets[lo] : offsets[hi]]
        if len(raw) <= HASH_BYTES:
            h, before = _word_hashes(_LOWER[raw] if lower else raw, offsets[lo : hi + 1] - offsets[lo])
            for x, y in zip(before[:-1].tolist(), before[1:].tolist()):
                yield h[x:y]
        else:  # one long text, in pieces that end between words
            parts, at = [], 0
            while at < len(raw):
                end = min(len(raw), at + HASH_BYTES)
                while end < len(raw) and not _blank(raw[end - 1]):
                    ahead = raw[end : end + HASH_BYTES]
                    gap = np.flatnonzero((ahead == 32) | ((ahead >= 9) & (ahead <= 13)))
                    end += int(gap[0]) + 1 if len(gap) else len(ahead)
                piece = raw[at:end]
                parts.append(_word_hashes(_LOWER[piece] if lower else piece, np.array([0, len(piece)]))[0])
                at = end
            yield np.concatenate(parts)
        lo = hi


def _blank(c) -> bool:
    return c == 32 or 9 <= c <= 13


def byte_words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8: split() cuts bytes at ASCII white space alone."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive 64-bit hash of every k consecutive symbols of h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        out ^= out >> np.uint64(29)
    return mix64(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive elements, by doubling."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def groups(batches, key: str):
    """From key-sorted Arrow batches, one Arrow table for each run of equal keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(k[1:] != k[:-1]) + 1
        lo = 0
        for hi in [*cut.tolist(), len(k)]:
            if held and k[lo] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = k[lo]
            held.append(b.slice(lo, hi - lo))
            lo = hi
    if held:
        yield last, pa.Table.from_batches(held)


class Forest:
    """Union-find whose root is the smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x] = r
            x = p
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True


def _contract(batches):
    """Edges of one task, as stars of the components they make: at most one row for each vertex."""
    seen, forest = 0, Forest()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            forest.join(x, y)
        seen += b.num_rows
        if len(forest.up) > 1_000_000:
            yield _stars(forest)
            forest = Forest()
    yield _stars(forest)


def _stars(forest: Forest) -> pa.RecordBatch:
    pairs = [(x, forest.root(x)) for x in list(forest.up)]
    pairs = [p for p in pairs if p[0] != p[1]]
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])


#: Edges that one task connects by itself, whatever the input's size.
FEW_EDGES = 200_000


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, few: int = FEW_EDGES) -> DataFrame:
    """(id, component) for every vertex of ``edges`` (two long columns, any direction, repeats allowed).

    The component is its smallest vertex. Each task contracts its own edges; at most ``few`` that are
    left are connected by one task, as rounds of joins would keep the driver busy with plans and
    tasks of a few rows. More are connected by rounds.
    """
    u, v = edges.columns[:2]
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v and u is not null and v is not null")
    e = scratch.save(e.mapInArrow(_contract, "u long, v long").distinct(), "edges")
    if e.count() <= few:
        stars = scratch.save(e.repartition(1).mapInArrow(_contract, "u long, v long"), "stars")
        scratch.drop(e)
    else:
        stars = _alternate(e, scratch)
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _alternate(e: DataFrame, scratch: Scratch, rounds: int = 40) -> DataFrame:
    """Stars of the components of (u, v), by large-star and small-star steps in turn.

    They need a number of rounds logarithmic in the longest path; every round is an aggregation and a
    join on the vertex and its edges are written out, so no step gathers a component in one task.
    """
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = scratch.save(small, "round")
        scratch.drop(e)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            return e
        seen = tuple(now)
    raise RuntimeError("components did not settle")
