"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a hash and laid end to end; the stream is cut into blocks
of equally many words. Slots 0, 1, 2, ... take the points frac((n + 1/2) / golden ratio), which are
mapped through the sources' cumulative weights; the slots of one source are ranked, and the slot of
rank r takes block r of that source, starting over after the last. A document's share is what the
taken blocks cover of it.

Every prefix sum runs over hash buckets of bounded size and then over the buckets' totals, so a
source with a third of all rows is never in one task. The driver holds one row for each source, of
which there may be MAX_SOURCES with names of MAX_NAME_BYTES in all; what is broadcast is in
proportion to these rows.

Sources are ordered by code point with null last. Null text has 0 words; such a document, like any
without words, is taken 0 times. Repeated rows, and rows that share a doc_id or have none, are
separate documents; ``mixture`` gives each row its own share. An empty table gives an empty result;
if no document has words all targets are 0. Extra columns are ignored by ``mix`` and kept by
``mixture``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
GOLDEN = (math.sqrt(5) - 1) / 2
#: A source is cut into about this many blocks, of at most MAX_BLOCK words each.
BLOCKS_PER_SOURCE = 512
MAX_BLOCK = 2048
#: Rows of one prefix-sum bucket and slots of one schedule chunk, on average.
BUCKET_ROWS = 1024
MAX_SOURCES = 100_000
MAX_NAME_BYTES = 64_000_000
#: A number for each row of ``mixture``'s input, under a name that no column has.
ROW = "__mixture_row"


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def targets(sizes: dict, weights: dict, total: float, most: float = MOST_EPOCHS) -> dict:
    """Shares of ``total`` by weight, none above ``most`` times the source's size.

    What a capped source can't take is reshared among the others by weight, until none is above.
    """
    out, open_, left = {}, {s for s in sizes if weights[s] > 0}, float(total)
    while open_:
        each = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if weights[s] * each > most * sizes[s]]
        if not over:
            return out | {s: weights[s] * each for s in open_} | {s: 0.0 for s in sizes if s not in open_ and s not in out}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            open_.discard(s)
    return out | {s: 0.0 for s in sizes if s not in out}


def _plan(spark: SparkSession, docs: DataFrame, weights, share: float, scratch: Scratch) -> DataFrame:
    """source_no, source, source_size, target, block (words), n_blocks: one row for each source."""
    sources = scratch.save(docs.groupBy("source").agg(F.sum("size").alias("n")), "sources")
    many, names = sources.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    if many > MAX_SOURCES or names > MAX_NAME_BYTES:
        raise ValueError(f"more than {MAX_SOURCES} sources, or names of more than {MAX_NAME_BYTES} bytes")
    got = sources.collect()
    got.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = {i: int(r.n) for i, r in enumerate(got)}
    want = targets(sizes, {i: weights[i % len(weights)] for i in sizes}, share * sum(sizes.values()))
    rows = []
    for i, r in enumerate(got):
        block = max(1, min(MAX_BLOCK, sizes[i] // BLOCKS_PER_SOURCE))
        rows.append((i, r.source, sizes[i], float(want[i]), block, -(-sizes[i] // block)))
    return spark.createDataFrame(rows, "source_no int, source string, source_size long, target double, block long, n_blocks long")


def _schedule(spark: SparkSession, plan: DataFrame, scratch: Scratch) -> DataFrame:
    """source_no, block_no, times: how often the schedule takes each block."""
    rows = [r for r in plan.orderBy("source_no").collect() if r.target > 0]
    slots = [r.target / r.block for r in rows]
    n, run, edges = round(sum(slots)), 0.0, []
    for r, w in zip(rows, slots):
        edges.append((r.source_no, run / sum(slots), (run + w) / sum(slots), r.n_blocks))
        run += w
    if not edges:
        return spark.createDataFrame([], "source_no int, block_no long, times long")
    # equal cells of [0, 1) turn the search among the cumulative weights into an equi-join
    cells = 4 * len(edges)
    cell_rows = []
    for no, lo, hi, blocks in edges:
        last = no == edges[-1][0]
        for c in range(int(lo * cells), min(cells - 1, int(hi * cells)) + 1):
            cell_rows.append((c, no, lo, 2.0 if last else hi, blocks))
    bounds = spark.createDataFrame(cell_rows, "cell int, source_no int, lo double, hi double, n_blocks long")
    point = (F.col("id") + 0.5) * F.lit(GOLDEN)
    points = spark.range(n).select("id", (point - F.floor(point)).alias("x"))
    points = points.withColumn("cell", F.least(F.lit(cells - 1), F.floor(F.col("x") * cells)).cast("int"))
    hit = points.join(F.broadcast(bounds), "cell").where("x >= lo and x < hi").select("id", "source_no", "n_blocks")
    hit = hit.withColumn("chunk", F.floor(F.col("id") / BUCKET_ROWS))
    local = hit.withColumn("r", F.row_number().over(Window.partitionBy("chunk", "source_no").orderBy("id")) - 1)
    totals = hit.groupBy("source_no", "chunk").agg(F.count("*").alias("c"))
    before = totals.withColumn("before", F.sum("c").over(Window.partitionBy("source_no").orderBy("chunk")) - F.col("c")).drop("c")
    ranked = local.join(before, ["source_no", "chunk"]).withColumn("rank", F.col("before") + F.col("r"))
    taken = ranked.where(F.col("rank") < MOST_EPOCHS * F.col("n_blocks"))
    return taken.groupBy("source_no", (F.col("rank") % F.col("n_blocks")).alias("block_no")).agg(F.count("*").alias("times"))


def _laid_out(spark: SparkSession, docs: DataFrame, plan: DataFrame, scratch: Scratch) -> DataFrame:
    """Documents (row, doc_id, size, source_no, ...) with their first word's place in the source's stream."""
    rows = docs.join(F.broadcast(plan), docs["source"].eqNullSafe(plan["source"])).drop(docs["source"]).drop(plan["source"])
    buckets = max(1, rows.count() // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))
    order = Window.partitionBy("source_no", "bucket").orderBy("h", "doc_id", "size", *([ROW] if ROW in rows.columns else []))
    local = rows.withColumn("at", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    totals = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    base = totals.withColumn("base", F.sum("n").over(Window.partitionBy("source_no").orderBy("bucket")) - F.col("n")).drop("n")
    return local.join(base, ["source_no", "bucket"]).withColumn("at", F.col("at") + F.col("base")).drop("base", "bucket")


def _spans(spark: SparkSession, docs: DataFrame, weights, share: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(documents laid out, (doc key, lo, hi, times) of the blocks that each document meets)."""
    row = [ROW] if ROW in docs.columns else []
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", F.md5(F.coalesce("text", F.lit("")))).alias("h"), *row)
    sized = scratch.save(sized, "sizes")
    plan = scratch.save(_plan(spark, sized, weights, share, scratch), "plan")
    laid = scratch.save(_laid_out(spark, sized, plan, scratch), "laid")
    times = _schedule(spark, plan, scratch)
    blocks = F.sequence(F.floor(F.col("at") / F.col("block")), F.floor((F.col("at") + F.col("size") - 1) / F.col("block")))
    met = laid.where("size > 0").select("source_no", "at", "size", "block", F.explode(blocks).alias("block_no"))
    met = met.join(times, ["source_no", "block_no"])
    met = met.select("source_no", "at", (F.greatest(F.col("block_no") * F.col("block"), "at") - F.col("at")).alias("lo"), (F.least((F.col("block_no") + 1) * F.col("block"), F.col("at") + F.col("size")) - F.col("at")).alias("hi"), "times")
    return laid, met


def mix(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) for every document."""
    laid, met = _spans(spark, docs, weights, share, Scratch(spark, "mixing"))
    taken = met.groupBy("source_no", "at").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"))
    out = laid.withColumn("place", F.when(F.col("size") > 0, F.col("at"))).join(taken.withColumnRenamed("at", "place"), ["source_no", "place"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixture(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """The mixed corpus: ``docs``' columns, a row for each pass over a document.

    A pass that takes a whole document carries its text unchanged; one that takes part of it carries
    the taken words, joined by one space. ``n_chars`` follows the text if the column is there.
    """
    scratch, names = Scratch(spark, "mixing"), docs.columns
    # the numbers are written with the rows, so they stay the same under a retry
    docs = scratch.save(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    laid, met = _spans(spark, docs, weights, share, scratch)
    passes = met.select("source_no", "at", "lo", "hi", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("epoch"))
    spans = passes.groupBy("source_no", "at", "epoch").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("__spans"), F.sum(F.col("hi") - F.col("lo")).alias("__got"))
    picked = laid.where("size > 0").join(spans, ["source_no", "at"]).select(ROW, F.col("size").alias("__size"), "__spans", "__got")
    joined = docs.join(picked, ROW)
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    part = F.element_at(F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("__spans", lambda s: F.slice(w, (s["lo"] + 1).cast("int"), (s["hi"] - s["lo"]).cast("int")))), " ")), 1)
    joined = joined.withColumn("text", F.when(F.col("__got") == F.col("__size"), F.col("text")).otherwise(part))
    if "n_chars" in names:
        joined = joined.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.select(*names)
