"""Packing: concatenate all documents' tokens and cut the stream into windows of one length.

Two passes. The first tokenizes each document once, appends the end id, and writes the ids with the
document's offset inside its partition; the partitions' totals, one number for each partition, are
then prefix-summed. The second adds its partition's base to each document's offset, which is its
global position, and cuts at multiples of the window. Only the last sequence needs padding.

The ids written are a table in the shared folder, so a lost task re-reads rather than re-tokenizes,
and positions cannot change under a retry. Null text counts as empty and gives the end id alone.
Repeated rows are separate documents. An empty table gives no pieces. A very long document becomes
many pieces; its ids are one value and must be under 2 GB. Extra columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, trim

WINDOW = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"
#: Prefix sums hold one number for each partition on the driver.
MAX_PARTITIONS = 1_000_000

#: Documents whose ids are held at once by a task.
BATCH = 256

_loaded: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encoder(path: str):
    """text -> ids by the vocabulary in a tokenizers JSON file of byte-level BPE.

    The merges run in tiktoken's engine, which gives the same ids as the tokenizers library several
    times faster. As there, an added token's string in a text is that token, whose id it gets.
    """
    if path not in _loaded:
        import public_tokenizers
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*printable}))}
        back = {c: b for b, c in chars.items()}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        _loaded[path] = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: _loaded[path].encode(text, allowed_special="all")


def tokenize(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """part, doc_id, start (within the part), n_tokens, ids (little-endian uint32, with the end id)."""

    def run(batches):
        encode, part, start = encoder(vocabulary), TaskContext.get().partitionId(), 0
        trim()
        for b in (whole.slice(lo, BATCH) for whole in batches for lo in range(0, whole.num_rows, BATCH)):
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = np.array([*encode((text or "").encode("utf-8", "replace").decode("utf-8")), end_id], "<u4")
                rows.append((part, doc, start, len(ids), ids.tobytes()))
                start += len(ids)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], ["part", "doc_id", "start", "n_tokens", "ids"])
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids binary")


def bases(tokens: DataFrame) -> dict[int, int]:
    """Global offset of each partition: the exclusive prefix sum of the totals."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").limit(MAX_PARTITIONS + 1).collect()
    if len(totals) > MAX_PARTITIONS:
        raise ValueError(f"more than {MAX_PARTITIONS} partitions")
    out, at = {}, 0
    for r in totals:
        out[r.part], at = at, at + r.n
    return out


def pack(spark: SparkSession, docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``start`` counts the document's ids before the piece, ``offset`` the sequence's. Pieces fill
    sequences 0, 1, ... without a gap; every sequence but the last holds exactly ``window`` ids.
    ``ids`` are the piece's ids as little-endian uint32.
    """
    scratch = Scratch(spark, "packing")
    tokens = scratch.save(tokenize(docs, vocabulary or default_vocabulary(), end_id), "tokens")
    base = bases(tokens)
    at = spark.createDataFrame(sorted(base.items()), "part int, base long")
    placed = tokens.join(F.broadcast(at), "part").withColumn("at", F.col("base") + F.col("start"))
    first = F.floor(F.col("at") / window).cast("long")
    last = F.floor((F.col("at") + F.col("n_tokens") - 1) / window).cast("long")

    def piece(s):
        lo = F.greatest(s * window, F.col("at"))
        n = F.least((s + 1) * window, F.col("at") + F.col("n_tokens")) - lo
        start = lo - F.col("at")
        ids = F.substring(F.col("ids"), (4 * start + 1).cast("int"), (4 * n).cast("int"))
        return F.struct(start.alias("start"), n.alias("length"), s.alias("sequence_id"), (lo - s * window).alias("offset"), (ids if with_ids else F.crc32(ids)).alias("ids" if with_ids else "ids_crc32"))

    pieces = placed.select("doc_id", F.col("n_tokens").alias("doc_tokens"), F.transform(F.sequence(first, last), piece).alias("pieces"))
    out = pieces.select("doc_id", "doc_tokens", F.inline("pieces"))
    return out


def packed_digest(spark: SparkSession, docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """The pieces of ``pack`` with the CRC-32 of their ids in place of the ids."""
    out = pack(spark, docs, window, vocabulary, with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
