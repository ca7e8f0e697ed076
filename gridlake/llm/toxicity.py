"""Toxicity: a classifier chain of sparse linear models.

The categories are predicted one after another; each model sees the text's features and the
probabilities of the categories before it. In training those are out-of-fold predictions: the terms,
the choice of features and the weights behind a row's probability come from the other folds' labels
alone, and equal texts share a fold. So a later model never learns from a probability that its own
row's label, or that of the same text, helped to fit.

Categories here: ``term`` (holds a term that is far commoner in toxic training rows), ``repeated``
(holds at least two) and ``toxic`` (the given label). The tables label toxicity alone: the first two
are derived from that label and are steps towards it, no labels of their own. A text's features are its distinct lower-case
letter runs and their 5-letter prefixes, hashed; whole texts are read.

Null text counts as empty. Repeated rows give repeated results, an empty table an empty one.
Without labels of both classes every probability is the smoothed share. Rows with a null doc_id are
scored and marked held out. Extra columns are ignored. A doc_id teaches once for each of its labels,
however often its rows repeat; if they hold several texts, the one with the least features does.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import held_out

#: The chain is fitted on at most this many labelled rows (those with the smallest hash).
MAX_TRAIN_ROWS = 8_000
MAX_FEATURES = 4_000
CATEGORIES = ("term", "repeated", "toxic")
SPACE = 1 << 22
LETTERS = re.compile(r"[^\W\d_]+")


class Tokens(dict):
    """Hashed features of a word, remembered up to a bound."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        own = (zlib.crc32(word.encode("utf-8", "surrogatepass")) % SPACE,)
        if len(word) >= 5:
            own += (zlib.crc32(b"^" + word[:5].encode("utf-8", "surrogatepass")) % SPACE,)
        self[word] = own
        return own

    def of(self, text: str | None) -> set[int]:
        out: set[int] = set()
        for w in set(LETTERS.findall((text or "").lower())):
            out.update(self[w])
        return out


def _collect(batches):
    tokens = Tokens()
    for b in batches:
        bits = [np.array(sorted(tokens.of(t)), np.uint32).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(bits, pa.binary())], ["doc_id", "y", "f"])


class Sparse:
    """Rows of feature indexes, with the products a gradient needs."""

    def __init__(self, rows: list[np.ndarray], m: int):
        self.m, self.n = m, len(rows)
        self.idx = np.concatenate(rows) if rows else np.empty(0, int)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.idx], minlength=self.n)

    def transposed(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.idx, weights=r[self.row], minlength=self.m)

    def take(self, rows: np.ndarray, columns: np.ndarray) -> Sparse:
        out, row, col = Sparse([], len(columns)), np.full(self.n, -1), np.full(self.m, -1)
        row[rows], col[columns] = np.arange(len(rows)), np.arange(len(columns))
        hit = (row[self.row] >= 0) & (col[self.idx] >= 0)
        out.n, out.idx, out.row = len(rows), col[self.idx[hit]], row[self.row[hit]]
        return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(x: Sparse, dense: np.ndarray, y: np.ndarray, penalty: float = 4e-4, steps: int = 250):
    """Weights over features, dense inputs and intercept; L1 on the features only."""
    d = np.hstack([dense, np.ones((x.n, 1))])
    w, v = np.zeros(x.m), np.zeros(d.shape[1])
    share = (y.sum() + 1) / (len(y) + 2)
    v[-1] = np.log(share / (1 - share))
    u = np.ones(x.m)
    for _ in range(12):
        u = x.transposed(x.times(u))
        u /= np.linalg.norm(u) or 1
    rate = 4 * x.n / (np.linalg.norm(x.times(u)) ** 2 + (d**2).sum() + 1e-9)
    aw, av, t = w.copy(), v.copy(), 1.0
    for _ in range(steps):
        r = _sigmoid(x.times(aw) + d @ av) - y
        nw = aw - rate * x.transposed(r) / x.n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nv = av - rate * (d.T @ r) / x.n
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        aw, av = nw + (t - 1) / t1 * (nw - w), nv + (t - 1) / t1 * (nv - v)
        w, v, t = nw, nv, t1
    return w, v


class Chain:
    """Fitted models: hashed feature to position, and (weights, dense weights) of each category."""

    def __init__(self, at: dict[int, int], models: list):
        self.at, self.models = at, models

    def probabilities(self, features: list[set[int]]) -> np.ndarray:
        at = self.at
        rows = [np.array(sorted(at[f] for f in s if f in at), int) for s in features]
        x, dense = Sparse(rows, len(at)), np.empty((len(rows), 0))
        for w, v in self.models:
            p = _sigmoid(x.times(w) + dense @ v[:-1] + v[-1])
            dense = np.hstack([dense, p[:, None]])
        return dense


def fit_chain(rows: list[np.ndarray], y: np.ndarray, folds: int = 5) -> Chain:
    """rows: sorted hashed features of each training text; y: 0/1."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Chain({}, [(np.zeros(0), np.array([0.0] * j + [np.log(share / (1 - share))])) for j in range(len(CATEGORIES))])
    flat, of = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    ids, inverse = np.unique(flat, return_inverse=True)
    x = Sparse([], len(ids))
    x.n, x.idx, x.row = len(rows), inverse, of
    every = np.arange(len(y))
    fold = np.array([zlib.crc32(r.tobytes()) % folds for r in rows])
    train = [np.flatnonzero(fold != k) for k in range(folds)]
    kept, targets = _learned(x, y, every)
    parts = [_learned(x, y, at) for at in train]
    dense, models = np.empty((len(y), 0)), []
    for j in range(len(CATEGORIES)):
        models.append(_fit(x.take(every, kept), dense, targets[j]))
        out = np.zeros(len(y))
        for k, (columns, own) in enumerate(parts):
            at, test = train[k], np.flatnonzero(fold == k)
            if not len(at) or not len(test):
                out[test] = targets[j].mean()
                continue
            w, v = _fit(x.take(at, columns), dense[at], own[j][at])
            out[test] = _sigmoid(x.take(test, columns).times(w) + dense[test] @ v[:-1] + v[-1])
        dense = np.hstack([dense, out[:, None]])
    return Chain({int(ids[k]): i for i, k in enumerate(kept)}, models)


def _learned(x: Sparse, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The features to use and the target of each category for every row, from the labels of rows ``at`` alone."""
    seen = np.zeros(x.n, bool)
    seen[at] = True
    hit = seen[x.row]
    idx, label = x.idx[hit], y[x.row[hit]]
    pos, every = np.bincount(idx, weights=label, minlength=x.m), np.bincount(idx, minlength=x.m)
    toxic = y[at].sum()
    odds = np.log((pos + 0.5) / (toxic + 1)) - np.log((every - pos + 0.5) / (len(at) - toxic + 1))
    usual = every >= 3
    strength = np.where(usual, np.abs(odds) * np.sqrt(np.minimum(pos, 50) + 0.1), 0)
    terms = x.times(((odds > 2.5) & usual).astype(float))
    return np.sort(np.argsort(-strength, kind="stable")[:MAX_FEATURES]), [(terms >= 1).astype(float), (terms >= 2).astype(float), y]


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Chain:
    """Fit on rows of ``labels`` (doc_id, toxic) that are not held out, at most ``max_rows``."""
    chosen = (
        labels.select("doc_id", F.col("toxic").cast("double").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0.0, 1.0) & ~held_out(F.col("doc_id")))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(max_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(_collect, "doc_id long, y double, f binary")
    got = rows.groupBy("doc_id", "y").agg(F.min("f").alias("f")).collect()  # so no more rows than ``chosen`` has
    got.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.y, bytes(r.f)))
    return fit_chain([np.frombuffer(r.f, np.uint32) for r in got], np.array([r.y for r in got], float))


def score_toxicity(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, one probability for each category, score (of the last) and predicted."""

    def score(batches):
        tokens = Tokens()
        for b in batches:
            p = chain.probabilities([tokens.of(t) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c) for c in p.T]], ["doc_id", *CATEGORIES])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, " + ", ".join(f"{c} double" for c in CATEGORIES))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *[F.col(c).alias(f"p_{c}") for c in CATEGORIES], F.col(CATEGORIES[-1]).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    return score_toxicity(docs, fit_toxicity(docs, labels, max_rows), threshold)
