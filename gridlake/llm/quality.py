"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow boosted trees are grown on the driver from a bounded sample of labelled rows; every path
from a root becomes a conjunctive rule; a lasso logistic regression gives most rules weight zero;
the remaining rules are compiled into one Spark column expression, so scoring a corpus is a
projection without a shuffle or Python.

Null text counts as empty. An empty text has all statistics 0 and is scored like any other. Rows
with a null doc_id are scored and marked held out. Repeated rows give repeated results, an empty
table an empty one. With no usable labels the score is 0.5, with one class only the smoothed share
of label 1. Extra columns are ignored. A doc_id teaches once for each of its labels, however often
its rows repeat; if they hold several texts, the one with the least statistics does.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD
from .rules import _let

#: The classifier is fitted on at most this many labelled rows (those with the smallest hash).
MAX_TRAIN_ROWS = 20_000

FEATURES = (
    "log_words", "mean_word_length", "symbol_share", "upper_share", "exclamation_share", "digit_share",
    "distinct_share", "dup_line_share", "words_per_line", "stop_share", "mark_share",
)


def statistics(text: Column) -> Column:
    """A struct of the features of a text, all finite doubles."""

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")

    def body(p: Column) -> Column:
        text, words, lines = p["text"], p["words"], p["lines"]
        n, rows = F.size(words), F.size(lines)
        without = lambda chars: F.length(text) - F.length(F.regexp_replace(text, chars, ""))
        distinct = F.array_distinct(words)
        return F.struct(
            F.log1p(n.cast("double")).alias("log_words"),
            share(F.length(F.array_join(words, "")), n).alias("mean_word_length"),
            share(without("[#*$%&|<>]+"), n).alias("symbol_share"),
            share(without(r"\p{Lu}+"), F.length(text)).alias("upper_share"),
            share(without("!+"), n).alias("exclamation_share"),
            share(without("[0-9]+"), F.length(text)).alias("digit_share"),
            share(F.size(distinct), n).alias("distinct_share"),
            share(rows - F.size(F.array_distinct(lines)), rows).alias("dup_line_share"),
            share(n, rows).alias("words_per_line"),
            share(F.size(F.filter(distinct, lambda w: F.length(w) <= 3)), F.size(distinct)).alias("stop_share"),
            share(without("[.,;:?]+"), n).alias("mark_share"),
        )

    text = F.coalesce(text, F.lit(""))
    return _let(
        F.struct(
            text.alias("text"),
            F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
            F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        ),
        body,
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.4, bins: int = 32, least: int = 8) -> list[tuple]:
    """Rules of boosted regression trees: each a sorted tuple of (feature, is_greater, threshold)."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)
    rules: dict[tuple, None] = {}
    z = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))

    def best(at: np.ndarray, g: np.ndarray, h: np.ndarray):
        found = (1e-6, None)
        total_g, total_h = g[at].sum(), h[at].sum()
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            size = len(c) + 1
            gs, hs, ns = (np.cumsum(np.bincount(codes[at, f], weights=v, minlength=size))[:-1] for v in (g[at], h[at], np.ones(len(at))))
            gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
            gain[(ns < least) | (len(at) - ns < least)] = -1
            k = int(gain.argmax())
            if gain[k] > found[0]:
                found = (gain[k], (f, k))
        return found[1]

    def split(at: np.ndarray, path: tuple, left: int, g, h, step: np.ndarray):
        if path:
            rules[tuple(sorted(path))] = None
        where = best(at, g, h) if left and len(at) >= 2 * least else None
        if where is None:
            step[at] = g[at].sum() / (h[at].sum() + 1)
            return
        f, k = where
        low = codes[at, f] <= k
        split(at[low], (*path, (f, False, float(cuts[f][k]))), left - 1, g, h, step)
        split(at[~low], (*path, (f, True, float(cuts[f][k]))), left - 1, g, h, step)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        step = np.zeros(len(y))
        split(np.arange(len(y)), (), depth, y - p, p * (1 - p), step)
        z += rate * step
    return list(rules)


def fires(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, greater, t in rule:
        out &= (x[:, f] > t) if greater else (x[:, f] <= t)
    return out


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of L1-penalised logistic regression, by accelerated proximal gradient."""
    n, m = a.shape
    a1 = np.hstack([a, np.ones((n, 1))])
    v = np.ones(m + 1)
    for _ in range(20):
        v = a1.T @ (a1 @ v)
        v /= np.linalg.norm(v) or 1
    rate = 4 * n / max(float(v @ (a1.T @ (a1 @ v))), 1e-9)
    w = np.zeros(m + 1)
    w[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    u, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a1 @ u, -30, 30)))
        new = u - rate * (a1.T @ (p - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u = new + (t - 1) / t1 * (new - w)
        w, t = new, t1
    return w[:-1], float(w[-1])


class RuleModel:
    """Weighted conjunctive rules and an intercept."""

    def __init__(self, rules: list[tuple], weights: list[float], intercept: float):
        self.rules, self.weights, self.intercept = rules, weights, intercept

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 0.002) -> RuleModel:
        if not len(y):
            return cls([], [], 0.0)
        if y.min() == y.max():
            p = (y.sum() + 1) / (len(y) + 2)
            return cls([], [], float(np.log(p / (1 - p))))
        rules = grow(x, y)
        w, b = lasso(np.stack([fires(r, x) for r in rules], 1).astype(float), y, penalty)
        keep = [i for i in range(len(rules)) if abs(w[i]) > 1e-6]
        return cls([rules[i] for i in keep], [float(w[i]) for i in keep], b)

    def column(self, s: Column) -> Column:
        """The score as an expression over the statistics struct."""
        z = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights):
            hit = F.lit(True)
            for f, greater, t in rule:
                c = s[FEATURES[f]]
                hit = hit & ((c > F.lit(t)) if greater else (c <= F.lit(t)))
            z = z + F.when(hit, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> RuleModel:
    """Fit on the rows of ``labels`` (doc_id, quality) that are not held out, at most ``max_rows``."""
    chosen = (
        labels.select(F.col("doc_id"), F.col("quality").cast("double").alias("__y"))
        .where(F.col("doc_id").isNotNull() & F.col("__y").isin(0.0, 1.0) & ~held_out(F.col("doc_id")))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "__y")
        .limit(max_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "__y", statistics(F.col("text")).alias("s"))
    rows = rows.groupBy("doc_id", "__y").agg(F.min("s").alias("s"))  # so no more rows than ``chosen`` has
    got = rows.select("__y", *[F.col("s")[f].alias(f) for f in FEATURES]).toPandas()
    got = got.sort_values(list(got.columns))  # the same model whatever order the rows arrive in
    return RuleModel.fit(got[list(FEATURES)].to_numpy(float), got["__y"].to_numpy(float))


def score_quality(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    out = docs.select("doc_id", statistics(F.col("text")).alias("s"))
    out = out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column(F.col("s")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    return score_quality(docs, fit_quality(docs, labels, max_rows), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns."""
    model = fit_quality(docs, labels)
    return docs.where(model.column(statistics(F.col("text"))) >= threshold)
