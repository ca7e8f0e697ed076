"""The pipeline's stages on small fixtures."""

import math
import random

import corpus_pipeline
from gridlake.llm import forest


def test_near_dup_stage_threshold(spark):
    rng, rows, want, between = random.Random(8), [], [], 0
    for k in range(150):
        words = [f"d{k}w{i}" for i in range(204)]
        copy = list(words)
        for i in rng.sample(range(len(copy)), rng.choice([3, 4, 5])):
            copy[i] = f"e{i}"
        a, b = ({tuple(w[i : i + 5]) for i in range(200)} for w in (words, copy))
        j = len(a & b) / len(a | b)
        between += 0.8 <= j < 0.85
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        want += [2 * k] if 100 * len(a & b) >= 80 * len(a | b) else [2 * k, 2 * k + 1]
    assert between > 30 and len(want) > 160
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dup_stage(spark, docs, "").collect()) == want


def test_plan_follows_threshold():
    for j in (30, 60, 80, 85, 95):
        how = forest.plan(j, 100)
        assert (1 - (j / 100) ** how.depths[0]) ** how.trees <= forest.MISS
    assert forest.plan(85, 100).trees == 16 and forest.plan(80, 100).trees == 21
    assert forest.plan(80, 100).cut / 168 < forest.plan(85, 100).cut / 128


def test_sketch_cut_misses_less_than_the_trees():
    for j in (80, 85):
        how = forest.plan(j, 100)
        n, p = how.trees * how.depths[-1], (1 + 15 * j / 100) / 16
        assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(how.cut)) < 3e-9
