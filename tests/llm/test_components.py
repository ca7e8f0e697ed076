"""Components of few edges take few jobs; more edges go by rounds, with the same result."""

import random

from gridlake.llm.common import Scratch, components


def test_few_edges_take_few_jobs(spark):
    rnd = random.Random(3)
    at = rnd.sample(range(-500, 10_000), 400)
    pairs = list(zip(at[:300], at[1:300])) + [(rnd.choice(at[300:]), rnd.choice(at[300:])) for _ in range(60)] + [(7, 7), (None, 3)]
    pairs += [(b, a) for a, b in pairs[::3]]
    rnd.shuffle(pairs)
    least = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}
    for _ in least:
        for a, b in pairs:
            if a in least and b in least and a != b:
                least[a] = least[b] = min(least[a], least[b])
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    sc, jobs = spark.sparkContext, []
    for how in ({}, {"few": 10}):
        sc.setJobGroup(f"components {how}", "")
        got = components(spark, edges, Scratch(spark, "test"), **how).collect()
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"components {how}")))
        assert sorted(tuple(r) for r in got) == sorted(least.items())
    sc.setJobGroup("", "")
    assert jobs[0] <= 10 < jobs[1]
    none = components(spark, edges.where("a > 20000"), Scratch(spark, "test"))
    assert none.count() == 0
