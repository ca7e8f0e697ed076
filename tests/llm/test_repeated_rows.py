"""Rows that share a doc_id: repeated ones don't depend on where they are read."""

from gridlake.llm import fmindex, forest, quality, toxicity


def test_fm_index_repeated_rows(spark):
    words = [f"w{k}" for k in range(90)]
    rows = [(1, " ".join(words[:60])), (2, " ".join(words[60:])), (3, " ".join(["x", *words[10:50], "y"])), (4, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(fmindex.repeated_words(spark, docs).collect())
    assert [r.n_removed for r in want] == [0, 0, 40, 0]
    texts = sorted(fmindex.without_repeats(spark, docs).collect())
    for k in (1, 5):
        twice = docs.union(docs).repartition(k)
        assert sorted(fmindex.repeated_words(spark, twice).collect()) == sorted(want * 2)
        assert sorted(fmindex.without_repeats(spark, twice).collect()) == sorted(texts * 2)


def test_keep_first_null_and_shared_ids(spark):
    text = lambda name, n=40: " ".join(f"{name}{k}" for k in range(n))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, None), (None, text("c"))]
    rows += [(1, text("c")), (2, text("d")), (2, text("e")), (2, text("E")), (2, text("d")), (3, text("e") + " f"), (4, text("g")), (5, text("d"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(forest.keep_first(spark, docs).collect(), key=str)
    want = [*rows[:6], (2, text("d")), (2, text("E")), (4, text("g"))]
    assert [tuple(r) for r in got] == [tuple(r) for r in sorted(spark.createDataFrame(want, docs.schema).collect(), key=str)]
    found = {r.doc_id: (r.component_id, r.kept) for r in forest.near_duplicates(spark, docs).collect()}
    assert found == {None: (None, True), 1: (1, True), 2: (2, True), 3: (2, False), 4: (4, True), 5: (2, False)}


def test_classifiers_learn_once_from_repeated_rows(spark):
    good = lambda k: (k, f"The {k} of a long and quiet text that says what it means, line {k}.")
    bad = lambda k: (k, f"buy!!! $$$ {k} ### vile vile scum {k % 7}")
    docs = spark.createDataFrame([bad(k) if k % 3 == 0 else good(k) for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), int(k % 3 == 0)) for k in range(300)], "doc_id long, quality int, toxic int")
    hot = docs.where("doc_id = 1 or doc_id = 3").crossJoin(spark.range(200)).select("doc_id", "text")
    many = labels.where("doc_id = 1").crossJoin(spark.range(200)).select("doc_id", "quality", "toxic")
    for d, l in ((docs, labels), (docs.union(hot).repartition(3), labels.union(many).repartition(3))):
        m, c = quality.fit_quality(d, l, 200), toxicity.fit_toxicity(d, l, 200)
        now = (m.rules, m.weights, m.intercept), c.at, [(w.tolist(), v.tolist()) for w, v in c.models]
        first = now if d is docs else first
    assert now == first and m.rules and c.at
