"""The pipeline stage by stage, and operators on repeated, long and special input, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridlake.llm import fmindex, lattice, mixing, packing, quality, suffix, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def first_of_groups(texts, num, den):
    """Indexes of the rows that stand for their group of near copies."""
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return [i for i in range(len(sets)) if root(i) == i]


def without_windows(texts, size=20):
    seen, out = set(), []
    for t in texts:
        w, cut = WORD.findall(t or ""), set()
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            if g in seen:
                cut.update(range(k, k + size))
            seen.add(g)
        out.append(" ".join(x for k, x in enumerate(w) if k not in cut) if cut else t)
    return out


def taken_by_schedule(rows, weights=(3, 1, 2), share=1.5):
    """rows: (key, h, doc_id, source, text). The words that the schedule takes of each row, as {key: count}."""
    streams = collections.defaultdict(list)
    for key, h, doc, source, text in rows:
        streams[source].append((h, doc, len(WORD.findall(text or "")), key))
    names = sorted(streams, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(r[2] for r in streams[s]) for s in names}
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        each = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * each > 2 * sizes[s]]
        if not over:
            target |= {s: weight[s] * each for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    block = {s: max(1, min(mixing.MAX_BLOCK, sizes[s] // mixing.BLOCKS_PER_SOURCE)) for s in names}
    slots = {s: target[s] / block[s] for s in names if target.get(s, 0) > 0}
    total, at, edges = sum(slots.values()), 0.0, []
    for s in slots:
        edges.append((at / total, (at + slots[s]) / total, s))
        at += slots[s]
    rank, times = collections.Counter(), collections.Counter()
    for n in range(round(total)):
        x = (n + 0.5) * mixing.GOLDEN
        x -= math.floor(x)
        s = next((s for lo, hi, s in edges if lo <= x < hi), edges[-1][2])
        many = -(-sizes[s] // block[s])
        if rank[s] < 2 * many:
            times[s, rank[s] % many] += 1
        rank[s] += 1
    out = {}
    for s in names:
        place = 0
        for _, _, size, key in sorted(streams[s], key=lambda r: (r[0], r[1], r[2])):
            out[key] = sum(times[s, w // block[s]] for w in range(place, place + size))
            place += size
    return out, target, sizes


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(41)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(55)
    out = []
    for k in range(90):
        t = text(rng.randint(30, 160))
        if k % 5 == 0:
            t += " " + passage
        if k % 3 == 2:
            t = " ".join(w + "###!!" for w in t.split(" "))
        out.append((k, t, "en", f"s{k % 4}" if k % 9 else None, len(t)))
    for k in range(12):  # near copies
        words = out[2 * k][1].split(" ")
        words[3] = "EDIT"
        out.append((200 + k, " ".join(words), "en", "s1", 0))
    return out + [(300, None, None, None, None), (301, "", "en", "s2", 0), (302, "short", "en", "s3", 5)]


def test_pipeline_by_stage(spark, corpus, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.createDataFrame(corpus, DOCS)
    labels = spark.createDataFrame([(r[0], int("###" not in (r[1] or "#"))) for r in corpus if r[0] < 90], "doc_id long, quality int").withColumn("toxic", F.lit(0))
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dups", "substrings", "mixing", "packing"]

    def rows(df):
        return sorted(map(tuple, df.select(*docs.columns).collect()), key=lambda r: (r[0], str(r)))

    # 1: the model's rules in numpy
    model = quality.fit_quality(docs, labels)
    stats = docs.select("doc_id", quality.statistics(F.col("text")).alias("s")).select("doc_id", *[F.col("s")[f].alias(f) for f in quality.FEATURES]).toPandas()
    x = stats[list(quality.FEATURES)].to_numpy(float)
    z = model.intercept + sum(w * quality.fires(r, x) for r, w in zip(model.rules, model.weights))
    score = dict(zip(stats.doc_id, 1 / (1 + np.exp(-z))))
    got = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    assert model.rules and all(abs(got[i] - s) < 1e-12 for i, s in score.items())
    want = [r for r in corpus if score[r[0]] >= 0.3]
    assert 40 < len(want) < len(corpus)
    now = stages["quality"](spark, docs, str(tmp_path))
    assert now.columns == docs.columns and rows(now) == sorted(want, key=lambda r: (r[0], str(r)))
    # 2
    want = [want[i] for i in first_of_groups([r[1] for r in want], 80, 100)]
    now = spark.createDataFrame(stages["near_dups"](spark, now, "").collect(), DOCS)
    assert rows(now) == want
    # 3
    texts = without_windows([r[1] for r in want])
    assert texts != [r[1] for r in want]
    want = [(*r[:1], t, *r[2:4], len(t) if t is not None else None) for r, t in zip(want, texts)]
    now = spark.createDataFrame(stages["substrings"](spark, now, "").collect(), DOCS)
    assert rows(now) == [r for r in want]
    # 4: words by source and document
    hashes = {r.doc_id: r.h for r in now.select("doc_id", F.xxhash64("doc_id", F.md5(F.coalesce("text", F.lit("")))).alias("h")).collect()}
    taken, _, _ = taken_by_schedule([(r[0], hashes[r[0]], r[0], r[3], r[1]) for r in want])
    mixed = stages["mixing"](spark, now, "")
    assert mixed.columns == docs.columns
    out = mixed.collect()
    words = collections.Counter()
    for r in out:
        words[r.doc_id] += len(WORD.findall(r.text))
        whole = WORD.findall(dict((w[0], w[1]) for w in want)[r.doc_id])
        assert not collections.Counter(WORD.findall(r.text)) - collections.Counter(whole)
    assert words == +collections.Counter(taken)
    # 5
    t = tokenizers.Tokenizer.from_file(packing.default_vocabulary())
    ids = collections.Counter(zlib.crc32(np.array([*t.encode(r.text, add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in out)
    packed = packing.pack(spark, spark.createDataFrame(out, DOCS)).orderBy("sequence_id", "offset").collect()
    assert [r.sequence_id * 2048 + r.offset for r in packed] == np.cumsum([0, *[r.length for r in packed]])[:-1].tolist()
    joined, again = b"", collections.Counter()
    for r in packed:
        joined += r.ids
        if r.start + r.length == r.doc_tokens:
            again[zlib.crc32(joined)] += 1
            joined = b""
    assert again == ids
    # the run writes each stage and reads it again
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.agg(F.sum("length")).first()[0] == sum(r.length for r in packed)


def test_mix_by_brute_force(spark, corpus):
    table = [r[:4] for r in corpus] + [(None, corpus[3][1], "x", None), (7, "another text of seven", "x", "s1")]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string")
    h = docs.select("doc_id", "text", "source", F.xxhash64("doc_id", F.md5(F.coalesce("text", F.lit("")))).alias("h")).collect()
    taken, target, sizes = taken_by_schedule([(k, r.h, r.doc_id if r.doc_id is not None else -1, r.source, r.text) for k, r in enumerate(h)])
    want = collections.Counter((r.doc_id, len(WORD.findall(r.text or "")), sizes[r.source], round(target.get(r.source, 0.0), 6), taken[k]) for k, r in enumerate(h))
    assert collections.Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(spark, docs).collect()) == want


def test_mixture_of_repeated_rows(spark, corpus):
    docs = spark.createDataFrame([(r[0], r[1], i, r[3]) for i, r in enumerate(corpus)], "doc_id long, text string, mark int, source string")
    for k in (1, 5):
        twice = docs.union(docs).repartition(k)
        want, got = collections.Counter(), collections.Counter()
        for r in mixing.mix(spark, twice).collect():
            want[r.doc_id] += r.taken
        for r in mixing.mixture(spark, twice).collect():
            got[r.doc_id] += len(WORD.findall(r.text))
        assert got == +want


def test_special_tokens(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(packing.default_vocabulary())
    mark = "<|endoftext|>"
    texts = [f"hello {mark} world", mark, mark * 3, f" {mark}  \n{mark}x  {mark}", f"a{mark}b", "<|endoftext|", f"é{mark}  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.pack(spark, docs).collect()}
    assert got == {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}


def test_texts_beyond_a_piece(spark):
    rng = np.random.default_rng(6)
    words = [f"{x:x}" for x in rng.integers(0, 1 << 40, fmindex.CHUNK + 60_000)]
    words[fmindex.CHUNK - 10 : fmindex.CHUNK + 50] = words[:60]
    words[-100:-60] = words[500_000:500_040]
    rows = [(1, " ".join(words)), (2, " ".join(["x", *words[fmindex.CHUNK + 100 : fmindex.CHUNK + 130], "y"])), (None, " ".join(words[:200]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in fmindex.repeated_words(spark, docs).collect()}
    assert got == {1: 100, 2: 30, None: 0}
    raw = bytes(rng.integers(97, 123, suffix.CHUNK + 5_000, dtype=np.uint8))
    raw = raw[: suffix.CHUNK - 200] + raw[1000:1700] + raw[suffix.CHUNK + 500 :]
    docs = spark.createDataFrame([(1, raw.decode()), (2, "-" + raw[5000:5399].decode() + "-"), (3, "+" + raw[9000:9400].decode() + "+")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix.repeated_bytes(spark, docs).collect()}
    assert got == {1: (1800, 3), 2: (0, 0), 3: (400, 1)}


def test_crowded_anchors(spark, monkeypatch):
    from gridlake.llm import anchors

    rng = random.Random(3)
    phrase = "all rights reserved by the".split()
    rows = []
    for k in range(300):
        w = [str(rng.randrange(60)) for _ in range(30)]
        rows.append((k, " ".join([*w[:12], *phrase, *w[12:], *(rows[k // 2][1].split(" ")[:25] if k % 4 == 3 else [])])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    usual = sorted(map(tuple, fmindex.repeated_words(spark, docs).collect()))
    kept = without_windows([t for _, t in rows])
    assert [r[3] for r in usual] == [hashlib.sha256(t.encode()).hexdigest() for t in kept]
    monkeypatch.setattr(anchors, "CROWD", 3)
    how = anchors.plan(docs, anchors.Scratch(spark, "t"), fmindex._read, 20, 5, True, 1000, 1)
    assert len(how.crowded) and how.shards == 1
    assert sorted(map(tuple, fmindex.repeated_words(spark, docs).collect())) == usual


def test_shards_in_parts():
    from gridlake.llm import anchors

    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(0, 300, 300).astype(np.uint64) * np.uint64(977)) for i in range(40)]
    rows += [(100 + i, np.concatenate([v[20:90], rows[i - 1][1][150:200]])) for i, v in rows[::3]]
    sender, blobs = anchors.Sender(20, 5, anchors.Plan(1, np.empty(0, np.int64)), True, 2000, checks=True), []
    for i, v in rows:
        for b in sender.add(i, v, (v % 255 + 1).astype(np.uint8)):
            blobs += b.column("blob").to_pylist()
    for b in sender.flush():
        blobs += b.column("blob").to_pylist()

    def removed(parts):
        out = set()
        for part in range(parts):
            shard = anchors.Shard(blobs, 20, part, parts)
            for cols in (fmindex._judge(20)(shard), shard.spans):
                out |= set(zip(*(c.tolist() for c in cols)))
        return out

    assert removed(1) and removed(1) == removed(7)


def test_lattice_components_and_squares(spark, monkeypatch):
    rng = np.random.default_rng(9)
    tight = rng.standard_normal((1, 24)) + 0.05 * rng.standard_normal((150, 24))
    x = np.vstack([rng.standard_normal((60, 24)), tight, tight[:10]])
    rows = [(1000 - i, v.tolist(), "clash", i) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string, id int").repartition(3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T) >= 0.95
    np.fill_diagonal(near, False)
    name = [1000 - i for i in range(len(x))]
    least, changed = list(name), True
    while changed:
        changed = False
        for i, j in zip(*np.nonzero(near)):
            if least[j] < least[i]:
                least[i], changed = least[j], True
    want = {name[i]: (int(near[i].sum()), least[i], least[i] == name[i]) for i in range(len(x))}
    for square in (lattice.SQUARE, 40):
        monkeypatch.setattr(lattice, "SQUARE", square)
        for t in (table, table.union(table)):
            got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.embedding_near_dups(spark, t).collect()}
            assert got == want


def test_warc_repeated_rows_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(warc, "LARGE", 4)
    pages = [(i, f"u{i}", "same" if i % 3 else f"page {i // 2}", "clash") for i in range(60)]
    table = spark.createDataFrame([*pages, *pages[:7], (None, None, "same", "x"), (None, None, None, "x")], "page_id long, url string, html string, sha string").repartition(3)
    largest = {}
    for r in table.collect():
        if r.page_id is not None:
            largest[r.html] = max(r.page_id, largest.get(r.html, -1))
    want = collections.Counter()
    for r in table.collect():
        top = largest.get(r.html)
        again = top is not None and r.page_id != top
        want[r.page_id, len(r.html or ""), "revisit" if again else "response", top if again else None] += 1
    got = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(spark, table).collect())
    assert got == want


def test_chain_learns_from_other_folds(monkeypatch):
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 80, 12)).astype(np.uint32) for _ in range(200)]
    rows[7] = rows[3]
    y = np.array([float(5 in r) for r in rows])
    seen = []
    learned = toxicity._learned

    def spy(x, labels, at):
        seen.append(at)
        return learned(x, labels, at)

    monkeypatch.setattr(toxicity, "_learned", spy)
    toxicity.fit_chain(rows, y)
    whole, *train = seen
    assert len(whole) == 200 and len(train) == 5
    out = [set(range(200)) - set(at.tolist()) for at in train]
    assert sorted(i for s in out for i in s) == list(range(200))
    assert any({3, 7} <= s for s in out)
    # a row's own label doesn't change the terms and features behind its probability
    x = toxicity.Sparse([r.astype(int) for r in rows], 80)
    k = min(out[0])
    flipped = y.copy()
    flipped[k] = 1 - y[k]
    for a, b in zip(learned(x, y, train[0])[1][:2], learned(x, flipped, train[0])[1][:2]):
        assert (a == b).all()
