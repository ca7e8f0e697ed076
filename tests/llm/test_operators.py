"""Small fixtures with nulls, empty and long texts, ties and repeats, against brute force."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from gridlake.llm import fmindex, forest, lattice, mixing, packing, quality, rules, suffix, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = "doc_id long, text string, lang string, source string, n_chars long, blobs string"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = text(60), text(150)
    out = [None, "", "  \n\t", "One", "Zwei drei", text(19), text(20)]
    for k in range(60):
        t = text(rng.randint(5, 300))
        if k % 4 == 0:
            t += " " + passage + "\n" + text(10)
        out.append(t)
    for k in range(12):
        w = base.split(" ")
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = "EDIT%d" % k
        out.append(" ".join(w))
    out += [out[20], out[20].upper(), out[21], text(6000), "é" * 900, "ab " * 700]
    return [(i * 3, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 5}", len(t or ""), "clash") for i, t in corpus]
    return spark.createDataFrame(rows, KINDS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KINDS)


def test_fm_index(spark, docs, none, corpus):
    seen, want = set(), {}
    for i, t in corpus:
        w = WORD.findall(t or "")
        cut = set()
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                cut.update(range(k, k + 20))
            seen.add(g)
        kept = " ".join(x for k, x in enumerate(w) if k not in cut)
        want[i] = (len(w), len(cut), hashlib.sha256(kept.encode()).hexdigest(), kept)
    got = {r.doc_id: r for r in fmindex.repeated_words(spark, docs).collect()}
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == {i: v[:3] for i, v in want.items()}
    text = dict(corpus)
    cut = fmindex.without_repeats(spark, docs)
    assert cut.columns == docs.columns
    assert {r.doc_id: r.text for r in cut.collect()} == {i: (v[3] if v[1] else text[i]) for i, v in want.items()}
    assert fmindex.repeated_words(spark, none).count() == 0


def test_suffix_sorting(spark, docs, none, corpus):
    raw = {i: (t or "").encode() for i, t in corpus}
    n = collections.Counter(b[k : k + 400] for b in raw.values() for k in range(len(b) - 399))
    want = {}
    for i, b in raw.items():
        cut = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 399):
            if n[b[k : k + 400]] > 1:
                cut[k] += 1
                cut[k + 400] -= 1
        gone = np.cumsum(cut)[:-1] > 0
        runs = int(np.sum(gone & ~np.concatenate([[False], gone[:-1]])))
        want[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeated_bytes(spark, docs).collect()}
    assert got == want
    assert suffix.repeated_bytes(spark, none).count() == 0


def test_forest(spark, docs, none, corpus):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in corpus:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in forest.near_duplicates(spark, docs).collect()}
    assert got == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}
    assert forest.near_duplicates(spark, none).count() == 0
    assert sorted(r.doc_id for r in forest.keep_first(spark, docs.union(docs)).collect()) == sorted(i for i in sets if root(i) == i)


def test_forest_hot_group(spark):
    rng = random.Random(11)
    base = [f"w{k}" for k in range(324)]

    def edited(words, edits, name):
        words = list(words)
        for k in rng.sample(range(len(words)), edits):
            words[k] = f"{name}x{k}"
        return words

    words = []
    for k in range(1200):  # variants at 0.78 or so of one another, each with a partner at 0.85 or so
        words.append(edited(base, 4, f"a{k}"))
        words.append(edited(words[-1], rng.choice([4, 5]), f"b{k}"))
    number = collections.defaultdict(lambda: len(number))
    sets = [np.unique([number[tuple(w[k : k + 5])] for k in range(320)]) for w in words]
    size = np.array([len(s) for s in sets])
    common = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, len(number), 8192):
        m = np.zeros((len(sets), 8192), np.float32)
        for row, s in zip(m, sets):
            row[s[(s >= lo) & (s < lo + 8192)] - lo] = 1
        common += m @ m.T
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in zip(*np.nonzero(np.triu(100 * common >= 85 * (size[:, None] + size[None] - common), 1))):
        x, y = sorted((root(int(a)), root(int(b))))
        up[y] = x
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in forest.near_duplicates(spark, table).collect()}
    want = {i: root(i) for i in range(len(words))}
    assert sum(i != r for i, r in want.items()) > 500
    assert {i: (got[i], r) for i, r in want.items() if got[i] != r} == {}


def test_lattice(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 16))
    x = np.vstack([x, x[:40] + 0.05 * rng.standard_normal((40, 16)), x[:5], 2 * x[:3]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None]), (904, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.embedding_near_dups(spark, table).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T) >= 0.95
    assert all(got[i][0] == near[i].sum() - 1 for i in range(len(x)))
    assert all(got[i] == (0, i) for i in range(900, 905))
    assert got[340][1] == got[0][1] == 0
    assert lattice.embedding_near_dups(spark, table.limit(0)).count() == 0


def test_lattice_recall():
    rng = np.random.default_rng(1)
    u = rng.standard_normal((3000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.standard_normal((3000, 64))
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = 0.95 * u + np.sqrt(1 - 0.95**2) * w
    met = np.zeros(3000, bool)
    args = (lattice.TABLES, lattice.BLOCKS, lattice.PROBES, lattice.SCALE)
    for (h1, n1), (h2, n2) in zip(lattice.cells(u, *args), lattice.cells(v, *args)):
        met |= (h1 == h2) | (n1 == h2[:, None]).any(1) | (n2 == h1[:, None]).any(1)
    assert met.mean() > 0.998


def test_warc(spark):
    pages = [(1, "http://a/", "x"), (2, None, "x"), (3, "u\r\nv", None), (4, "b", ""), (5, "c", "é" * 5000), (6, "d", "line\r\n\r\nWARC/1.1\r\n"), (None, "e", "x")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive_round_trip(spark, table).collect()}
    for i, _, html in pages:
        raw = (html or "").encode()
        assert got[i].payload_bytes == len(raw)
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 2), None: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert warc.archive_round_trip(spark, table.limit(0)).count() == 0


def test_packing(spark, docs, none, corpus):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(packing.default_vocabulary())
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in corpus}
    got = packing.packed_digest(spark, docs).collect()
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in got)
    at = sorted((r.sequence_id * 2048 + r.offset, r.length) for r in got)
    assert [a for a, _ in at] == [sum(n for _, n in at[:k]) for k in range(len(at))]
    assert sum(n for _, n in at) == sum(map(len, ids.values()))
    assert packing.packed_digest(spark, none).count() == 0


def test_rules(spark, docs, none, corpus):
    for r in rules.quality_rules(docs).collect():
        t = dict(corpus)[r.doc_id] or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = list(zip(w, w[1:], w[2:]))
        count = collections.Counter(grams)
        again = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert rules.quality_rules(none).count() == 0


def test_mixing(spark, docs, none, corpus):
    got = mixing.mix(spark, docs).collect()
    size = {i: len(WORD.findall(t or "")) for i, t in corpus}
    assert {r.doc_id: r.size for r in got} == size and all(0 <= r.taken <= 2 * r.size for r in got)
    assert sorted(mixing.mix(spark, docs.repartition(5)).collect()) == sorted(got)
    by = collections.defaultdict(lambda: [0, 0.0])
    for r in got:
        by[r.target][0] += r.taken
    for target, (taken, _) in by.items():
        assert abs(taken - target) <= 0.05 * target + 5
    mixed = collections.Counter()
    for r in mixing.mixture(spark, docs).collect():
        mixed[r.doc_id] += len(WORD.findall(r.text))
    assert mixed == collections.Counter({r.doc_id: r.taken for r in got if r.taken})
    assert mixing.mix(spark, none).count() == 0
    assert mixing.targets({0: 10, 1: 100}, {0: 3, 1: 1}, 165) == {0: 20.0, 1: 145.0}


def test_classifiers(spark, docs, none):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["the", "tree", "water", "stone", "light."]) for _ in range(40)) for _ in range(120)]
    rows = [(k, t if k % 3 else " ".join(x + "###" for x in t.split()) if k % 2 else t + " idiot", "en", "s", 1, "x") for k, t in enumerate(good)] + [(500, None, "en", "s", 0, "x")]
    table = spark.createDataFrame(rows, KINDS)
    labels = spark.createDataFrame([(k, int("###" not in (t or "")), int("idiot" in (t or ""))) for k, t, *_ in rows] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    want = {k: ("###" not in (t or ""), "idiot" in (t or "")) for k, t, *_ in rows if t}
    q = {r.doc_id: r for r in quality.quality_classifier(table, labels).collect()}
    assert np.mean([q[k].predicted == w[0] for k, w in want.items() if q[k].held_out]) > 0.9
    x = {r.doc_id: r for r in toxicity.toxicity(table, labels).collect()}
    assert np.mean([x[k].predicted == w[1] for k, w in want.items() if x[k].held_out]) > 0.9
    assert all(0 <= r.score <= 1 for r in [*q.values(), *x.values()])
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in q.items())
    empty = labels.limit(0)
    assert {r.score for r in quality.quality_classifier(docs, empty).collect()} == {0.5}
    assert toxicity.toxicity(none, empty).count() == 0
