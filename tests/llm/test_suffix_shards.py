"""A shard of the suffix sort: the same spans as brute force, with each text sorted once."""

import numpy as np
import pytest

from gridlake.llm import suffix
from gridlake.llm.anchors import Plan, Sender, Shard, merged

W, K = 40, 8


def shard(tasks, crowded=()):
    """What one shard receives from tasks of (doc, bytes)."""
    blobs = []
    for docs in tasks:
        sender = Sender(W, K, Plan(1, np.array(crowded, np.int64)), False, 1 << 16)
        for doc, raw in docs:
            symbols = np.frombuffer(raw, np.uint8)
            for b in sender.add(doc, suffix._VALUES[symbols], symbols):
                blobs += b.column("blob").to_pylist()
        for b in sender.flush():
            blobs += b.column("blob").to_pylist()
    return Shard(blobs)


def spans(s):
    doc, lo, hi = (np.concatenate(p) for p in zip(suffix._judge(W)(s), s.spans))
    return {int(d): merged(lo[doc == d], hi[doc == d]).tolist() for d in np.unique(doc)}


def brute(docs):
    times = {}
    for _, raw in docs:
        for k in range(len(raw) - W + 1):
            times[raw[k : k + W]] = times.get(raw[k : k + W], 0) + 1
    out = {}
    for doc, raw in docs:
        at = np.array([k for k in range(len(raw) - W + 1) if times[raw[k : k + W]] > 1], np.int64)
        if len(at):
            out[doc] = merged(at, at + W).tolist()
    return out


def corpus(rng, n, letters):
    """Texts with copies, near copies, passages in common, repeats of their own and runs of one byte."""
    docs = [bytes(rng.integers(97, 97 + letters, rng.integers(0, 600), dtype=np.uint8)) for _ in range(n)]
    for i in range(0, n - 3, 4):
        docs[i + 1] = docs[i] + docs[i + 1][:50]
        docs[i + 2] = docs[i][:170] + b"#" + docs[i][171:] if i % 8 else docs[i]
    docs += [docs[0] + docs[0], b"\xff" * 300, b"\x00" * 90 + docs[1], b"x" * W, b"x" * (W - 1), b""]
    return list(enumerate(docs))


@pytest.mark.parametrize("letters", [1, 2, 26])
@pytest.mark.parametrize("crowded", [(), range(0, 1 << 22, 2)])
def test_spans_equal_brute_force(letters, crowded):
    docs = corpus(np.random.default_rng(letters), 24, letters)
    assert spans(shard([docs[0::3], docs[1::3], docs[2::3]], crowded)) == brute(docs)


def test_keys_without_room_for_places(monkeypatch):
    docs = corpus(np.random.default_rng(5), 24, 26)
    s, tie = shard([docs[::2], docs[1::2]]), suffix._tie
    monkeypatch.setattr(suffix, "_tie", lambda key, bits: tie(key, 64))
    assert spans(s) == brute(docs)


def test_refine_numbers_are_in_the_order_of_the_strings():
    text = np.frombuffer(bytes(np.random.default_rng(9).integers(97, 99, 3000, dtype=np.uint8)), np.uint8)
    for depth in (1, 5, 8, 13):
        got = suffix.refine(text, np.full(len(text), len(text)), depth)
        have = [text[k : k + depth].tobytes() if k + depth <= len(text) else None for k in range(len(text))]
        n = {w: have.count(w) for w in set(have) - {None}}
        assert [b >= 0 for b in got.tolist()] == [n.get(w, 0) > 1 for w in have]
        pairs = sorted({(w, b) for w, b in zip(have, got.tolist()) if b >= 0})
        assert [b for _, b in pairs] == sorted({b for _, b in pairs})


def test_each_text_is_sorted_once(monkeypatch):
    rng = np.random.default_rng(3)
    text, other = (bytes(rng.integers(97, 123, 2000, dtype=np.uint8)) for _ in range(2))
    near = text[:1000] + b"#" + text[1001:]
    # each task has the copies once, so that only the shard can tell that they are equal
    docs = [[(10 * i, text), (10 * i + 1, other)] for i in range(20)] + [[(999, near)]]
    s, sizes, refine = shard(docs), [], suffix.refine
    monkeypatch.setattr(suffix, "refine", lambda t, ends, depth: sizes.append(len(t)) or refine(t, ends, depth))
    assert spans(s) == brute([d for task in docs for d in task])
    # of 20 copies one, and only around the byte where the near copy differs
    assert sum(sizes) < len(text)
