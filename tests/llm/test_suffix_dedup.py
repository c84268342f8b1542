import hashlib
import random

import numpy as np
import pytest

from tidegauge.llm import suffix_dedup as s

from .helpers import AWKWARD, collect, docs


def brute(rows, length):
    seen = {}
    for k, (_, t) in enumerate(rows):
        raw = (t or "").encode()
        for a in range(len(raw) - length + 1):
            seen.setdefault(raw[a : a + length], []).append((k, a))
    cover = [np.zeros(len((t or "").encode()), bool) for _, t in rows]
    for places in seen.values():
        if len(places) > 1:
            for k, a in places:
                cover[k][a : a + length] = True
    out = []
    for (i, t), c in zip(rows, cover, strict=True):
        raw = (t or "").encode()
        kept = bytes(b for b, gone in zip(raw, c, strict=True) if not gone)
        spans = int((np.diff(np.concatenate([[0], c.astype(np.int8)])) == 1).sum())
        out.append((i, len(raw), int(c.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x) for x in t))


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def corpus(seed, n=60, alphabet="abcdefgh "):
    rnd = random.Random(seed)
    shared = ["".join(rnd.choices(alphabet, k=rnd.randrange(20, 90))) for _ in range(6)]
    rows = []
    for k in range(n):
        text = ""
        for _ in range(rnd.randrange(4)):
            text += "".join(rnd.choices(alphabet, k=rnd.randrange(60))) + rnd.choice([*shared, "ü" * 30, "ab" * 25, "z" * 45])
        rows.append((k, text))
    return rows + [(k + 1000, t) for k, t in rows[:5]] + [(5000 + k, shared[0] * 2 + str(k)) for k in range(20)]


@pytest.mark.parametrize("hot,cell", [(4096, 21), (0, 5), (0, 1), (3, 7)])
def test_against_brute_force(spark, hot, cell):
    for seed in (1, 2):
        rows = corpus(seed)
        got = s.remove_repeats(docs(spark, rows), length=40, gram=8, hot=hot, cell=cell)
        assert collect(got, *COLUMNS) == brute(rows, 40)


def test_pieces(spark, monkeypatch):
    rows = corpus(7)
    raw = [t.encode() for _, t in rows if len(t.encode()) >= 40]
    whole = [list(zip(*map(np.ndarray.tolist, x), strict=True)) for x in s.find_runs(raw, 40, 8)]
    monkeypatch.setattr(s, "_PIECE", 100)
    covered = [(t, w) for x in s.find_runs(raw, 40, 8) for t, _, a, b in zip(*map(np.ndarray.tolist, x), strict=True) for w in range(a, b + 1)]
    assert sorted(covered) == [(t, w) for t, x in enumerate(raw) for w in range(len(x) - 39)]
    assert sorted(covered) == sorted((t, w) for x in whole for t, _, a, b in x for w in range(a, b + 1))
    anchor = {}
    for x in s.find_runs(raw, 40, 8):
        for t, h, a, b in zip(*map(np.ndarray.tolist, x), strict=True):
            for w in range(a, b + 1):
                assert anchor.setdefault(raw[t][w : w + 40], h) == h


def test_awkward(spark):
    assert collect(s.remove_repeats(docs(spark, AWKWARD)), *COLUMNS) == brute(AWKWARD, 400)
    assert s.remove_repeats(docs(spark, [])).count() == 0


def test_refinement_is_a_sort_of_windows():
    rnd = np.random.default_rng(3)
    data = rnd.integers(0, 3, 600).astype(np.uint8)
    data[300:420] = data[50:170]
    bucket = np.repeat([0, 1], 300)
    for length in (8, 12, 16, 20, 33):
        windows = np.concatenate([np.arange(0, 300 - length + 1), np.arange(300, 600 - length + 1)])
        got = s.refine(data, bucket, length, windows)
        keys = [(bucket[w], data[w : w + length].tobytes()) for w in windows.tolist()]
        assert got.tolist() == [keys.count(k) > 1 for k in keys]
    one = s.refine(data, np.zeros(600, int), 33, np.arange(568))
    assert one[50:138].all() and one[300:388].all()
