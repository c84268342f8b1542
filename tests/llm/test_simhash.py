import random

import numpy as np
import pytest
import xxhash

from tidegauge.llm import simhash as s

from .helpers import AWKWARD, collect, docs


def brute_fingerprint(text, shingle=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, max_bits, ids):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(fps, np.uint64)
    for x in range(len(a)):
        for y in np.flatnonzero(np.bitwise_count(a ^ a[x]) <= max_bits).tolist():
            parent[find(x)] = find(y)
    least = {}
    for x, i in enumerate(ids):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return [least.get(find(x)) for x in range(len(a))]


def check(spark, rows):
    got = collect(s.near_duplicates(docs(spark, rows)), "doc_id", "fingerprint", "component_id")
    fps = [brute_fingerprint(t) for _, t in rows]
    comps = brute_components(fps, 4, [i for i, _ in rows])
    want = [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, comps, strict=True)]
    assert got == sorted(want, key=lambda t: tuple((x is None, str(type(x)), x) for x in t))


def texts(n, seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(500)]
    out = []
    for k in range(n):
        if k % 3 and out:
            t = rnd.choice(out).split()
            t[rnd.randrange(len(t))] = rnd.choice(words)
            out.append(" ".join(t))
        else:
            out.append(" ".join(rnd.choices(words, k=rnd.randrange(1, 120))))
    return out


def test_awkward(spark):
    check(spark, AWKWARD)
    assert s.near_duplicates(docs(spark, [])).count() == 0


def test_edited_copies(spark):
    check(spark, [(1000 - k, t) for k, t in enumerate(texts(300, 1))])


def planted(n, seed, clusters=6, radius=5):
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(clusters)]
    out = []
    for k in range(n):
        f = rnd.choice(centres) if k % 2 else rnd.getrandbits(64)
        for _ in range(rnd.randrange(radius) if k % 2 else 0):
            f ^= 1 << rnd.randrange(64)
        out.append(f)
    return out


@pytest.mark.parametrize("m,thresholds", [(5, [0] * 5), (4, [1, 0, 0, 0]), (3, [1, 1, 0]), (3, [2, 0, 0]), (2, [2, 1]), (6, [0, 0, -1, 0, 0, 0])])
def test_every_allocation_finds_all_links(spark, m, thresholds):
    fps = sorted(set(planted(500, m)))
    rows = [(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    groups = [g.tolist() for g in np.array_split(np.random.default_rng(m).permutation(64), m)]
    edges = s.links(df, 4, chosen=s.Plan(groups, thresholds, 0.0)).collect()
    of = {f: i for i, f in rows}
    linked = list(range(len(fps)))

    def find(x):
        while linked[x] != x:
            x = linked[x]
        return x

    for e in edges:
        x, y = sorted((find(of[e["a"]]), find(of[e["b"]])))
        linked[y] = x
    assert [find(x) for x in range(len(fps))] == brute_components(fps, 4, range(len(fps)))


def test_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(s, "SMALL_BUCKET", 4)
    fps = sorted(set(planted(800, 9, clusters=1)))
    words = np.array([fps], np.uint64)
    a, b = s._forest(*s._search(words, np.ones(len(fps), bool), 4, 0))
    comps = brute_components(fps, 4, range(len(fps)))
    assert len(a) == len(fps) - len(set(comps))
    zeros = np.zeros(len(fps), np.int64)
    assert len(s._bucket_edges(zeros, zeros, zeros == 0, words, 4, 0)[0]) == len(a)


def test_plan_uses_unequal_thresholds_on_large_corpora():
    both = np.full((64, 64), 0.25)
    np.fill_diagonal(both, 0.5)
    for n in (10**4, 10**7, 10**9):
        chosen = s.plan(n, both * n)
        assert sum(chosen.thresholds) == 4 - len(chosen.groups) + 1
        assert sorted(b for g in chosen.groups for b in g) == list(range(64))
    assert max(chosen.thresholds) > 0
    bounded = s.plan(10**9, both * 10**9, 14, 1e17, 48, 2)
    assert 2 * sum(s._rows(len(g), t) for g, t in zip(bounded.groups, bounded.thresholds, strict=True)) <= 48
    skewed = both * 10**6
    skewed[:16, :16] = 0.999e6
    chosen = s.plan(10**6, skewed)
    assert len(set(chosen.thresholds)) > 1


def test_bands_hold_similar_sizes_together():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 40, 999, 12345):
        other = rng.integers(int(np.ceil(0.8 * n)), int(n / 0.8) + 1)
        assert abs(s.size_band(np.arange(n, dtype=np.uint64)) - s.size_band(np.arange(other, dtype=np.uint64))) <= 1


def test_wide_search_finds_similar_sets(spark):
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for k in range(60):
        base = rnd.choices(words, k=400)
        rows.append((2 * k, " ".join(base)))
        near = list(base)
        for _ in range(6):
            near[rnd.randrange(400)] = rnd.choice(words)
        rows.append((2 * k + 1, " ".join(near)))
    got = {r["doc_id"]: r["component_id"] for r in s.near_duplicates(docs(spark, rows), shingle=5, max_bits=14, wide_bits=51).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(60)) >= 58
    assert all(c // 2 == i // 2 for i, c in got.items())


@pytest.mark.parametrize("m,thresholds", [(3, [2, 0, 0]), (2, [2, 1]), (5, [0] * 5)])
def test_heavy_keys_are_dealt_in_blocks(spark, monkeypatch, m, thresholds):
    """Bits that hardly vary put most rows under few keys; no cell of blocks then holds a whole key, and no link is lost."""
    monkeypatch.setattr(s, "BLOCK_ROWS", 40)
    rnd = random.Random(m)
    fps = sorted({f & 0xFFFFFF for f in planted(500, m + 20, clusters=4)} | {rnd.getrandbits(24) for _ in range(100)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    groups = [g.tolist() for g in np.array_split(np.arange(64), m)]
    chosen = s.Plan(groups, thresholds, 0.0)
    rows = df.mapInArrow(s._signatures(chosen), s.SIGNATURE)
    sizes = {(r["part"], r["key"]): r["count"] for r in rows.groupBy("part", "key").count().collect()}
    heavy = s.heavy_keys(df, chosen, 40)
    want = {k: -(-n // 40) for k, n in sizes.items() if n > 40}
    assert want and {(r["part"], r["key"]): r["blocks"] for r in heavy.collect()} == want
    largest = s._dealt(rows, heavy).groupBy("part", "key", "i", "j").count().agg({"count": "max"}).first()[0]
    assert largest <= 160 < max(sizes.values())
    linked = {f: f for f in fps}

    def find(x):
        while linked[x] != x:
            x = linked[x]
        return x

    for e in s.links(df, 4, chosen=chosen).collect():
        x, y = sorted((find(e["a"]), find(e["b"])))
        linked[y] = x
    assert [find(f) for f in fps] == brute_components(fps, 4, fps)
