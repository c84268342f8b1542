"""The search for similar sets goes through partitions and thresholds and finds what comparing all pairs finds."""

import random

import numpy as np
import pytest

from tidegauge.llm import simhash as s

BANDS = 3


def sets_of(spark, n, seed):
    """Wide fingerprints around a few centres, in bands that do or do not meet."""
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(256) for _ in range(8)]
    rows = []
    for k in range(n):
        f = rnd.choice(centres)
        for b in rnd.sample(range(256), rnd.randrange(60)):
            f ^= 1 << b
        words = [(f >> 64 * w) & (1 << 64) - 1 for w in range(4)]
        rows.append((k, rnd.randrange(BANDS), *words))
    signed = [(k, band, *(w - (1 << 64) if w >> 63 else w for w in words)) for k, band, *words in rows]
    return rows, spark.createDataFrame(signed, "node long, band long, " + ", ".join(f"{c} long" for c in s._WORD_NAMES))


def joined(n, edges):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        label[y] = x
    return [find(x) for x in range(n)]


def brute(rows, max_bits, wide_bits):
    out = []
    for x, band, *a in rows:
        for y, other, *b in rows[:x]:
            bits = [(v ^ w).bit_count() for v, w in zip(a, b, strict=True)]
            if abs(band - other) <= 1 and bits[0] <= max_bits and sum(bits) <= wide_bits:
                out.append((y, x))
    return out


@pytest.mark.parametrize("block", [1 << 17, 7])
@pytest.mark.parametrize("limits", [(14, 51), (22, 72), (64, 72)])
def test_partitions_find_all_candidates(spark, monkeypatch, block, limits):
    monkeypatch.setattr(s, "BLOCK_ROWS", block)
    rows, df = sets_of(spark, 160, 1)
    got = [(r["a"], r["b"]) for r in s.candidates(df, *limits).collect()]
    want = joined(len(rows), brute(rows, *limits))
    assert joined(len(rows), got) == want and 1 < len(set(want)) < len(rows)


@pytest.mark.parametrize("m,thresholds", [(5, [2, 2, 2, 2, 2]), (8, [1, 1, 1, 1, 1, 1, 0, 1]), (16, [-1] + [0] * 15)])
def test_thresholds_of_every_kind_find_all(spark, m, thresholds):
    rows, df = sets_of(spark, 160, m)
    groups = [g.tolist() for g in np.array_split(np.random.default_rng(m).permutation(64), m)]
    most = sum(thresholds) + m - 1
    got = [(r["a"], r["b"]) for r in s.candidates(df, most, 60, s.Plan(groups, thresholds, 0.0)).collect()]
    assert joined(len(rows), got) == joined(len(rows), brute(rows, most, 60))


def test_the_stage_plans_by_the_bits(spark):
    _, df = sets_of(spark, 400, 3)
    chosen = s.wide_plan(df, s.SIMILAR_BITS)
    assert sum(chosen.thresholds) == s.SIMILAR_BITS - len(chosen.groups) + 1
    assert sorted(b for g in chosen.groups for b in g) == list(range(64))
    assert 2 * sum(s._rows(len(g), t) for g, t in zip(chosen.groups, chosen.thresholds, strict=True)) <= s.MAX_WIDE_ROWS
