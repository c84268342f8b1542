import random

import pytest

from tidegauge.llm import simhash as s

from .helpers import docs


def shingles(text, size=5):
    words = text.lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def pair(rnd, common, own):
    """Two texts without repeated words: ``common - 4`` shingles of five shared, ``own`` more each."""
    word = lambda n: [f"{rnd.getrandbits(48):x}z" for _ in range(n)]
    shared = word(common)
    return " ".join(shared + word(own)), " ".join(shared + word(own))


def brute_kept(rows):
    """Ids that stay when pairs of a similarity of 0.8 or more are joined."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 5 * both >= 4 * (len(sets[x]) + len(sets[y]) - both):
                old, new = label[x], label[y]
                label = [new if k == old else k for k in label]
    least = {}
    for (i, _), k in zip(rows, label, strict=True):
        least[k] = min(i, least.get(k, i))
    return sorted(least.values())


def kept(spark, rows):
    return sorted(r["doc_id"] for r in s.drop_near_duplicates(docs(spark, rows)).collect())


def rows_of(pairs):
    return [(k, t) for k, t in enumerate(t for p in pairs for t in p)]


def test_less_similar_sets_stay(spark):
    rnd = random.Random(1)
    rows = rows_of([pair(rnd, 204, 39) for _ in range(40)] + [pair(rnd, 204, 8) for _ in range(5)])
    assert brute_kept(rows) == [*range(80), *range(80, 90, 2)]
    assert kept(spark, rows) == brute_kept(rows)


@pytest.mark.parametrize("sizes", [{}, {"BLOCK_ROWS": 5, "BLOCK_HASHES": 700}])
def test_groups_of_every_similarity(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(s, name, value)
    rnd = random.Random(2)
    texts = []
    for _ in range(4):
        base = pair(rnd, 150, 0)[0].split()
        for _ in range(12):
            own = list(base)
            a = rnd.randrange(100)
            own[a : a + rnd.choice((2, 6, 12))] = pair(rnd, rnd.choice((2, 6, 12)), 0)[0].split()
            texts.append(" ".join(own))
            base = own if rnd.random() < 0.5 else base
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    # all is decided by exact similarity if the bits let everything through
    got = sorted(r["doc_id"] for r in s.drop_near_duplicates(docs(spark, rows), max_bits=64, wide_bits=256).collect())
    assert got == brute_kept(rows) and 4 < len(got) < len(rows)


def test_repeated_passages_count_once(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(0, 40, 2):
        own, line = pair(rnd, 204, 0)[0].split(), pair(rnd, 24, 0)[0].split()
        # the shingles that repeats of the line add are there without them
        text = own + line * 2
        rows += [(k, " ".join(text)), (k + 1, " ".join(own + line * 12))]
    assert all(shingles(rows[k][1]) == shingles(rows[k + 1][1]) for k in range(0, 40, 2))
    assert kept(spark, rows) == list(range(0, 40, 2))
    line = pair(rnd, 14, 0)[0]
    unrelated = [(k, pair(rnd, 204, 0)[0] + f" {line}" * 20) for k in range(20)]
    assert kept(spark, unrelated) == brute_kept(unrelated) == list(range(20))


def test_pairs_around_the_limit_match_brute_force(spark):
    rnd = random.Random(4)
    # 25 words of their own each: exactly 0.8; 26: just less
    rows = rows_of([pair(rnd, 204, n) for n in (23, 24, 25) * 60 + (26, 27) * 30])
    want = brute_kept(rows)
    assert len(want) == len(rows) - 180
    assert kept(spark, rows) == want


def test_small_sets(spark):
    rnd = random.Random(5)
    texts = []
    for k in range(120):
        words = pair(rnd, 9 + k % 4, 0)[0].split()
        texts += [" ".join(words), " ".join(words[:-1])]
    rows = list(enumerate(texts))
    assert kept(spark, rows) == brute_kept(rows)
