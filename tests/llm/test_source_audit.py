import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidegauge.llm import source_audit

from .helpers import AWKWARD, DOC, docs


def brute(rows, min_docs, top):
    """Rows of text, lang and source; every rate of every term, one by one."""
    found = [("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""), a or "", b or "") for t, a, b in rows]
    found = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t), a, b) for t, a, b in found]
    out = set()
    for lang in {a for _, a, _ in found}:
        own = [(w, b) for w, a, b in found if a == lang]
        seen = Counter(x for w, _ in own for x in set(w))
        kept = {x for x, n in seen.items() if n >= min_docs}
        v = len(kept)
        counts = {b: Counter() for _, b in own}
        for w, b in own:
            counts[b].update(x for x in w if x in kept)
        everywhere = sum(counts.values(), Counter())
        rate = lambda c, x: 1 + 10**9 * (c[x] + 5) // (sum(c.values()) + 5 * v)
        for b, c in counts.items():
            far = [(sum(abs(rate(c, x) - rate(d, x)) for x in kept), e) for e, d in counts.items() if e != b]
            over = [(rate(c, x) - rate(everywhere, x), x) for x in kept if c[x] and rate(c, x) > rate(everywhere, x)]
            for part, items, most in (("pair", far, len(far)), ("term", over, top)):
                ranked = sorted(items, key=lambda i: (-i[0], i[1].encode()))[:most]
                out |= {(lang, b, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)}
    return out


def check(spark, rows, min_docs=3, top=5):
    full = [(k, t, a, b, 0, "k", "x", "c", "z") for k, (t, a, b) in enumerate(rows)]
    table = spark.createDataFrame(full, DOC).withColumns({c: F.lit("q") for c in ("term", "terms", "n", "lang_n", "total", "v", "zero", "p")}).repartition(3)
    got = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in source_audit.divergence(table, min_docs, top).collect()]
    want = brute(rows, min_docs, top)
    assert len(got) == len(want) and set(got) == want


def test_awkward(spark):
    rng = random.Random(8)
    vocabulary = "the The été ÉTÉ x1y z_z 日本語 of-and &co; straße a b c d e f g h".split()
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randint(0, 12))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, "é"])) for _ in range(150)]
    rows += [(t, "en", "odd") for _, t in AWKWARD] + [(None, "en", "empty"), ("123", "xx", "one"), ("", "xx", "two"), (None, None, "three")]
    rows += [("a b c " * 4000, "de", "s1")] * 4
    check(spark, rows)
    assert source_audit.divergence(docs(spark, [])).count() == 0


def test_many_sources_and_one_hot(spark):
    rng = random.Random(9)
    rows = [(" ".join(f"w{chr(97 + int(rng.expovariate(0.2)) % 26)}" for _ in range(20)), "en", "hot" if k % 3 == 0 else f"s{k % 40}") for k in range(400)]
    check(spark, rows, top=10)


def test_rates_are_exact_beyond_a_long(spark):
    n, total, v = 4 * 10**17, 9 * 10**17 + 1, 12345
    got = spark.range(1).select(source_audit.rate(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * v)
