import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from tidegauge.llm import filter_audit

from .helpers import AWKWARD, DOC, docs

LABELS = "doc_id long, quality int, toxic int, part string, mask string"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(words) < 50 else ""
    out += "B" if 100 * len(set(words)) < 65 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else ""
    return out + ("D" if re.search(r"[#$%&*|]", text) else "")


def brute(rows, labels):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = {}
    for order in map("".join, permutations("ABCDE")):
        for i, text, part in rows:
            failed = fails(text or "")
            least = first.get(text or "")
            failed += "E" if least is not None and (i is None or i > least) else ""
            good = max((q == 1 for k, q, _ in labels if k == i and i is not None), default=False)
            toxic = max((t == 1 for k, _, t in labels if k == i and i is not None), default=False)
            gone = False
            for step, x in enumerate(order, 1):
                row = out.setdefault((part or "", order, step), dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"), 0))
                now = x in failed and not gone
                row["removed"] += now
                row["redundant"] += x in failed and gone
                row["unique_fails"] += failed == x
                row["good_lost"] += now and good
                row["toxic_lost"] += now and toxic
                gone |= now
                row["kept"] += not gone
    for (part, order, step), row in out.items():
        row["shapley"] = sum(r["removed"] for (p, o, s), r in out.items() if p == part and o[s - 1] == order[step - 1])
    return out


def frame(spark, rows):
    """Rows of doc_id, text and source, with columns that the operator uses inside."""
    full = [(i, t, "en", s, 0, "k", "x", "c", "z") for i, t, s in rows]
    return spark.createDataFrame(full, DOC).withColumns({c: F.lit("q") for c in ("part", "bits", "class", "blocks", "n", "first")}).repartition(3)


def check(spark, rows, labels):
    got = filter_audit.audit(frame(spark, rows), spark.createDataFrame([(*x, "p", "m") for x in labels], LABELS)).collect()
    want = brute(rows, labels)
    assert len(got) == len(want)
    for r in got:
        row = r.asDict()
        assert want[row.pop("part"), row.pop("filter_order"), row.pop("step")] == row


def test_awkward(spark):
    rng = random.Random(3)
    prose = [" ".join(rng.choice("alpha Beta gamma DELTA eps% zeta".split()) + str(rng.randint(0, 60)) for _ in range(n)) for n in (10, 49, 50, 51, 200)]
    rows = [(*r, rng.choice(["a", "b"])) for r in AWKWARD] + [(20 + k, t, None) for k, t in enumerate(prose * 3)] + [(None, prose[0], ""), (None, prose[0], "a"), (21, prose[0], "a")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(1, 30), 5, 5, 21, 21, 99, None]]
    check(spark, rows, labels)
    assert filter_audit.audit(docs(spark, []), spark.createDataFrame([], LABELS)).count() == 0


def test_refinement_tells_long_texts_apart(spark):
    """Equal lengths and equal beginnings: only the last blocks differ."""
    base = "x" * 3000
    texts = [base, base, base[:-1] + "y", base[:-1] + "y", base[:2000] + "z" + base[2001:], base[:255] + "q" + base[256:], base + "x"]
    rows = [(10 - k, t, "s") for k, t in enumerate(texts)]
    check(spark, rows, [])
    slim = frame(spark, rows).select(F.length("text").alias("n"), filter_audit._blocks(F.col("text")).alias("blocks"))
    assert [r["k"] for r in slim.select(F.size("blocks").alias("k")).distinct().collect()] == [4]
    assert filter_audit.surviving_classes(slim).count() == 2


def test_equal_hashes_of_different_texts_do_no_harm(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "_blocks", lambda text: F.array(F.lit(7).cast("long")))
    rows = [(k, t, "s") for k, t in enumerate(["ab", "cd", "ab", "ef", "cd", "gh", "abc", "ab"])]
    check(spark, [*rows, (None, "cd", "s"), (1, "cd", "s")], [(1, 1, 0)])


def test_one_hot_group(spark):
    check(spark, [(k, "same text" if k % 3 else f"text {k}", f"s{k % 2}") for k in range(900)], [(k, k % 2, int(k % 5 == 0)) for k in range(0, 900, 3)])
