import hashlib
import random
import re

from tidegauge.llm import decontam

from .helpers import AWKWARD, collect, docs


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items):
    out = []
    for i, t in rows:
        doc, hit, found = words(t), set(), set()
        for item_id, text in items:
            item = words(text)
            n = min(10, len(item))
            for a in range(len(item) - n + 1 if item else 0):
                for p in range(len(doc) - n + 1):
                    if doc[p : p + n] == item[a : a + n]:
                        hit.update(range(p, p + n))
                        found.add(str(item_id) if item_id is not None else "")
        out.append((i, len(doc), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x) for x in t))


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string") if items else spark.createDataFrame([], "item_id long, text string")


def corpus(seed):
    rnd = random.Random(seed)
    vocab = ["the", "of", "a", "an", "Über", "x1", "no", "so", "it", "be"]
    items = [(k, " ".join(rnd.choices(vocab, k=rnd.choice([1, 2, 5, 9, 10, 11, 15, 30])))) for k in range(12)] + [(3, "again a repeated id"), (99, None), (None, "it be it be it be so no")]
    items += [(200, "the the the the the the the the the the the the the the")]
    rows = []
    for k in range(80):
        text = rnd.choices(vocab + ["zzz"], k=rnd.randrange(0, 60))
        if k % 3 == 0:
            piece = words(rnd.choice(items)[1])
            a = rnd.randrange(max(1, len(piece) - 9))
            text[len(text) // 2 : len(text) // 2] = piece[a : a + rnd.randrange(8, 14)]
        rows.append((k, "  ".join(text).replace("the", rnd.choice(["the", "The", "THE-"]))))
    return rows, items


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows, items = corpus(seed)
        got = collect(decontam.find_contamination(docs(spark, rows), bench(spark, items)), *COLUMNS)
        assert got == brute(rows, items)


def test_blocks_of_items_one_at_a_time(spark, monkeypatch):
    rows, items = corpus(3)
    alive, most = set(), [0]
    context = spark.sparkContext
    blocks = list(decontam.item_blocks(bench(spark, items), max_bytes=60))
    assert len(blocks) > 3 and [last for _, last in blocks] == [False] * (len(blocks) - 1) + [True]
    assert sum(len(x) for x, _ in blocks) == len(items)
    monkeypatch.setattr(type(context), "broadcast", lambda self, x, f=type(context).broadcast: Live(f(self, x)) if isinstance(x, decontam.Index) else f(self, x))

    class Live:
        def __init__(self, shared):
            self.shared = shared
            alive.add(id(self))
            most[0] = max(most[0], len(alive))

        def destroy(self):
            alive.discard(id(self))
            self.shared.destroy()

        def __reduce__(self):
            return (lambda x: x, (self.shared,))

    got = decontam.find_contamination(docs(spark, rows), bench(spark, items), max_block_bytes=60)
    assert collect(got, *COLUMNS) == brute(rows, items)
    kept = decontam.drop_contaminated(docs(spark, rows), bench(spark, items), max_block_bytes=60)
    assert collect(kept, "doc_id") == [(r[0],) for r in brute(rows, items) if not r[5]]
    assert most[0] <= 2  # of either call's last block at most one stays


def test_awkward(spark):
    items = [(1, "Same text here"), (2, ""), (3, "word " * 12)]
    assert collect(decontam.find_contamination(docs(spark, AWKWARD), bench(spark, items)), *COLUMNS) == brute(AWKWARD, items)
    assert collect(decontam.find_contamination(docs(spark, AWKWARD), bench(spark, [])), *COLUMNS) == brute(AWKWARD, [])
    assert decontam.find_contamination(docs(spark, []), bench(spark, items)).count() == 0
    kept = decontam.drop_contaminated(docs(spark, AWKWARD), bench(spark, items))
    assert kept.columns == docs(spark, []).columns
    assert kept.count() == sum(not r[5] for r in brute(AWKWARD, items))


def test_guarantee_of_winnowing():
    rnd = random.Random(8)
    item = [rnd.randrange(50) for _ in range(40)]
    index = decontam.build_index([("i", " ".join(f"v{x}" for x in item))])
    for a in range(31):
        doc = ["q"] * rnd.randrange(3) + [f"v{x}" for x in item[a : a + 10]] + ["q"] * 4
        (n, hit, items), = decontam.judge([" ".join(doc)], index)
        assert len(hit) == 10 and items == {"i"} and n == len(doc)


def test_passes_write_hits_and_never_texts(spark, monkeypatch):
    rows, items = corpus(4)
    written = []
    monkeypatch.setattr(decontam, "durable", lambda df, *a, f=decontam.durable: (written.append(df), f(df, *a))[1])
    passes = len(list(decontam.item_blocks(bench(spark, items), max_bytes=60)))
    hit = [r for r in brute(rows, items) if r[5]]
    kept = decontam.drop_contaminated(docs(spark, rows), bench(spark, items), max_block_bytes=60)
    assert len(written) == passes + 1 and all("text" not in df.columns for df in written)
    assert written[-1].count() <= len(hit) and kept.count() == len(rows) - len(hit)


def test_blocks_and_awkward_rows(spark):
    items = [(1, "Same text here"), (2, ""), (3, "word " * 12), (4, "null id"), (None, "naive cafe")]
    found = decontam.find_contamination(docs(spark, AWKWARD), bench(spark, items), max_block_bytes=10)
    assert collect(found, *COLUMNS) == brute(AWKWARD, items)
    assert decontam.find_contamination(docs(spark, []), bench(spark, items), max_block_bytes=10).count() == 0
    kept = decontam.drop_contaminated(docs(spark, AWKWARD), bench(spark, items), max_block_bytes=10)
    assert kept.columns == docs(spark, []).columns and kept.count() == sum(not r[5] for r in brute(AWKWARD, items))
