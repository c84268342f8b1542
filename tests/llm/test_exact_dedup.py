import hashlib
import random
import re

import pytest

from tidegauge.llm import exact_dedup
from tidegauge.llm.common import durable

from .helpers import AWKWARD, collect, docs


def brute(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, k))
    out = []
    for norm, group in groups.items():
        keep = min(group)
        for row in group:
            i = rows[row[3]][0]
            out.append((i, rows[keep[3]][0], len(group), hashlib.sha256(norm.encode()).hexdigest()))
    return out


def check(spark, rows):
    df = exact_dedup.decisions(docs(spark, rows)).cache()
    got = collect(df, "doc_id", "keep_id", "group_size", "text_sha256")
    assert got == sorted(brute(rows), key=lambda t: tuple((x is None, str(type(x)), x) for x in t))
    kept = [r for r in df.collect() if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in kept}) == len({r["text_sha256"] for r in df.collect()})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_awkward(spark):
    check(spark, AWKWARD)
    assert exact_dedup.decisions(docs(spark, [])).count() == 0


def test_hot_group(spark):
    rnd = random.Random(3)
    rows = [(i, "copy of one text" if i % 3 == 0 else f"text {rnd.randrange(400)}" + " " * rnd.randrange(3)) for i in range(900)]
    check(spark, rows)


def test_unique_rows_pass_without_shuffle(spark):
    df = docs(spark, [(i, f"text number {i}") for i in range(2000)])
    probed, groups = exact_dedup._prepare(df, "doc_id", "text")
    assert probed.where("candidate").count() < 100
    assert groups.count() == 0
    plan = probed.where("not candidate")._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("blocks", [1, 8])
def test_blocks_of_the_filter(spark, monkeypatch, blocks):
    rows = [*AWKWARD, *[(100 + i, f"text {i % 40}") for i in range(60)], *[(300 + i, f"alone {i}") for i in range(28)]]
    if blocks > 1:
        monkeypatch.setattr(exact_dedup, "MAX_FILTER_BITS", exact_dedup.BITMAP_BITS)
        monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", exact_dedup.BITMAP_BITS * 8 // 128)
    assert exact_dedup.filter_size(100).blocks == blocks
    check(spark, rows)
    kept = collect(exact_dedup.drop_duplicates(docs(spark, rows)), "doc_id", "text")
    assert len(kept) == len({h for *_, h in brute(rows)}) and (6, "Same  text here ") in kept


@pytest.mark.parametrize("blocks", [1, 4])
def test_texts_never_shuffle(spark, monkeypatch, blocks):
    rows = spark.createDataFrame([(f"k{i}", f"text {i}") for i in range(200)], "sha string, text string")
    keys = spark.createDataFrame([(f"k{i}",) for i in range(0, 200, 9)], "key string")
    if blocks > 1:
        monkeypatch.setattr(exact_dedup, "MAX_FILTER_BITS", exact_dedup.BITMAP_BITS)
        monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", exact_dedup.BITMAP_BITS * 4 // 32)
    assert exact_dedup.filter_size(23).blocks == blocks
    written = []
    monkeypatch.setattr(exact_dedup, "durable", lambda df, *a: (written.append(df), durable(df, *a))[1])
    through, known = exact_dedup.split_known(rows, "sha", keys, "key")
    assert {r["sha"] for r in known.collect()} >= {f"k{i}" for i in range(0, 200, 9)}
    assert through.count() + known.count() == 200 and through.count() > 170
    for df in [through, known, *written]:
        if "text" in df.columns:
            assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()


def test_whole_rows_stay(spark):
    df = docs(spark, AWKWARD)
    kept = exact_dedup.drop_duplicates(df)
    assert kept.columns == df.columns
    got = collect(kept, "doc_id", "text")
    assert (6, "Same  text here ") in got and len(got) == len({h for *_, h in brute(AWKWARD)})
    assert collect(kept, "doc_id", "text").count((3, " \n\t")) == 1


def test_a_block_reads_its_own_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(f"k{i}", f"text {i}") for i in range(200)], "sha string, text string")
    keys = spark.createDataFrame([(f"k{i}",) for i in range(0, 200, 9)], "key string")
    monkeypatch.setattr(exact_dedup, "MAX_FILTER_BITS", exact_dedup.BITMAP_BITS)
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", exact_dedup.BITMAP_BITS * 4 // 32)
    written = []
    monkeypatch.setattr(exact_dedup, "durable", lambda df, *a: (written.append(df), durable(df, *a))[1])
    exact_dedup.split_known(rows, "sha", keys, "key")
    texts = [df for df in written if "text" in df.columns]
    # once whole, then each block from its own folder
    assert len(texts) == 5 and "_block" in texts[0].columns
    for df in texts[1:]:
        assert "PartitionFilters: [isnotnull(_block" in df._jdf.queryExecution().executedPlan().toString()
    kept = exact_dedup.only_known(rows, "sha", keys, "key")
    assert {r["sha"] for r in kept.collect()} == {f"k{i}" for i in range(0, 200, 9)} and kept.columns == ["sha", "text"]
