import zlib

from tidegauge.llm import sharding

from .helpers import AWKWARD, docs


def check(spark, rows, shards=8, **more):
    got = sharding.assign_shards(docs(spark, rows), shards, **more).collect()
    assert len(got) == len(rows)
    size = {}
    for i, t in rows:
        raw = (t or "").encode()
        size.setdefault((i, len(raw) + 1, zlib.crc32(raw)), 0)
        size[i, len(raw) + 1, zlib.crc32(raw)] += 1
    for r in got:
        size[r["doc_id"], r["size"], r["text_crc32"]] -= 1
    assert not any(size.values())
    order = sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]))
    total, before = sum(r["size"] for r in got), 0
    by = {}
    for r in order:
        by.setdefault((2 * before + r["size"]) * shards // (2 * total), []).append(r)
        before += r["size"]
    for k in range(shards):
        mine = [r for r in got if r["shard"] == k]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert sorted((r["size"], r["text_crc32"]) for r in mine) == sorted((r["size"], r["text_crc32"]) for r in by.get(k, []))
        assert abs(sum(r["size"] for r in mine) - total / shards) <= max(r["size"] for r in got)


def test_awkward(spark):
    check(spark, AWKWARD)
    assert sharding.assign_shards(docs(spark, [])).count() == 0


def test_many_rows_and_one_hot_id(spark):
    check(spark, [(i if i % 3 else 7, "x" * (i * 37 % 101)) for i in range(2000)], rows_per_range=100)


def test_written_shards(spark, tmp_path):
    rows = [(i, "y" * (i % 50)) for i in range(300)]
    sharding.write_shards(docs(spark, rows), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 300 and back.select("shard").distinct().count() == 4
