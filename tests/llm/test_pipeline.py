import os
import random

import pytest

import corpus_pipeline
from tidegauge.llm import exact_dedup, simhash

from .helpers import AWKWARD, collect, docs

SF = "/root/testdata/sf0.001"


def test_near_duplicates_keep_whole_rows(spark):
    rnd = random.Random(6)
    base = [" ".join(rnd.choices([f"w{k}" for k in range(900)], k=300)) for _ in range(20)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k, t in enumerate(base[:10]):
        words = t.split()
        words[150] = "changed"
        rows += [(100 + k, " ".join(words)), (None, t)]
    rows += [(300, "one of two"), (300, "one of two"), (300, "another text of that id")] + AWKWARD
    df = docs(spark, rows)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = collect(kept, "doc_id", "text")
    assert [x for x in got if x[0] is not None and x[0] < 300 and x[0] not in dict(AWKWARD)] == [(k, base[k]) for k in range(20) if k not in dict(AWKWARD)]
    assert len([x for x in got if x[0] == 300]) == 2
    assert len([x for x in got if x[1] == "Same text here"]) == 1
    assert simhash.drop_near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_keep_columns_and_filter(spark):
    table = now = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [now.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).cache()
        assert now.dtypes == table.dtypes
        assert now.join(table, ["doc_id", "text", "source"]).count() == now.count()
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0]
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == sizes[-1] and out.where("not round_trip").count() == 0


def test_empty_tables(spark, tmp_path):
    docs(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_awkward_rows(spark, tmp_path):
    prose = {"en": "the cat and the dog went to the house by the river with them ", "fr": "le chat et le chien sont dans la maison avec les autres pour une heure "}
    rows = [(k, f"{prose[x] * 4}{x}{k} {k * 7 % 11}", x) for k, x in enumerate(["en", "fr"] * 15, 1000)]
    rows += [(i, t, None) for i, t in AWKWARD] + [(2000, "a b c d e f g h i j k and more the end of it", "en"), (2000, None, None)]
    table = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, "A b, c d e f g h i j k"), (2, None), (None, "null id")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, counts = table, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        counts[name] = collect(now, "doc_id", "text")
    assert not any(t is None or not any(c.isalpha() for c in t) for _, t in counts["language_id"])
    assert [t for _, t in counts["exact_dedup"] if "Same" in t] == ["Same  text here "]
    assert sum(t == "a" * 5000 for _, t in counts["near_dedup"]) == 1
    assert not any(t in ("null id", rows[-2][1]) for _, t in counts["decontamination"])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == len(counts["decontamination"]) > 4 and out.where("not round_trip").count() == 0


def test_stages_carry_other_columns(spark, tmp_path):
    """Extra columns, named as the operators name theirs, come through whole; empty tables do too."""
    prose = "the cat and the dog went to the house by the river with them and "
    rows = [(k, prose * 3 + f"w{k} v{k * 7}", "en") for k in range(1000, 1020)] + [(3, prose * 3 + "w1000 v7000", "en"), (4, None, None), (5, "ends in the item of ten words which is right here", "en")]
    extra = ("_row", "_sha", "_text", "_key", "_place", "_block", "_hit", "sha", "hit", "items", "candidate", "place", "node", "fp", "lang_pred", "score")
    table = docs(spark, rows)
    for c in extra:
        table = table.withColumn(c, table["doc_id"].cast("string"))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "ends in the item of ten words which is right here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = empty = spark.read.parquet(str(tmp_path / "documents.parquet"))
    empty = empty.where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now, empty = stage(spark, now, str(tmp_path)), stage(spark, empty, str(tmp_path))
        assert now.columns == table.columns == empty.columns
        assert all(r[c] == str(r["doc_id"]) for r in now.collect() for c in extra) and empty.count() == 0
    kept = {r["doc_id"] for r in now.collect()}
    assert kept == {1000 + k for k in range(1, 20)} | {3} or kept == {1000 + k for k in range(20)}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept)


def test_near_duplicates_with_blocks_of_the_filter(spark, monkeypatch):
    rows = [(k, f"text {k % 4} " + "same words follow here and there " * 20) for k in range(12)] + AWKWARD
    want = collect(simhash.drop_near_duplicates(docs(spark, rows)), "doc_id", "text")
    monkeypatch.setattr(exact_dedup, "MAX_FILTER_BITS", exact_dedup.BITMAP_BITS)
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", exact_dedup.BITMAP_BITS // 4)
    assert collect(simhash.drop_near_duplicates(docs(spark, rows)), "doc_id", "text") == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_language_stage_drops_what_is_no_learned_language(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rnd = random.Random(8)

    def letters(words, alphabet):
        return " ".join("".join(rnd.choices(alphabet, k=rnd.randrange(2, 10))) for _ in range(words))

    bad = [letters(n, a) for n in (20, 50, 200, 1000) for a in ("abcdefghijklmnopqrstuvwxyz", "asdfghjkl", "qwertyuiop") for _ in range(5)]
    bad += [
        "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem",
        "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto",
        "bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar akıl ve vicdana sahiptirler ve birbirlerine karşı",
    ]
    clean = [r["text"] for r in table.where("lang is not null and length(text) > 200").orderBy("doc_id").limit(100).collect()]
    good = [" ".join(t.split()[:n]) for t in clean for n in (5, 10, 40)]
    rows = [(10**9 + k, t) for k, t in enumerate(bad + good)]
    more = docs(spark, rows).select(*table.columns)
    out = corpus_pipeline.language_id(spark, table.unionByName(more), "")
    stayed = {r["doc_id"] for r in out.where("doc_id >= 1000000000").select("doc_id").collect()}
    assert not stayed & {10**9 + k for k in range(len(bad))}
    assert len(stayed) == len(good)
    worded = table.where("text rlike '[a-zA-Z]'").select("doc_id")
    assert worded.join(out, "doc_id", "left_anti").count() == 0
