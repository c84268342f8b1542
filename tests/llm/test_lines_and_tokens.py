import time
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegauge.llm import line_dedup, token_counts, url_filter
from tidegauge.llm.bpe import Codec, read_vocabulary

from .helpers import AWKWARD, docs

PATH = P.path("byte_bpe_50k.json")


def brute_lines(rows, ratio, min_pages):
    split = [(i, h or "", [x.strip() for x in (t or "").split("\n") if x.strip()]) for i, h, t in rows]
    out = []
    for i, h, lines in split:
        mine = [set(x) for _, g, x in split if g == h]
        gone = {x for x in lines if h and (n := sum(x in m for m in mine)) >= min_pages and n > ratio * len(mine)}
        kept = [x for x in lines if x not in gone]
        out.append((i, h, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(map(str, out))


def test_lines_against_brute_force(spark):
    rows = [(k, ["a.com", "b.com", "", None][k % 4 if k % 3 else 0], f"menu\nline {k}\n{'menu' if k % 2 else 'foot ' + str(k % 5)}\n\n x{k % 7} ") for k in range(90)]
    rows += [(None, "a.com", None), (500, "one.org", "menu\nfoot"), (500, "one.org", "menu\nfoot"), (501, "a.com", ""), (502, "a.com", "long " * 5000)]
    df = spark.createDataFrame(rows, "page_id long, h string, t string").withColumn("boilerplate", F.lit("clash")).repartition(3)
    got = line_dedup.drop_boilerplate(df, F.col("h"), F.col("t")).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_lines(rows, line_dedup.RATIO, line_dedup.MIN_PAGES)
    assert line_dedup.drop_boilerplate(df.limit(0), F.col("h"), F.col("t")).count() == 0


def test_html_text(spark):
    html = '<html><head><title>T</title><script>var a="</p>";\n</script></head><body><p>One <b>two</b><br>three</p><!-- no\n --><div class="x">4 &lt; 5</div><prefix>z</prefix>'
    df = spark.createDataFrame([(html,), (None,)], "html string").select(line_dedup.lines_of(line_dedup.html_text("html")).alias("x"))
    assert [r["x"] for r in df.collect()] == [["T", "One two", "three", "4 &lt; 5", "z"], []]
    assert url_filter.split_url("html")


def test_unclosed_tags_hide_the_rest_and_cost_no_more(spark):
    cases = {
        "a<p>b<script>c<p>d": ["a", "b"],
        "a<!-- b<p>c": ["a"],
        "x < y<p>z": ["x < y", "z"],
        "<style>q</style>t<STYLE x=1>u": ["t"],
        "<script" * 40_000: None,
        "<script>x" * 40_000: None,
        "<!-- " * 60_000: None,
        "a<" * 100_000: None,
    }
    df = spark.createDataFrame([(h,) for h in cases], "html string").select("html", line_dedup.lines_of(line_dedup.html_text("html")).alias("x"))
    began = time.monotonic()
    got = {r["html"]: r["x"] for r in df.collect()}
    assert time.monotonic() - began < 60
    assert all(got[h] == want for h, want in cases.items() if want is not None)


def brute_sections(text, rule):
    library = Tokenizer.from_file(PATH)
    spans = library.encode(text, add_special_tokens=False).offsets
    starts = [0] + [k + 1 for k, c in enumerate(text[:-1]) if c == "\n"]
    ends = [*starts[1:], len(text)]
    n, crossing = [0] * len(starts), [0] * len(starts)
    for a, b in spans:
        overlap = [max(0, min(b, e) - max(a, s)) for s, e in zip(starts, ends, strict=True)]
        touched = [k for k, x in enumerate(overlap) if x]
        k = {"first": touched[0], "last": touched[-1], "largest": overlap.index(max(overlap))}[rule]
        n[k] += 1
        crossing[k] += len(touched) > 1
    return list(zip(range(len(starts)), starts, ends, n, crossing, strict=True))


def test_sections_against_brute_force(spark):
    rows = [(k, t) for k, (_, t) in enumerate(AWKWARD)]
    rows += [(100, "one\n\n\ntwo  \n \n  three\n"), (101, "\n\n\n\nx\n\n"), (102, "日本\n語 🙂\n\n\r\n\r\nend 👍🏽"), (103, ".\n\n\n\n.")]
    for rule in token_counts.RULES:
        got = {}
        for r in token_counts.section_tokens(docs(spark, rows), PATH, rule=rule).collect():
            got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
        assert {i: sorted(x) for i, x in got.items()} == {i: brute_sections(t or "", rule) for i, t in rows}
    assert token_counts.section_tokens(docs(spark, []), PATH).count() == 0


def test_given_boundaries(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma", [6, 11, 11, 99, -1]), (2, "alpha", [])], "doc_id long, text string, cuts array<int>")
    got = sorted(tuple(r)[:5] for r in token_counts.section_tokens(df, PATH, starts_col="cuts").collect())
    coder = Codec(read_vocabulary(PATH))
    assert [x[:4] for x in got] == [(1, 0, 0, 6), (1, 1, 6, 11), (1, 2, 11, 16), (2, 0, 0, 5)]
    assert sum(x[4] for x in got[:3]) == len(coder.encode("alpha beta gamma"))
