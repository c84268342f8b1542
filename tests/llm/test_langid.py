import os
import random
import zlib

import numpy as np

from tidegauge.llm import langid

from .helpers import AWKWARD, docs

SF = "/root/testdata/sf0.01"
PROSE = {
    "en": "the quick brown fox jumps over the lazy dog and then the other thing that was there with them ",
    "de": "der schnelle braune fuchs springt über den faulen hund und dann noch die andere sache die dort war ",
    "fr": "le renard brun rapide saute par dessus le chien paresseux et puis les autres choses qui étaient là ",
}


def test_counts_do_not_depend_on_the_pieces(monkeypatch):
    text = "Über den Fluss, 12 mal -- und zurück! " * 40
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "PIECE_CHARS", 17)
    pieces = langid.gram_counts(text)
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()
    brute = {}
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        for n in (1, 2, 3):
            framed = word if n == 1 else f" {word} "
            for i in range(len(framed) - n + 1):
                gram = framed[i : i + n]
                if n < 3 or gram[1] != " ":
                    brute[gram] = brute.get(gram, 0) + 1
    assert sorted(brute.values()) == sorted(whole[1].tolist())


def test_out_of_place_distance():
    profiles = langid.Profiles({"x": [1, 2, 3], "y": [3, 2, 9]}, top=3)
    own = np.array([1, 2, 3])
    assert profiles.ranks[np.searchsorted(profiles.grams, own)].tolist() == [[0, 9], [1, 1], [2, 0]]


def grams_of(text):
    """n-grams as text with blanks for word ends, each with its count."""
    counts = {}
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        for n in (1, 2, 3):
            framed = word if n == 1 else f" {word} "
            for i in range(len(framed) - n + 1):
                if n < 3 or framed[i + 1] != " ":
                    counts[framed[i : i + n]] = counts.get(framed[i : i + n], 0) + 1
    return counts


def ranked(counts, top):
    return sorted(counts, key=lambda g: (-counts[g], len(g), [0 if c == " " else ord(c) for c in g]))[:top]


def brute(rows, top=300):
    """(held_out, lang_pred, score) of each row: every rank and distance written out."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0 for i, *_ in rows]
    learned = {}
    for (_, text, lang), out in zip(rows, held, strict=True):
        if not out and lang is not None and text is not None:
            learned.setdefault(lang, set()).add(text)
    profiles = {}
    for lang, texts in learned.items():
        total = {}
        for t in texts:
            for g, n in grams_of(t).items():
                total[g] = total.get(g, 0) + n
        profiles[lang] = {g: k for k, g in enumerate(ranked(total, top))}
    found = []
    for (_, text, _), out in zip(rows, held, strict=True):
        own = ranked(grams_of(text or ""), top)
        if not own or not profiles:
            found.append((out, "und", 0.0))
            continue
        away = {x: sum(min(abs(p[g] - k), top) if g in p else top for k, g in enumerate(own)) / (len(own) * top) for x, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        second = min((d for x, d in away.items() if x != best), default=1.0)
        found.append((out, best, round(min(max(1 - away[best] / second if second > 0 else 0.0, 0.0), 1.0), 9)))
    return found


def test_distance_winner_and_ties_as_brute_force(spark):
    rnd = random.Random(4)
    words = {x: t.split() for x, t in PROSE.items()}
    rows = [(k, " ".join(rnd.choices(words[x], k=rnd.randrange(1, 30))), x) for k, x in enumerate(["en", "de", "fr"] * 30)]
    # two labels with the same texts tie everywhere: the first in the alphabet wins
    rows += [(200 + k, t, x) for k in range(10) for t, x in (("zwei namen", "aa"), ("zwei namen", "zz"))]
    rows += [(300 + k, " ".join(rnd.choices(words["en"] + words["fr"], k=12)), None) for k in range(20)]
    rows += [(i, t, None) for i, t in AWKWARD] + [(400, "ab ba", "x"), (401, "ba ab", None), (402, "İstanbul ǅ ß", "x")]
    want = sorted((i is None, i or 0, *w) for (i, *_), w in zip(rows, brute(rows), strict=True))
    got = langid.identify(docs(spark, rows)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in got) == want
    assert {r["lang_pred"] for r in got if r["doc_id"] is not None and 200 <= r["doc_id"] < 210} == {"aa"}


def test_predictions(spark):
    rows = [(k, PROSE[x] * (1 + k % 3), x) for k, x in enumerate(["en", "de", "fr"] * 12)] + [(i, t, None) for i, t in AWKWARD] + [(500, "12 34 !!", "en")]
    got = {}
    for r in langid.identify(docs(spark, rows)).collect():
        got.setdefault(r["doc_id"], r)
        assert 0 <= r["score"] <= 1
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(key.encode()) % 5 == 0)
    assert all(got[k]["lang_pred"] == x for k, _, x in rows[:36] if k not in (1, 2, 3, 5, 6, 7, 8, 9, 10))
    assert got[500]["lang_pred"] == "und" and got[500]["score"] == 0


def test_nothing_learned_and_empty(spark):
    assert {r["lang_pred"] for r in langid.identify(docs(spark, AWKWARD)).collect()} == {"und"}
    assert langid.identify(docs(spark, [])).count() == 0


def test_held_out_accuracy(spark):
    if not os.path.isdir(SF):
        return
    table = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.identify(table).where("held_out").join(table.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) >= 0.97 * len(found)


def test_whole_rows_stay(spark):
    df = docs(spark, [(1, PROSE["en"]), (2, None), (3, "1234"), (4, PROSE["de"])])
    profiles = langid.train(docs(spark, [(k, t, x) for k, (x, t) in enumerate(PROSE.items())]))
    kept = langid.keep_languages(df, profiles, 0.99)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 4]


def test_copies_do_not_shrink_the_sample(spark):
    few = [(k, f"{PROSE['en']} lang{x} text{k % 3}", f"l{x:02}") for x in range(10) for k in range(300)]
    many = [(k, f"{PROSE['de']} one copied text", "de") for k in range(1500)] + [(k, f"{PROSE['de']} other {k}", "de") for k in range(200)]
    table = docs(spark, few + many)
    assert langid.train(table, sample=20).languages == ["de", *[f"l{x:02}" for x in range(10)]]
    drawn = {r["lang"]: r["count"] for r in langid.sample_texts(table.select("lang", "text"), 20).groupBy("lang").count().collect()}
    assert all(drawn[f"l{x:02}"] == 3 for x in range(10)) and 5 <= drawn["de"] <= 45
