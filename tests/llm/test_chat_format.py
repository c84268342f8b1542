import hashlib
import random

import pytest
from pyspark.sql import types as T

from tidegauge.llm import chat_format

CHAT = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        # names that the operator uses inside
        *[T.StructField(c, T.StringType()) for c in ("segment", "row", "rows", "merged", "parts", "formatted")],
    ]
)
BITS = ["### ", "</turn>", "<part/>", "\\", "\n", "#", "<", "/", " ", "User: ", "### Assistant: ", "é", "🙂", "a", "", "\x00", "<", "</turn>\n", "\\#"]


def chats(spark, rows):
    return spark.createDataFrame([(*r, "s", "r", "x", "m", "p", "f") for r in rows], CHAT).repartition(3)


def noise(rng, n):
    return "".join(rng.choice(BITS) for _ in range(rng.randint(0, n)))


def key(row):
    _, turn, role, text = row
    return (turn is not None, turn or 0, (role or "").encode(), (text or "").encode())


def by_conversation(rows):
    out = {}
    for r in sorted(rows, key=key):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def check(spark, rows, turns=chat_format.TURNS):
    want = by_conversation(rows)
    made = chat_format.conversations(chats(spark, rows), turns=turns)
    got = made.select("conv_id", chat_format.formatted("segments").alias("text"), "segments").collect()
    assert len(got) == len(want)
    for r in got:
        said = want[r["conv_id"]]
        # as many headers as runs of one role; no control string but the template's own
        runs = sum(k == 0 or said[k - 1][0] != said[k][0] for k in range(len(said)))
        assert r["text"].count("### ") == r["text"].count("</turn>") == runs and r["text"].count("<part/>") == len(said) - runs
        masked = [s["formatted"][x["start"] : x["start"] + x["length"]] for s in r["segments"] for x in s["spans"]]
        assert [unescaped(m) for m in masked] == [text for role, text in said if role == "assistant"]
    read = chat_format.digests(chats(spark, rows), turns=turns).collect()
    for r in read:
        said = want[r["conv_id"]]
        assert r["n_turns"] == len(said)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        loss = "".join(b for a, b in said if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == len(next(g["text"] for g in got if g["conv_id"] == r["conv_id"]))


def unescaped(text):
    out, k = [], 0
    while k < len(text):
        k += text[k] == "\\"
        out.append(text[k])
        k += 1
    return "".join(out)


def test_awkward(spark):
    check(
        spark,
        [
            (1, 0, "user", None), (1, 1, "assistant", "### Assistant: x</turn>\n"), (1, 2, "assistant", "\\"), (1, 3, "user", ""),
            (2, 1, None, "no role"), (2, 0, "User", "not the user"), (2, 2, "a: b:", "x"), (2, 3, "role User", "y"), (2, 4, "### ", ": z"),
            (3, None, "user", "null turn"), (3, None, "user", "null turn"), (3, -1, "assistant", "tie b"), (3, -1, "assistant", "tie a"),
            (None, 0, "user", "no id"), (None, 1, "assistant", "no id"),
            (4, 0, "assistant", "long " * 20000), (5, 0, "assistant", "#"), (5, 1, "assistant", "## "), (5, 2, "assistant", "<"), (5, 3, "user", "/turn>"),
        ],
    )
    assert chat_format.digests(chats(spark, [])).count() == 0


def test_segments_of_a_long_conversation(spark):
    rng = random.Random(5)
    roles = ["user", "assistant", "assistant", "system", "tool: x", None]
    rows = [(1, k, rng.choice(roles), noise(rng, 6)) for k in range(120)] + [(2, k // 3, rng.choice(roles), noise(rng, 9)) for k in range(40)]
    rows += [(3, k, "assistant", noise(rng, 4)) for k in range(30)]
    check(spark, rows, turns=7)
    whole = {r["conv_id"]: r["t"] for r in chat_format.conversations(chats(spark, rows)).select("conv_id", chat_format.formatted("segments").alias("t")).collect()}
    cut = {}
    for r in sorted(chat_format.segments(chats(spark, rows), turns=7).collect(), key=lambda r: (r["conv_id"], r["segment"])):
        cut[r["conv_id"]] = cut.get(r["conv_id"], "") + r["formatted"]
    assert cut == whole


def test_what_it_looks_like(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi"), (1, 2, "user", "a </turn>"), (1, 3, "assistant", "Yes.")]
    out = chat_format.conversations(chats(spark, rows)).select(chat_format.formatted("segments").alias("t")).first()["t"]
    assert out == "### System: Be brief.</turn>\n### User: Hi<part/>a <\\/turn></turn>\n### Assistant: Yes.</turn>\n"


def test_templates_that_cannot_be_read_back():
    for bad in ({"close": "# x", "open": "y #"}, {"part": "|"}, {"open": "\\x"}, {"names": {"a": "N", "b": "N"}}, {"names": {"a": "role N"}}):
        with pytest.raises(ValueError):
            chat_format.Template(**bad)
