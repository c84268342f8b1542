import hashlib

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidegauge.llm import bpe

from .helpers import AWKWARD, collect, docs

PATH = P.path("byte_bpe_50k.json")
CODER = bpe.Codec(bpe.read_vocabulary(PATH))
LIBRARY = Tokenizer.from_file(PATH)


def agrees(text):
    ids = CODER.encode(text)
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODER.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text_as_the_library(text):
    agrees(text)


@pytest.mark.parametrize("text", [t for _, t in AWKWARD if t] + ["abcthe" * 200, " " * 700, "é" * 900, "<|endoftext|>" * 3])
def test_awkward_texts_as_the_library(text):
    agrees(text)


def test_every_code_point_is_classed_as_by_the_library():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x34000 or 0x3D000 <= c < 0x3FC40 or c % 61 == 0)]
    cut = lambda text: [w for w, _ in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]
    for a in range(0, len(every), 4000):
        text = "".join(f"a{c}1{c}!{c} " for c in every[a : a + 4000])
        assert list(map(len, map(str.encode, CODER.words(text)))) == list(map(len, cut(text)))


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("aZ1 \n\t!'éßя日\u0558\U0003d000\U00018d80\U00016ff5\U00011de3"), max_size=30))
def test_newer_code_points_as_the_library(text):
    agrees(text)


def test_scan_and_heap_agree():
    for word in (b"hello", b"thethethe" * 20, bytes(range(256)), b"x", b"aaaaaaa"):
        assert CODER._scan([word])[0] == CODER._heap(word)
    words = [b"the", b"international", b"a", b"zzzzqq"]
    assert CODER._scan(words) == [CODER._heap(w) for w in words]


def test_whole_table(spark):
    df = docs(spark, AWKWARD)
    got = collect(bpe.round_trip(df, PATH), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, t in AWKWARD:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        back = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=lambda t: tuple((x is None, str(type(x)), x) for x in t))
    back = bpe.decode(bpe.encode(df, PATH), PATH)
    assert collect(back, "text") == sorted((t or "",) for _, t in AWKWARD)
    assert bpe.round_trip(docs(spark, []), PATH).count() == 0
