"""Byte-level BPE encoding and decoding with a contiguous rank array.

A short word is held in two contiguous arrays side by side: its parts, which give the part
boundaries, and the merge rank of each adjacent pair. The array of ranks is scanned for its
minimum (the leftmost on a tie), the boundary between those two parts is deleted, and the two
neighbouring ranks are looked up again, until no pair merges. The words of a batch that are
not known yet go through these steps together, one row of a matrix each, in NumPy. Words
beyond ``SHORT_WORD`` bytes take the same merges from a heap, as the scan is quadratic there;
the result is the same.

Text is cut into words by the vocabulary's split pattern after the special tokens are cut
out, as the tokenizers library does; nothing else is normalised. Decoding joins the bytes of
the tokens and replaces malformed UTF-8.

Encoding needs no shuffle. The vocabulary file is read on the driver and broadcast; its size
is checked against ``MAX_VOCABULARY_BYTES``. Workers keep the parts of words they have met,
and forget them all once there are more than ``CACHED_WORDS``.

Defined cases: a null text is the empty text, which has no tokens and decodes to the empty
text; repeated rows are encoded one by one; ids outside the vocabulary decode to nothing;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Split pattern of the byte-level vocabularies, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points that count as letters or numbers in newer Unicode tables than the tokenizers library
#: has: it takes them for neither. Fixed values.
NEWER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    r"\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    r"\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    r"\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
SHORT_WORD = 256
CACHED_WORDS = 1 << 16
MAX_VOCABULARY_BYTES = 64 << 20
#: Cells of a matrix of words; characters of the texts that are encoded together.
_CELLS = 1 << 16
CHUNK_CHARS = 1 << 20


def _printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary file.

    Printable Latin-1 characters stand for themselves, the others follow from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


def _splitter() -> Callable[[str], list[str]]:
    """Cuts a text into words by the split pattern; texts that hold a newer code point take a slower form of it."""
    old = {r"\p{L}": rf"(?:(?![{NEWER}])\p{{L}})", r"\p{N}": rf"(?:(?![{NEWER}])\p{{N}})"}
    other = r"[^\s\p{L}\p{N}]"
    slow = PATTERN.replace(other, "OTHER")
    for kind, known in old.items():
        slow = slow.replace(kind, known)
    slow = slow.replace("OTHER", rf"(?:{other}|[{NEWER}])")
    fast, slow, newer = regex.compile(PATTERN).findall, regex.compile(slow).findall, regex.compile(f"[{NEWER}]").search

    def words(text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")  # none of them is so low
            except UnicodeEncodeError:
                if newer(text):
                    return slow(text)
        return fast(text)

    return words


class _Ranks:
    """Merge ranks by pair of parts: an open hash table in arrays, looked up for many pairs at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, bits: int = 18) -> None:
        self.none = np.iinfo(_fits(len(left) + 1)).max
        self.half = 16 if max(left.max(initial=0), right.max(initial=0)) < 1 << 16 else 32
        self.kind = np.uint32 if self.half == 16 else np.uint64
        self.empty = self.kind(np.iinfo(self.kind).max)  # no pair: ids stay below the largest
        self.odd = self.kind(0x9E3779B1 if self.half == 16 else 0x9E3779B97F4A7C15)
        self.shift = self.kind(2 * self.half - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, self.empty, self.kind)
        self.ranks = np.full(1 << bits, self.none, _fits(len(left) + 1))
        key, rank = self._key(left, right), np.arange(len(left), dtype=self.ranks.dtype)
        slot = self._slot(key)
        while len(key):  # the first of a free slot gets it, the others try the next one
            free = self.keys[slot] == self.empty
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            wins = first[free[first]]
            self.keys[slot[wins]], self.ranks[slot[wins]] = key[wins], rank[wins]
            left_over = np.ones(len(key), bool)
            left_over[wins] = False
            slot, key, rank = (slot[left_over] + 1) & self.mask, key[left_over], rank[left_over]

    def _key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(self.kind) << self.kind(self.half) | right.astype(self.kind)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * self.odd) >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = self._key(left, right)
        slot = self._slot(key)
        there = self.keys[slot]
        out = self.ranks[slot]
        other = there != key
        out[other] = self.none
        at = np.flatnonzero(other & (there != self.empty))
        slot = slot[at]
        while len(at):
            slot = (slot + 1) & self.mask
            there = self.keys[slot]
            hit = there == key[at]
            out[at[hit]] = self.ranks[slot[hit]]
            go = ~hit & (there != self.empty)
            at, slot = at[go], slot[go]
        return out


def _fits(n: int) -> type:
    return np.uint16 if n < 1 << 16 else np.uint32


class Codec:
    """Encoder and decoder of one vocabulary, given as the JSON of the tokenizers library."""

    def __init__(self, vocabulary: bytes) -> None:
        spec = json.loads(vocabulary)
        of = _printable_bytes()
        raw = {t: bytes(map(of.__getitem__, t)) for t in spec["model"]["vocab"]}
        self.id_of = {raw[t]: i for t, i in spec["model"]["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {self.id_of[raw[a]] << 32 | self.id_of[raw[b]]: k for k, (a, b) in enumerate(pairs)}
        self.merged = [self.id_of[raw[a] + raw[b]] for a, b in pairs]
        self.id_of_byte = [self.id_of[bytes([b])] for b in range(256)]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = 1 + max([*self.id_of.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.decimal = [str(i) for i in range(size)]
        self.words = _splitter()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        both = np.array(list(self.rank), np.int64)
        self.table = _Ranks(both >> 32, both & 0xFFFFFFFF)
        self.merged_ids = np.array(self.merged, _fits(size))
        self.byte_ids = np.array(self.id_of_byte, _fits(size))
        every = np.arange(65536)
        self.first_ranks = self.table.of(self.byte_ids[every >> 8], self.byte_ids[every & 255])
        self._parts: dict[str, tuple[int, ...]] = {}

    def _scan(self, words: list[bytes]) -> list[list[int]]:
        """The parts of words of about the same length, at least one byte each."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        wide, none = int(n.max()), self.table.none
        columns = np.arange(wide)
        inside = columns < n[:, None]
        raw = np.zeros((len(words), wide), np.uint8)
        raw[inside] = np.frombuffer(b"".join(words), np.uint8)
        parts = self.byte_ids[raw]
        ranks = np.full((len(words), wide), none, self.table.ranks.dtype)
        ranks[:, :-1] = np.where(inside[:, 1:], self.first_ranks[raw[:, :-1].astype(np.uint16) << 8 | raw[:, 1:]], none)
        out: list[list[int]] = [[]] * len(words)
        at, rows = np.arange(len(words)), np.arange(len(words))
        while len(at):
            i = ranks.argmin(1)
            least = ranks[rows, i]
            done = least == none
            if done.any():
                for k, p, m in zip(at[done].tolist(), parts[done].tolist(), n[done].tolist(), strict=True):
                    out[k] = p[:m]
                go = np.flatnonzero(~done)
                if not len(go):
                    break
                at, n, i, least = at[go], n[go], i[go], least[go]
                wide = int(n.max())
                parts, ranks, columns, rows = parts[go, :wide], ranks[go, :wide], columns[:wide], rows[: len(go)]
            parts[rows, i] = self.merged_ids[least]
            after = columns >= i[:, None]  # the boundary after part i goes: what follows moves up
            np.copyto(ranks[:, :-1], ranks[:, 1:], where=after[:, :-1])
            ranks[:, -1] = none
            np.copyto(parts[:, 1:-1], parts[:, 2:], where=after[:, :-2])
            n -= 1
            r = np.flatnonzero(i < n - 1)
            k = i[r]
            ranks[r, k] = self.table.of(parts[r, k], parts[r, k + 1])
            r = np.flatnonzero(i)
            k = i[r]
            ranks[r, k - 1] = self.table.of(parts[r, k - 1], parts[r, k])
        return out

    def _heap(self, word: bytes) -> list[int]:
        """The merges of ``_scan`` for long words: parts are a linked list, pairs lie in a heap."""
        n, rank = len(word), self.rank.get
        part = [self.id_of_byte[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < n and (r := rank(part[left] << 32 | part[right])) is not None:
                heapq.heappush(heap, (r, left, part[left], part[right]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, left, first, second = heapq.heappop(heap)
            right = after[left]
            if part[left] != first or right >= n or part[right] != second:
                continue  # one of the two parts has grown or gone meanwhile
            part[left], part[right] = self.merged[r], -1
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return [x for x in part if x >= 0]

    def _learn(self, words: set[str]) -> None:
        """Fill in the parts of the words that are not known yet."""
        if len(self._parts) > CACHED_WORDS:
            self._parts.clear()
        new = sorted(words.difference(self._parts), key=len)
        raw = [w.encode("utf-8", "replace") for w in new]
        k = 0
        while k < len(new):
            room = max(16, _CELLS // max(1, len(raw[k])))
            some = raw[k : k + room]
            short = [x for x in some if len(x) <= SHORT_WORD]
            found = iter(self._scan(short) if short else [])
            for word, x in zip(new[k : k + room], some, strict=True):
                self._parts[word] = tuple(next(found) if len(x) <= SHORT_WORD else self._heap(x))
            k += room

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text. The words of all texts together are looked up first."""
        cut = [self._cut(t) for t in texts]
        self._learn({w for pieces in cut for piece in pieces if isinstance(piece, list) for w in piece})
        known = self._parts.__getitem__
        out = []
        for pieces in cut:
            ids: list[int] = []
            for piece in pieces:
                if isinstance(piece, list):
                    ids.extend(chain.from_iterable(map(known, piece)))
                else:
                    ids.append(piece)
            out.append(ids)
        return out

    def _cut(self, text: str | None) -> list[list[str] | int]:
        """Lists of words, and the ids of the special tokens between them."""
        if not text:
            return []
        if self.cut is None or not any(s in text for s in self.special):
            return [self.words(text)]
        return [self.special[p] if k % 2 else self.words(p) for k, p in enumerate(self.cut(text))]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes([i for i in ids if 0 <= i < len(self.bytes_of)]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(vocabulary: bytes) -> Codec:
    """One codec a worker and vocabulary."""
    return Codec(vocabulary)


def chunks(column: pa.Array) -> Iterator[list[str]]:
    """The texts of an Arrow column (null: empty), about ``CHUNK_CHARS`` characters at a time."""
    some, size = [], 0
    for value in column:
        some.append(value.as_py() or "")
        size += len(some[-1])
        if size >= CHUNK_CHARS:
            yield some
            some, size = [], 0
    yield some


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: over {MAX_VOCABULARY_BYTES} bytes; too large to broadcast")
    return data


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, n_tokens long."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            at = 0
            for texts in chunks(batch.column(1)):
                ids = c.encode_all(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64())],
                    ["doc_id", "ids", "n_tokens"],
                )
                at += len(texts)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, ids array<int>, n_tokens long")


def decode(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            texts = [c.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode, decode again from the ids, and return what proves both.

    doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip (the decoded text is the text);
    with ``with_ids`` also ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        decimal = c.decimal.__getitem__
        for batch in batches:
            at = 0
            for texts in chunks(batch.column(1)):  # a batch for each chunk, so few ids are held at once
                out: list[list] = [[], [], [], []]
                every = c.encode_all(texts)
                for text, ids in zip(texts, every, strict=True):
                    decoded = c.decode_bytes(ids).decode("utf-8", "replace")
                    out[0].append(len(ids))
                    out[1].append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                    out[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                    out[3].append(decoded == text)
                kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
                arrays = [batch.column(0).slice(at, len(texts)), *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
                if with_ids:
                    arrays.append(pa.array(every, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)
                at += len(texts)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
