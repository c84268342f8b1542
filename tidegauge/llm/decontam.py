"""Benchmark decontamination by winnowing.

Words are runs of a-z, 0-9 and non-ASCII characters after A-Z is lower-cased. Every span of
``WINDOW`` words keeps the least hash among its ``WINDOW - K + 1`` k-grams (the rightmost on a
tie), in benchmark items and documents alike, so two equal spans of ``WINDOW`` words always
keep the same k-gram. Kept hashes of documents are joined to those of the items, each hit is
extended word by word to both sides, and extended spans of ``WINDOW`` words or more are hits.
Words are compared by their number in the items' vocabulary, never by hash. Items of fewer
words are one window each; their k-gram is the whole item.

Documents never shuffle: the items' index is broadcast, in blocks of ``MAX_BLOCK_BYTES`` of item
text or one item more. A larger benchmark takes one pass over the documents a block. A pass writes what it
has hit and nothing else: the digest of the text, its hit words and the items; its index is
destroyed before the next one is built, so driver and workers hold one at a time. What all passes have hit
is then put together by digest, and only documents that a Bloom filter of those digests lets through meet it.

Defined cases: a null text has no words; an item without words never matches; a null item id
is the empty string; items with equal ids count once; repeated documents are judged one by
one; a document without hits has the digest of the empty string; an empty table on either
side gives no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import chunks
from .common import durable, text_or_empty
from .exact_dedup import split_known

WINDOW = 10
K = 5
MAX_BLOCK_BYTES = 32 << 20
_KEPT = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789") | frozenset(range(0x80, 0x100))
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEPT else 32 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TO_WORDS).split()


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n-gram of word numbers."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    size, values = len(ids) - n + 1, ids.astype(np.uint64)
    h = np.zeros(size, np.uint64)
    for j in range(n):
        h = h * _BASE + values[j : j + size]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _room(ids: np.ndarray) -> np.ndarray:
    """How many known words (numbers over 0) stand in a row from each position on."""
    n = len(ids)
    barrier = np.where(ids > 0, n, np.arange(n))
    return np.minimum.accumulate(barrier[::-1])[::-1] - np.arange(n)


def winnow(ids: np.ndarray, room: np.ndarray, window: int, k: int) -> np.ndarray:
    """Positions of the k-grams that the spans of ``window`` known words keep."""
    starts = np.flatnonzero(room >= window)
    if not len(starts):
        return starts
    h, kept, span = _hashes(ids, k), [], window - k + 1
    for a in range(0, len(starts), 1 << 18):
        some = starts[a : a + (1 << 18)]
        least = span - 1 - h[some[:, None] + np.arange(span)[::-1]].argmin(1)
        kept.append(np.unique(some + least))
    return np.unique(np.concatenate(kept))


@dataclass
class Index:
    """Winnowed fingerprints of a block of items. ``words`` holds all items, -1 between them."""

    ids: list[str]
    vocabulary: dict[bytes, int]
    words: np.ndarray
    item_at: np.ndarray
    prints: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    places: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    window: int = WINDOW
    k: int = K


def build_index(items: list[tuple[str | None, str | None]], window: int = WINDOW, k: int = K) -> Index:
    vocabulary: dict[bytes, int] = {}
    words, item_at, short, names = [-1], [-1], {}, []
    for item_id, text in items:
        item = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in split_words(text or "")]
        if not item:
            continue
        if len(item) < window:
            short.setdefault(len(item), []).append(len(words))
        words += [*item, -1]
        item_at += [len(names)] * len(item) + [-1]
        names.append(item_id or "")
    out = Index(names, vocabulary, np.array(words, np.int64), np.array(item_at, np.int64), window=window, k=k)
    places = winnow(out.words, _room(out.words), window, k)
    if len(places):
        prints = _hashes(out.words, k)[places]
        order = np.argsort(prints, kind="stable")
        out.prints, out.places = prints[order], places[order]
    for n, at in short.items():
        at = np.array(at, np.int64)
        prints = _hashes(out.words, n)[at]
        order = np.argsort(prints, kind="stable")
        out.short[n] = prints[order], at[order]
    return out


def _pairs(values: np.ndarray, prints: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the value, place) for every print that equals a value."""
    low, high = np.searchsorted(prints, values, "left"), np.searchsorted(prints, values, "right")
    n = high - low
    which = np.repeat(np.arange(len(values)), n)
    return which, places[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]]


def find_spans(ids: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and item number of the matched spans in word numbers (0: unknown, -1: barrier)."""
    room, item_words = _room(ids), index.words
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = winnow(ids, room, index.window, index.k)
    if len(at) and len(index.prints):
        which, q = _pairs(_hashes(ids, index.k)[at], index.prints, index.places)
        p = at[which]
        _, first = np.unique(np.stack([p - q, index.item_at[q], p], 1), axis=0, return_index=True)
        p, q = p[first], q[first]
        ends = []
        for step in (-1, 1):
            reach, active = np.zeros(len(p), np.int64), np.arange(len(p))
            while len(active):
                a, b = p[active] + step * (reach[active] + (step < 0)), q[active] + step * (reach[active] + (step < 0))
                ok = (a >= 0) & (a < len(ids)) & (b >= 0) & (b < len(item_words))
                ok[ok] = ids[a[ok]] == item_words[b[ok]]
                active = active[ok]
                reach[active] += 1
            ends.append(reach)
        long = ends[0] + ends[1] >= index.window
        found.append(((p - ends[0])[long], (p + ends[1])[long], index.item_at[q[long]]))
    for n, (prints, places) in index.short.items():
        at = np.flatnonzero(room >= n)
        if len(at):
            which, q = _pairs(_hashes(ids, n)[at], prints, places)
            p = at[which]
            same = np.ones(len(p), bool)
            for j in range(n):
                same &= ids[p + j] == item_words[q + j]
            found.append((p[same], p[same] + n, index.item_at[q[same]]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def judge(texts: list[str], index: Index) -> list[tuple[int, np.ndarray, set[str]]]:
    """For each text its number of words, the positions of hit words, and the ids of the items."""
    split = [split_words(t) for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(sizes + 1)
    ids = np.fromiter(
        chain.from_iterable(chain(map(index.vocabulary.get, w, repeat(0)), (0,)) for w in split), np.int64, int(ends[-1]) if len(split) else 0
    )
    starts = ends - sizes - 1
    a, b, item = find_spans(ids, index)
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, a, 1)
    np.add.at(cover, b, -1)
    hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    hit_doc = np.searchsorted(ends, hit, "right")
    cuts = np.searchsorted(hit_doc, np.arange(len(texts) + 1))
    items: list[set[str]] = [set() for _ in texts]
    for d, k in np.unique(np.stack([np.searchsorted(ends, a, "right"), item], 1), axis=0).tolist() if len(a) else []:
        items[d].add(index.ids[k])
    return [(int(sizes[d]), hit[cuts[d] : cuts[d + 1]] - starts[d], items[d]) for d in range(len(texts))]


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", max_bytes: int = MAX_BLOCK_BYTES) -> Iterator[tuple[list, bool]]:
    """Items (id, text) of at least ``max_bytes`` of text together, or the rest, and whether they are the last; at least one block."""
    some, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    for row in rows.toLocalIterator():
        if size >= max_bytes:
            yield some, False
            some, size = [], 0
        some.append((row["i"], row["t"]))
        size += len((row["t"] or "").encode())
    yield some, True


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, items array<string>, contaminated boolean"
HITS = "sha string, hit array<long>, items array<string>"


def _judged(shared) -> Callable:
    """doc_id and what one index finds in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for texts in chunks(batch.column(1)) for x in judge(texts, shared.value)]
            columns = _columns([x[0] for x in found], [len(x[1]) for x in found], [x[2] for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *(c.split()[0] for c in FOUND.split(", "))])

    return run


def _columns(words: list[int], hits: list[int], items: list[set[str]]) -> list[pa.Array]:
    return [
        pa.array(words, pa.int64()),
        pa.array(hits, pa.int64()),
        pa.array([len(x) for x in items], pa.int64()),
        pa.array([_digest(x) for x in items], pa.string()),
        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        pa.array([n > 0 for n in hits], pa.bool_()),
    ]


def _only_hits(shared) -> Callable:
    """sha, hit words and items of the texts that one index hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for texts in chunks(batch.column(1)) for x in judge(texts, shared.value)]
            at = [k for k, (_, hit, _) in enumerate(found) if len(hit)]
            hits = pa.array([found[k][1].astype(np.int64) for k in at], pa.list_(pa.int64()))
            items = pa.array([sorted(found[k][2]) for k in at], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), hits, items], ["sha", "hit", "items"])

    return run


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [len(split_words(t)) for texts in chunks(batch.column(2)) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.int64())], ["doc_id", "sha", "n_words"])


def _sha(text_col: str) -> Column:
    return F.sha2(text_or_empty(text_col), 256)


def _hits(docs: DataFrame, text_col: str, blocks: Iterator[tuple[list, bool]]) -> DataFrame:
    """sha, n_hit and items of every text that any block hits; one row a text, however many documents have it."""
    context, passes = docs.sparkSession.sparkContext, []
    for items, _ in blocks:
        shared = context.broadcast(build_index(items))
        passes.append(durable(docs.select(_sha(text_col).alias("sha"), F.col(text_col).alias("text")).mapInArrow(_only_hits(shared), HITS).dropDuplicates(["sha"])))
        shared.destroy()
    found = reduce(DataFrame.unionByName, passes)
    words = found.select("sha", F.explode("hit").alias("w")).distinct().groupBy("sha").agg(F.count(F.lit(1)).alias("n_hit"))
    items = found.select("sha", F.explode("items").alias("i")).groupBy("sha").agg(F.array_sort(F.collect_set("i")).alias("items"))
    return durable(words.join(items, "sha"))


def _blocks(benchmark: DataFrame, max_block_bytes: int) -> tuple[list | None, Iterator[tuple[list, bool]]]:
    """The items if they are one block, else all blocks, one at a time."""
    blocks = item_blocks(benchmark, max_bytes=max_block_bytes)
    items, last = next(blocks)
    return (items, iter(())) if last else (None, chain([(items, last)], blocks))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_block_bytes: int = MAX_BLOCK_BYTES
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, items array<string>, contaminated."""
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items, blocks = _blocks(benchmark, max_block_bytes)
    if items is not None:
        shared = docs.sparkSession.sparkContext.broadcast(build_index(items))
        return rows.mapInArrow(_judged(shared), f"doc_id {key}, {FOUND}")
    hits = _hits(rows, "text", blocks).withColumnRenamed("sha", "_hit")
    counted = durable(rows.select("doc_id", _sha("text").alias("sha"), "text").mapInArrow(_word_counts, f"doc_id {key}, sha string, n_words long"))
    found = counted.join(hits, F.col("sha") == F.col("_hit"), "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "items", (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """The whole rows of ``docs`` without a hit word."""
    at = docs.columns.index(text_col)
    items, blocks = _blocks(benchmark, max_block_bytes)
    if items is None:
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), _sha(text_col).alias("_sha"))
        hits = _hits(docs, text_col, blocks).select(F.col("sha").alias("_hit"))
        through, maybe = split_known(rows, "_sha", hits, "_hit")
        return through.select("_row.*").unionByName(maybe.join(hits, F.col("_sha") == F.col("_hit"), "left_anti").select("_row.*"))
    shared = docs.sparkSession.sparkContext.broadcast(build_index(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [not len(hit) for texts in chunks(batch.column(at)) for _, hit, _ in judge(texts, shared.value)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
