"""SimHash near-duplicates found by the generalised pigeonhole principle.

A fingerprint has a bit where over half of the document's shingle hashes have it. Two
fingerprints link at ``max_bits`` or fewer differing bits. To find all links:

1. The 64 bits are grouped into partitions of correlated bits (counts over all fingerprints).
2. With thresholds ``t_i >= -1`` that sum to ``max_bits - m + 1``, any link is within ``t_i`` bits
   in some partition ``i``. Dynamic programming chooses the thresholds, and the number of
   partitions, with the least estimated cost: rows to probe plus candidate pairs, the latter
   from each bit's share of ones. A threshold of -1 leaves a partition out.
3. Each fingerprint is filed under its key of every partition, and probes all keys within the
   threshold. Rows meet by (partition, key), sorted, and stream through NumPy. A key that more than
   ``BLOCK_ROWS`` rows meet at (correlated bits make such keys) is dealt in blocks: each two blocks
   meet in a task of their own, so no task holds a whole heavy key.
4. Candidates are verified on all 64 bits. A bucket gives the edges of a spanning forest and
   never its pairs, so its output is no larger than its input.

A search for similar shingle sets (``wide_bits``) decides by the sets, not by the bits:

1. A text stands for its set, known by a digest; equal sets are one row. Repeats count once.
2. Candidates differ in ``max_bits`` of 64 bits and ``wide_bits`` of 256 at most (``WIDE`` further
   words, drawn from the same hashes). They are found as above, by partitions and thresholds for
   ``max_bits`` of the first 64 bits. Sets of the similarity have nearly the same size, so a set
   is filed in the band of its size and probes that band and the next, each ``BAND`` times as wide
   as the one before. A pair that meets in several partitions is taken in the first of them only.
3. The candidates' components, by spanning forests again, bring together the sets that may link.
   They are hashed again from their texts, which a Bloom filter picks.
4. Within a component every candidate pair that is not joined yet is decided by the exact Jaccard
   similarity of its sets. A component of over ``BLOCK_SETS`` sets is dealt in blocks, each two of
   which are a task: ``BLOCKS`` at most, so that its rows are few, and more only where a block
   would hold over ``BLOCK_HASHES``.

At so many bits a key has two or three bits, so a pair is compared a few times on 64 bits before it
is dropped: pairs compared grow with the square of the sets, rows a set with the blocks of its keys.

Equal fingerprints are one row before any of this, so copies cost nothing. A bucket holds
distinct fingerprints only, 8 bytes each (40 with a set's digest); it is compared in blocks of a
fixed number of cells, so memory is bounded by two blocks of rows and does not grow with its pairs.

Defined cases: a null text has no words; without words the fingerprint is 0, linked like any
other; fewer words than a shingle make one shingle; a component's id is its least doc_id,
null ids left out (null if all are); repeated rows each get a row; an empty table gives an
empty result; whole texts are hashed, long ones in pieces of a fixed number of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, text_or_empty
from .components import connected_components
from .exact_dedup import split_known

BITS = 64
SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Limits for candidates of a similarity of 0.8, which turns about 10 of 64 bits (deviation 3) and 39
#: of 256 (6), and for sets of 4 and 5 shingles 12 and 48; unrelated texts differ in 128 of 256 (8).
SIMILAR_BITS = 22
SIMILAR_WIDE_BITS = 72
#: Cost of verifying a candidate pair, against shuffling a row as 1.
PAIR_COST = 0.005
MAX_THRESHOLD = 3
#: Rows a fingerprint, and rows a set with the words of its wide fingerprint, that a plan may ask for.
MAX_ROWS, MAX_WIDE_ROWS = 1024, 48
#: The Jaccard similarity from which sets link, as a fraction, and the ratio of set sizes at it.
SIMILAR = (4, 5)
BAND = 1.25
#: Fingerprints of a block of a band or of a heavy key, and shingle hashes of a block of candidates to decide.
BLOCK_ROWS, BLOCK_HASHES = 1 << 17, 1 << 20
#: Sets of a block of candidates to decide, as long as their component has fewer than ``BLOCKS`` blocks.
BLOCK_SETS, BLOCKS = 128, 16
#: Pairs that are decided before those joined meanwhile are left out.
_DECIDED = 1 << 10
#: Pairs of fingerprints that a task is meant to compare.
TASK_PAIRS = 1 << 30
SMALL_BUCKET = 64
#: Further 64-bit words of a wide fingerprint.
WIDE = 3
_WORD_NAMES = ["fp", *[f"w{k + 1}" for k in range(WIDE)]]
_CELLS = 1 << 19
PIECE = 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words, repeats included; fewer words are one shingle."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Another independent 64 bits for each hash."""
    h = hashes + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words(hashes: np.ndarray, words: int = 1) -> list[int]:
    """``words`` fingerprints of 64 bits; the first is that of the hashes themselves."""
    out = []
    for _ in range(words):
        ones = np.zeros(BITS, np.int64)
        for a in range(0, len(hashes), PIECE):
            piece = hashes[a : a + PIECE].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(piece, axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little"))
        hashes = _mixed(hashes)
    return out


def size_band(hashes: np.ndarray) -> int:
    """Sets whose sizes differ by a factor up to ``BAND`` are in one band or in neighbours."""
    return int(log(max(1, len(np.unique(hashes)))) / log(BAND))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return _words(shingle_hashes(text, shingle))[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, fp long")


def set_digest(hashes: np.ndarray) -> int:
    """Of sorted hashes without repeats."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def set_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key (a hash of the text), node (the set's digest), its band and size, and the words fp, w1, w2, ..."""
    names = ["node", "band", "size", *_WORD_NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(2):
                h = np.unique(shingle_hashes(t.as_py(), shingle))  # a repeated shingle counts once
                found.append((set_digest(h), size_band(h), len(h), *_words(h, 1 + WIDE)))
            columns = np.array(found, np.uint64).reshape(-1, len(names)).T
            columns = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "text_key", *names])

    rows = docs.select(F.col(id_col).alias("doc_id"), _text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, text_key long, " + ", ".join(f"{n} long" for n in names))


def _text_key(text_col: str) -> Column:
    return F.xxhash64(text_or_empty(text_col))


def _bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _count_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both, n = np.zeros((BITS, BITS), np.int64), 0
    for batch in batches:
        x = _bits_of(batch.column(0).to_numpy()).astype(np.float32)
        for a in range(0, len(x), PIECE):
            both += (x[a : a + PIECE].T @ x[a : a + PIECE]).astype(np.int64)
        n += len(x)
    i, j = np.divmod(np.arange(BITS * BITS), BITS)
    cells = [pa.array(np.append(v, k), t) for v, k, t in ((i, -1, pa.int32()), (j, -1, pa.int32()), (both.ravel(), n, pa.int64()))]
    yield pa.RecordBatch.from_arrays(cells, ["i", "j", "n"])


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and for each pair of bits the rows that have both; the answer has 4097 rows."""
    rows = fps.select("fp").mapInArrow(_count_bits, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, total = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r["i"] < 0:
            total = r["n"]
        else:
            both[r["i"], r["j"]] = r["n"]
    return total, both


def group_bits(both: np.ndarray, total: int, m: int) -> list[list[int]]:
    """``m`` partitions of nearly equal size; each grows by the bit that correlates best with it."""
    p = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(total, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        first = max(free, key=lambda b: (corr[b, sorted(free)].sum(), -b))
        group = [first]
        free.discard(first)
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


@dataclass(frozen=True)
class Plan:
    groups: list[list[int]]
    thresholds: list[int]
    cost: float


def _within(groups: list[list[int]], p: np.ndarray) -> list[np.ndarray]:
    """For each partition the estimated share of pairs within 0, 1, .. differing bits."""
    out = []
    for group in groups:
        chance = np.array([1.0])
        for b in group:
            differs = 2 * p[b] * (1 - p[b])
            chance = np.append(chance, 0) * (1 - differs) + np.insert(chance, 0, 0) * differs
        out.append(np.cumsum(chance))
    return out


def _rows(bits: int, threshold: int) -> int:
    return sum(comb(bits, d) for d in range(threshold + 1))


def allocate(groups: list[list[int]], p: np.ndarray, n: int, max_bits: int, pairs: float | None = None, max_rows: int = MAX_ROWS, bands: int = 1) -> Plan:
    """The thresholds of least estimated cost for these partitions.

    ``pairs`` is the number of pairs that could meet at all, ``bands`` how many bands a row
    probes. States are (threshold used, rows used), so the bound on rows holds exactly.
    """
    pairs, target = n * n / 2 if pairs is None else pairs, max_bits - len(groups) + 1
    best: dict[tuple[int, int], tuple[float, list[int]]] = {(0, 0): (0.0, [])}
    for group, within in zip(groups, _within(groups, p), strict=True):
        new: dict[tuple[int, int], tuple[float, list[int]]] = {}
        for t in range(-1, min(MAX_THRESHOLD, len(group)) + 1):
            rows = _rows(len(group), t) * bands
            cost = rows * n + PAIR_COST * pairs * (0 if t < 0 else within[t])
            for (used, held), (so_far, ts) in best.items():
                state, option = (used + t, held + rows), (so_far + cost, [*ts, t])
                if held + rows <= max_rows and (state not in new or option < new[state]):
                    new[state] = option
        best = new
    cost, ts = min((v for (used, _), v in best.items() if used == target), default=(float("inf"), []))
    return Plan(groups, ts, cost)


def plan(total: int, both: np.ndarray, max_bits: int = MAX_BITS, pairs: float | None = None, max_rows: int = MAX_ROWS, bands: int = 1) -> Plan:
    p = np.diag(both) / max(total, 1)
    options = (allocate(group_bits(both, total, m), p, total, max_bits, pairs, max_rows, bands) for m in range(1, min(max_bits + 2, BITS) + 1))
    best = min(options, key=lambda x: x.cost)
    if not best.thresholds:
        raise ValueError(f"no plan for {max_bits} bits within {max_rows} rows a fingerprint")
    return best


SIGNATURE = "part int, key long, filed boolean, fp long"


def _probes(chosen: Plan) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The partitions in use: number, bits, and what turns a key into each key that it probes, itself first."""
    parts = []
    for part, (group, t) in enumerate(zip(chosen.groups, chosen.thresholds, strict=True)):
        if t >= 0:
            masks = [sum(1 << b for b in some) for d in range(1, t + 1) for some in combinations(range(len(group)), d)]
            parts.append((part, np.array(group, np.int64), np.array([0, *masks], np.int64)))
    return parts


def _signatures(chosen: Plan):
    parts = _probes(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy()
            for part, group, masks in parts:
                step = max(1, (1 << 17) // len(masks))
                for a in range(0, len(every), step):
                    fps = every[a : a + step]
                    keys = _bits_of(fps)[:, group].astype(np.int64) @ (1 << np.arange(len(group), dtype=np.int64))
                    probes = (keys[:, None] ^ masks).ravel()
                    filed = np.tile(np.arange(len(masks)) == 0, len(fps))
                    arrays = [np.full(len(probes), part, np.int32), probes, filed, np.repeat(fps, len(masks))]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["part", "key", "filed", "fp"])

    return run


def heavy_keys(fps: DataFrame, chosen: Plan, most: int) -> DataFrame:
    """part, key, blocks: the keys that more than ``most`` rows meet at, filed or probing, and the blocks these are dealt in.

    Rows are counted by the key they are filed under before the counts, and not the rows, probe.
    """
    parts = [(part, masks) for part, _, masks in _probes(chosen)]

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, key, n = (c.to_numpy() for c in batch.columns)
            for part, masks in parts:
                step, of = max(1, (1 << 17) // len(masks)), np.flatnonzero(at == part)
                for a in range(0, len(of), step):
                    some = of[a : a + step]
                    arrays = [np.full(len(some) * len(masks), part, np.int32), (key[some, None] ^ masks).ravel(), np.repeat(n[some], len(masks))]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["part", "key", "n"])

    only_filed = Plan(chosen.groups, [min(t, 0) for t in chosen.thresholds], 0.0)
    filed = fps.select("fp").mapInArrow(_signatures(only_filed), SIGNATURE).groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"))
    met = filed.mapInArrow(probing, "part int, key long, n long").groupBy("part", "key").agg(F.sum("n").alias("n"))
    return met.where(F.col("n") > most).select("part", "key", F.ceil(F.col("n") / most).alias("blocks"))


def _dealt(rows: DataFrame, heavy: DataFrame, by: tuple[str, ...] = ("part", "key"), node: str = "fp") -> DataFrame:
    """Rows with the two blocks (i, j) of their key that meet, and which of them (side) is the row's own; a key that is not heavy is one block."""
    own = F.pmod(F.xxhash64(node), "blocks")
    blocks = F.coalesce("blocks", F.lit(1).cast("long")).alias("blocks")
    each = rows.join(heavy, list(by), "left").select(*rows.columns, blocks).withColumn("own", own)
    each = each.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    place = [F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), (F.col("own") > F.col("k")).alias("side")]
    return each.select(*by, *place, *[c for c in rows.columns if c not in by])


def _near(x: np.ndarray, y: np.ndarray, max_bits: int, wide_bits: int) -> np.ndarray:
    """Which rows of two tables of fingerprint words (one row a word) link."""
    if len(x) == 1:
        return np.bitwise_count(x[0] ^ y[0]) <= max_bits
    return sum(np.bitwise_count(a ^ b).astype(np.int64) for a, b in zip(x, y, strict=True)) <= wide_bits


#: Bits and threshold of partitions in which a pair, if it meets there, is taken.
Earlier = list[tuple[np.uint64, int]]


def _near_pairs(words: np.ndarray, stop: int, among: bool, max_bits: int, wide_bits: int, earlier: Earlier = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates x < y in blocks: the first ``stop`` rows against those after them and, if ``among``, each other."""
    fps, n, i = words[0], words.shape[1], 0
    while i < stop:
        first = i if among else stop
        rows = min(max(1, _CELLS // max(1, n - first)), stop - i)
        x, y = np.nonzero(np.bitwise_count(fps[i : i + rows, None] ^ fps[None, first:]) <= max_bits)
        x, y = x + i, y + first
        x, y = x[x < y], y[x < y]
        if len(words) > 1:
            ok = _near(words[:, x], words[:, y], max_bits, wide_bits)
            x, y = x[ok], y[ok]
        for mask, t in earlier:
            ok = np.bitwise_count((fps[x] ^ fps[y]) & mask) > t
            x, y = x[ok], y[ok]
        yield x, y
        i += rows


def _search(
    words: np.ndarray, filed: np.ndarray, max_bits: int, wide_bits: int, ids: np.ndarray | None = None, among: bool = True, earlier: Earlier = ()
) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of one large bucket: its filed rows against all, compared in blocks."""
    order = np.argsort(~filed, kind="stable")
    words, ids = words[:, order], (words[0] if ids is None else ids)[order]
    a, b, waiting = [ids[:0]], [ids[:0]], 0
    for x, y in _near_pairs(words, int(filed.sum()), among, max_bits, wide_bits, earlier):
        a.append(ids[x])
        b.append(ids[y])
        waiting += len(x)
        if waiting > 4 * len(ids) + _CELLS:
            a, b = ([z] for z in _forest(np.concatenate(a), np.concatenate(b)))
            waiting = len(a[0])
    return np.concatenate(a), np.concatenate(b)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges but the roots, with its root."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _across(
    words: np.ndarray, filed: np.ndarray, side: np.ndarray, max_bits: int, wide_bits: int, ids: np.ndarray | None = None, earlier: Earlier = ()
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning edges between two blocks of a bucket: the first's filed rows against all of the second, its others against the second's filed ones."""
    for first, second in ((~side & filed, side), (side & filed, ~side & ~filed)):
        rows = np.concatenate([np.flatnonzero(first), np.flatnonzero(second)])
        yield _search(words[:, rows], np.arange(len(rows)) < first.sum(), max_bits, wide_bits, None if ids is None else ids[rows], False, earlier)


def _bucket_edges(
    part: np.ndarray, key: np.ndarray, filed: np.ndarray, words: np.ndarray, max_bits: int, wide_bits: int, blocks: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Edges inside whole buckets, given sorted by (part, key), or of two blocks of one, given with ``blocks`` (i, j, side) and sorted by them too."""
    fp, n = words[0], len(part)
    i, j, side = np.zeros((3, n), np.int64) if blocks is None else blocks
    cut = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in (part, key, i, j)], axis=0)]))
    size = np.diff(np.append(cut, n))
    two = i[cut] < j[cut]
    a, b = [], []
    for k in np.flatnonzero((size > SMALL_BUCKET) | two):
        whole = slice(cut[k], cut[k] + size[k])
        for found in _across(words[:, whole], filed[whole], side[whole] > 0, max_bits, wide_bits) if two[k] else [_search(words[:, whole], filed[whole], max_bits, wide_bits)]:
            a.append(found[0])
            b.append(found[1])
    small = (size <= SMALL_BUCKET) & ~two
    to_end = np.where(np.repeat(small, size), np.repeat(cut + size, size) - np.arange(n), 0)
    for d in range(1, int(size[small].max(initial=1))):
        x = np.flatnonzero(to_end > d)
        y = x + d
        ok = (filed[x] | filed[y]) & (fp[x] != fp[y]) & (np.bitwise_count(fp[x] ^ fp[y]) <= max_bits)
        x, y = x[ok], y[ok]
        ok = _near(words[:, x], words[:, y], max_bits, wide_bits)
        a.append(fp[x[ok]])
        b.append(fp[y[ok]])
    if not a:
        return fp[:0], fp[:0]
    return _forest(np.concatenate(a), np.concatenate(b))


def _edges(max_bits: int, wide_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                part, key, i, j, side, filed, *words = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                if len(part):
                    a, b = _bucket_edges(part, key, filed, np.stack(words).view(np.uint64), max_bits, wide_bits, np.stack([i, j, side]))
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            place = np.stack(columns[:4])
            if not place.shape[1]:
                continue
            other = np.flatnonzero((place != place[:, -1:]).any(0))
            last = int(other[-1]) + 1 if len(other) else 0
            if last or (held and any(x[-1] != y for x, y in zip(held[-1][:4], place[:, 0], strict=True))):
                # every bucket but the batch's last one is complete
                held.append([x[:last] for x in columns])
                yield from flush()
            held.append([x[last:] for x in columns])
        yield from flush()

    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS, chosen: Plan | None = None) -> DataFrame:
    """Spanning links (a, b) of distinct fingerprints (column fp): they join what all links join."""
    if chosen is None:
        chosen = plan(*bit_counts(fps), max_bits)
    rows = fps.select("fp").mapInArrow(_signatures(chosen), SIGNATURE)
    place = ["part", "key", "i", "j"]
    met = _dealt(rows, durable(heavy_keys(fps, chosen, BLOCK_ROWS))).repartition(*place).sortWithinPartitions(*place)
    return met.mapInArrow(_edges(max_bits, 0), "a long, b long").distinct()


def _whole_buckets(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray | pa.Array]]:
    """The columns of each run of rows with the same first ``keys`` columns, given sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        heads = np.stack([batch.column(k).to_numpy() for k in range(keys)])
        cut = [0, *(np.flatnonzero((heads[:, 1:] != heads[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        if held and (heads[:, 0] != last).any():
            yield _columns(held)
            held = []
        for a, b in zip(cut, cut[1:], strict=False):
            if a:
                yield _columns(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = heads[:, -1]
    if held:
        yield _columns(held)


def _columns(held: list[pa.RecordBatch]) -> list[np.ndarray | pa.Array]:
    whole = pa.Table.from_batches(held).combine_chunks()
    columns = [c.chunk(0) for c in whole.columns]
    return [c if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in columns]


_WIDE_SIGNATURE = "part int, key long, band long, filed boolean, node long, " + ", ".join(f"{c} long" for c in _WORD_NAMES)


def _wide_signatures(chosen: Plan):
    """Rows (node, band, words) to the keys that they are filed under or probe, in their own band and the next."""
    parts = _probes(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [c.to_numpy() for c in batch.columns]
            for part, group, masks in parts:
                step = max(1, (1 << 15) // len(masks))
                for a in range(0, len(every[0]), step):
                    node, band, *words = (c[a : a + step] for c in every)
                    keys = _bits_of(words[0])[:, group].astype(np.int64) @ (1 << np.arange(len(group), dtype=np.int64))
                    probes, own = (keys[:, None] ^ masks).ravel(), np.repeat(band, len(masks))
                    carried = [np.repeat(c, len(masks)) for c in (node, *words)]
                    for up in (0, 1):
                        filed = np.tile((np.arange(len(masks)) == 0) & (up == 0), len(node))
                        arrays = [np.full(len(probes), part, np.int32), probes, own + up, filed, *carried]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["part", "key", "band", "filed", "node", *_WORD_NAMES])

    return run


def _meeting(sets: DataFrame, chosen: Plan) -> DataFrame:
    """part, key, band, filed, n: how many sets are filed under a key of a band, and how many rows meet there."""
    parts = {part: (group, masks) for part, group, masks in _probes(chosen)}
    names = ["part", "key", "band", "filed", "n"]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band, fps = (c.to_numpy() for c in batch.columns)
            for part, (group, _) in parts.items():
                key = _bits_of(fps)[:, group].astype(np.int64) @ (1 << np.arange(len(group), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(fps), part, np.int32), key, band)], names[:3])

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, key, band, n = (c.to_numpy() for c in batch.columns)
            for p, (_, masks) in parts.items():
                step, of = max(1, (1 << 17) // len(masks)), np.flatnonzero(part == p)
                for a in range(0, len(of), step):
                    some, each = of[a : a + step], len(masks)
                    for up in (0, 1):
                        own = np.repeat(n[some], each)
                        filed = own * np.tile((np.arange(each) == 0) & (up == 0), len(some))
                        arrays = [np.full(len(own), p, np.int32), (key[some, None] ^ masks).ravel(), np.repeat(band[some], each) + up, filed, own]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names)

    filed = sets.select("band", "fp").mapInArrow(keys, "part int, key long, band long").groupBy(names[:3]).agg(F.count(F.lit(1)).alias("n"))
    met = filed.mapInArrow(probing, "part int, key long, band long, filed long, n long")
    return met.groupBy(names[:3]).agg(F.sum("filed").alias("filed"), F.sum("n").alias("n")).where("filed > 0")


def wide_plan(sets: DataFrame, max_bits: int) -> Plan:
    """Partitions and thresholds for sets that probe two bands; at a limit of all bits one key without bits, as no pair differs in more."""
    if max_bits >= BITS:
        return Plan([[]], [0], 0.0)
    n = {r["band"]: r["count"] for r in sets.groupBy("band").count().collect()}  # bands are few by construction
    pairs = sum(c * c / 2 + c * n.get(b + 1, 0) for b, c in n.items())
    return plan(*bit_counts(sets), max_bits, pairs, max(MAX_WIDE_ROWS, 2 * (max_bits + 2)), 2)


def candidates(sets: DataFrame, max_bits: int, wide_bits: int, chosen: Plan | None = None) -> DataFrame:
    """Spanning links (a, b) of the nodes of ``sets`` that the bits take for similar."""
    chosen = wide_plan(sets, max_bits) if chosen is None else chosen
    by, used = ("part", "key", "band"), [(part, group) for part, group, _ in _probes(chosen)]
    masks = {part: (np.uint64(sum(1 << b for b in group.tolist())), chosen.thresholds[part]) for part, group in used}
    met = durable(_meeting(sets, chosen))
    heavy = met.where(F.col("n") > BLOCK_ROWS).select(*by, F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks"))
    pairs = met.agg(F.sum(F.col("filed").cast("double") * F.col("n")).alias("pairs")).first()["pairs"] or 0
    tasks = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs / TASK_PAIRS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _, i, j, side, filed, node, *words in _whole_buckets(batches, 5):
            if len(node) < 2 or not filed.any():
                continue
            words, earlier = np.stack(words).view(np.uint64), [m for p, m in masks.items() if p < part[0]]
            if i[0] == j[0]:
                found = [_search(words, filed, max_bits, wide_bits, node, earlier=earlier)]
            else:
                found = list(_across(words, filed, side, max_bits, wide_bits, node, earlier))
            a, b = _forest(*(np.concatenate(x) for x in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rows = sets.select("node", "band", *_WORD_NAMES).mapInArrow(_wide_signatures(chosen), _WIDE_SIGNATURE)
    place = [*by, "i", "j"]
    dealt = _dealt(rows, heavy, by, "node").repartition(tasks, *place).sortWithinPartitions(*place)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted arrays without repeats have the Jaccard similarity ``SIMILAR``."""
    part, whole = SIMILAR
    if whole * min(len(x), len(y)) < part * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return whole * common >= part * (len(both) - common)


def _decide(max_bits: int, wide_bits: int):
    """Spanning links of the sets of each pair of blocks by exact similarity; pairs already joined are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, i, j, side, node, hashes, *words in _whole_buckets(batches, 3):
            order = np.argsort(side, kind="stable")
            sets = [np.frombuffer(hashes[k].as_buffer(), np.uint64) for k in order.tolist()]
            node, label, a, b = node[order], np.arange(len(order)), [], []
            for x, y in _near_pairs(np.stack(words).view(np.uint64)[:, order], int((~side).sum()), i[0] == j[0], max_bits, wide_bits):
                apart = label[x] != label[y]
                x, y = x[apart], y[apart]
                while len(x):
                    for p, q in zip(x[:_DECIDED].tolist(), y[:_DECIDED].tolist(), strict=True):
                        if label[p] != label[q] and similar(sets[p], sets[q]):
                            label[label == label[q]] = label[p]
                            a.append(p)
                            b.append(q)
                    apart = label[x[_DECIDED:]] != label[y[_DECIDED:]]
                    x, y = x[_DECIDED:][apart], y[_DECIDED:][apart]
            yield pa.RecordBatch.from_arrays([pa.array(node[np.array(z, np.int64)]) for z in (a, b)], ["a", "b"])

    return run


def _sets_of(texts: DataFrame, shingle: int) -> DataFrame:
    """node, hashes (the sorted set) of a column of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column(0)]
            node = np.array([set_digest(x) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "hashes"])

    return texts.mapInArrow(run, "node long, hashes binary")


def component_blocks(met: DataFrame) -> DataFrame:
    """component, blocks: in how many blocks the sets of each component are dealt."""
    shared = F.least(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.lit(BLOCKS).cast("long"))
    return met.groupBy("component").agg(F.greatest(F.ceil(F.sum("size") / BLOCK_HASHES), shared).alias("blocks"))


def similar_links(sets: DataFrame, docs: DataFrame, text_col: str, shingle: int, max_bits: int, wide_bits: int) -> DataFrame:
    """Links (a, b) of the nodes of ``sets`` (a written table): they join what all links by exact similarity join."""
    found = connected_components(durable(candidates(sets, max_bits, wide_bits)))
    met = durable(found.join(sets, "node").select("component", "node", "text_key", "size", *_WORD_NAMES))
    blocks = component_blocks(met)
    own = F.pmod("node", "blocks")
    dealt = (
        met.join(blocks, "component")
        .select("component", "node", *_WORD_NAMES, own.alias("own"), F.explode(F.expr("sequence(0L, greatest(blocks, 1L) - 1)")).alias("k"))
        .select("component", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), (F.col("own") > F.col("k")).alias("side"), "node", *_WORD_NAMES)
    )
    texts = docs.select(F.col(text_col).alias("text"), _text_key(text_col).alias("text_key"))
    _, texts = split_known(texts, "text_key", met, "text_key")
    hashes = _sets_of(texts.select("text"), shingle).join(met.select("node"), "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes"))
    place = ["component", "i", "j"]
    rows = dealt.join(durable(hashes), "node").select(*place, "side", "node", "hashes", *_WORD_NAMES)
    return rows.repartition(*place).sortWithinPartitions(*place).mapInArrow(_decide(max_bits, wide_bits), "a long, b long")


def _grouped(rows: DataFrame, every: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """``rows`` with their component_id, the least doc_id of those that the links of ``node`` join."""
    found = connected_components(durable(edges)).withColumnRenamed("node", "_node")
    found = durable(found.join(every, F.col("_node") == F.col(node)).select(node, "component", "first_id"))
    of = durable(found.groupBy("component").agg(F.min("first_id").alias("component_id")))
    linked = found.join(of, "component").select(node, "component_id")
    copies = every.where("n > 1").join(linked, node, "left_anti").select(node, F.col("first_id").alias("component_id"))
    classes = durable(linked.unionByName(copies))
    return rows.join(classes, node, "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, wide_bits: int = 0
) -> DataFrame:
    """doc_id, fp, component_id, one row per row of ``docs``."""
    node = "node" if wide_bits else "fp"
    rows = durable((set_fingerprints if wide_bits else fingerprints)(docs, id_col, text_col, shingle))
    others = [c for c in rows.columns if c not in ("doc_id", node)]
    every = durable(rows.groupBy(node).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in others]))
    edges = similar_links(every, docs, text_col, shingle, max_bits, wide_bits) if wide_bits else links(every, max_bits)
    return _grouped(rows, every, edges, node)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, wide_bits: int = 0
) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id, one row per row of ``docs``."""
    found = components(docs, id_col, text_col, shingle, max_bits, wide_bits)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    max_bits: int = SIMILAR_BITS,
    wide_bits: int = SIMILAR_WIDE_BITS,
) -> DataFrame:
    """The whole rows of ``docs`` without near duplicates: of each group the row of the least id stays.

    The defaults find sets of five-word shingles with a Jaccard similarity of ``SIMILAR`` or more,
    and only those link. Null ids
    come last; of rows with one id the text's digest decides, and of equal rows one stays. Rows that
    a Bloom filter of the texts of which some row goes does not know pass straight through, and only
    the others shuffle their text.
    """
    key = F.unhex(F.md5(text_or_empty(text_col).cast("binary")))
    place = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), key.alias("key"))
    placed = docs.select(place.alias("place"), F.col(text_col).alias("text"))
    each = components(placed, "place", "text", shingle, max_bits, wide_bits).groupBy("doc_id", "component_id").agg(F.count(F.lit(1)).alias("n"))
    # texts of which some row goes; all others pass through the join untouched
    groups = (
        each.groupBy(F.col("doc_id.key").alias("_key"))
        .agg(F.first("component_id").alias("_stays"), F.max("n").alias("_n"), F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_k"))
        .where("_k > 1 or _n > 1 or _least <> _stays")
    )
    groups = durable(groups)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), place.alias("_place"), key.alias("_text"))
    through, affected = split_known(whole, "_text", groups, "_key")
    met = affected.join(groups, F.col("_text") == F.col("_key"), "left").where("_key is null or _stays = _place")
    single = met.where("_key is null or _n = 1").select("_row.*")
    repeated = met.where("_n > 1").groupBy("_text").agg(F.first("_row").alias("_row")).select("_row.*")
    return through.select("_row.*").unionByName(single).unionByName(repeated)
