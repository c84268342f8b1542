"""Removal of repeated long substrings, with bucket-pointer refinement.

Every byte goes that lies in a string of ``LENGTH`` bytes which also starts anywhere else.

Anchors make the search sparse. Among the ``GRAM``-byte strings of each window of ``LENGTH``
bytes the one of least hash is its anchor (the rightmost on a tie), so equal windows have
equal anchors at equal places. Neighbouring windows with one anchor form a run; a run's
content is all bytes of its windows, ``LENGTH`` and about 170 more.

1. One pass over the texts gives a row for each run: hashes of its anchor and its content, and
   where it lies. Anchors that occur once are dropped. Runs whose content occurs twice repeat
   as a whole: counts settle them.
2. What is left are anchors with several different contents. One run of each content is
   brought to its anchor's bucket, and the bucket's windows are sorted by bucket-pointer
   refinement: buckets of 8-byte strings are refined by sorting on the bucket identifiers of
   later offsets, whose length doubles as the identifiers just made are used again, up to
   ``LENGTH``; buckets of one string need no further sorting. Windows that share a final bucket
   repeat; those of a settled run teach the others of its bucket but need no answer.
3. A bucket of more than ``HOT`` contents is not brought together. Its windows are cut into
   cells by their place before the anchor, and refined by what is common to a cell's windows
   and then by the cell's content, both counted before the shuffle; windows of cells that stay
   open are counted one by one. So a passage that a third of all documents share costs a few
   slim rows a document and no large group.

A text's identity is its MD5 digest: copies of a text have the same runs and get the same
answer. Answers are spans; they meet the texts once more, and bytes outside stay.

Matches never cross documents. Overlapping occurrences count, also in one document. Strings
are judged on the input, not on what is left. A run's count is exact up to 128 bits of hash
(64 of the anchor, 64 of the content); windows in a bucket are compared by their bytes.

Defined cases: a null text is empty; a text under ``LENGTH`` bytes keeps all; repeated rows
are copies of one another and lose all their windows; null ids are carried along; an empty
table gives an empty result. One worker holds one text, or the contents of some buckets, at a
time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_durable, durable, text_or_empty

LENGTH = 400
GRAM = 64
HOT = 512
#: Windows of a cell of a hot bucket.
CELL = 21
#: Bytes of content that one refinement sorts together; windows that one pass of hashing covers.
_TOGETHER = 1 << 19
_PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1
_digest = xxhash.xxh3_64_intdigest


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every ``gram`` bytes; lengths double, so ``gram`` is a power of two."""
    h, power, size = data.astype(np.uint64) + np.uint64(1), _BASE, 1
    while size < gram:
        h = h[:-size] * np.uint64(power) + h[size:]
        power, size = power * power & _M64, 2 * size
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    out, size = values, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def find_runs(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts of ``length`` bytes or more: number of the text, anchor hash, first and last window."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.cumsum(sizes) - sizes
    every = np.frombuffer(b"".join(texts), np.uint8)
    n, width = len(every) - length + 1, length - gram + 1
    # a text's windows begin at its offset and end where a window would cross into the next
    borders = np.unique(np.concatenate([offsets, offsets + sizes - length + 1]))
    for a in range(0, max(n, 0), _PIECE):
        b = min(n, a + _PIECE)
        h = gram_hashes(every[a : b + length - 1], gram)
        least = _least(h, width)
        # the anchor moves where the least hash changes, and where the gram that enters equals it
        new = h[width - 1 :] == least
        new[1:] |= least[1:] != least[:-1]
        new[0] = True
        new[borders[(borders >= a) & (borders < b)] - a] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], b - a) - 1
        text = np.searchsorted(offsets, first + a, "right") - 1
        inside = first + a - offsets[text] <= sizes[text] - length
        first, last, text = first[inside], last[inside], text[inside]
        yield text, least[first], first + a - offsets[text], last + a - offsets[text]


def _texts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Number of the first text and the texts, about ``_PIECE`` bytes at a time."""
    some, size, at = [], 0, 0
    for k, value in enumerate(column):
        some.append((value.as_py() or "").encode("utf-8", "replace"))
        size += len(some[-1])
        if size >= _PIECE:
            yield at, some
            some, size, at = [], 0, k + 1
    if some:
        yield at, some


def _run_rows(length: int, gram: int):
    """(key, text) -> a row for each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _texts(batch.column(1)):
                for text, anchor, first, last in find_runs(texts, length, gram):
                    spans = zip(text.tolist(), first.tolist(), (last + length).tolist(), strict=True)
                    content = np.fromiter((_digest(texts[k][a:b]) for k, a, b in spans), np.uint64, len(text))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(anchor.view(np.int64)),
                            pa.array(content.view(np.int64)),
                            batch.column(0).take(pa.array(text + at)),
                            pa.array(first.astype(np.int32)),
                            pa.array(last.astype(np.int32)),
                        ],
                        ["anchor", "content", "key", "first", "last"],
                    )

    return run


def refine(data: np.ndarray, bucket: np.ndarray, length: int, windows: np.ndarray) -> np.ndarray:
    """Which of the ``windows`` (start offsets) share bucket and ``length`` bytes with another.

    ``bucket`` numbers the group each byte belongs to. Offsets that run over the end of the
    data read zeros; no window does.
    """
    n, size = len(data), 8
    padded = np.concatenate([data, np.zeros(size, np.uint8)])
    grams = np.zeros(n, np.uint64)
    for j in range(size):
        grams = grams << np.uint64(8) | padded[j : j + n].astype(np.uint64)
    pointer, count = _buckets(np.unique(grams, return_inverse=True)[1], bucket)
    while size < length:
        step = min(size, length - size)
        later = np.zeros(n, np.int64)
        later[: n - step] = pointer[step:]
        size += step
        # buckets of one are settled; the last sorting needs the windows only
        open_ = windows if size == length else np.arange(n)
        open_ = open_[count[pointer[open_]] > 1]
        new, sizes = _buckets(pointer[open_], later[open_])
        pointer[open_] = new + len(count)
        count = np.concatenate([count, sizes])
    return count[pointer[windows]] > 1


def _buckets(at: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers in sorted order of (bucket, bucket at the later offset), and bucket sizes."""
    pair = at.astype(np.int64) * (int(later.max(initial=0)) + 1) + later
    _, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
    return inverse.astype(np.int64), count


def _spans(flags: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of flagged consecutive windows as byte spans; ``starts`` ascend by 1."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return starts[a], starts[b - 1] + length


def _refined(length: int):
    """Rows (anchor, key, first, last, settled, data) sorted by anchor -> spans (key, a, b)."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(r[5]) for r in rows])
        group = np.unique(np.array([r[0] for r in rows]), return_inverse=True)[1]
        n_windows = sizes - length + 1
        inside = np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        windows = np.repeat(np.cumsum(sizes) - sizes, n_windows) + inside
        repeated = refine(np.frombuffer(b"".join(r[5] for r in rows), np.uint8), np.repeat(group, sizes), length, windows)
        keys, a, b, cut = [], [], [], 0
        for row, n in zip(rows, n_windows.tolist(), strict=True):
            flags, cut = repeated[cut : cut + n], cut + n
            if not row[4] and flags.any():
                x, y = _spans(flags, row[2] + np.arange(n), length)
                keys += [row[1]] * len(x)
                a += x.tolist()
                b += y.tolist()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > _TOGETHER and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
        if rows:
            yield solve(rows)

    return run


def _contents(length: int):
    """(key, text, runs) -> the bytes of each run asked for."""
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py().encode("utf-8", "replace")
                rows = [
                    (r["anchor"], key, r["first"], r["last"], r["settled"], data[r["first"] : r["last"] + length], r["hot"])
                    for r in batch.column(2)[i].as_py()
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], CONTENT_SCHEMA.names
                )

    return run


class CONTENT_SCHEMA:
    names = ["anchor", "key", "first", "last", "settled", "data", "hot"]
    ddl = "anchor long, key binary, first int, last int, settled boolean, data binary, hot boolean"


def _cells(length: int, gram: int, cell: int):
    """Hot contents -> a row for each cell of their windows, filed under what the cell's windows share.

    A window's place is the distance from its start to the anchor, so cells of different
    contents cover the same places. With ``cell`` 1 a cell is a window.
    """
    width = length - gram + 1
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, key, first, last, settled, data, *only in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = gram_hashes(np.frombuffer(data, np.uint8), gram)[:width]
                place = width - 1 - int(h[::-1].argmin())
                rows = []
                for number in range((place - (last - first)) // cell, place // cell + 1):
                    low, high = place - number * cell - cell + 1, place - number * cell  # windows of the cell, in this content
                    a, b = max(low, 0), min(high, last - first)
                    shared = data[max(high, 0) : low + length] if cell > 1 else data[a : a + length]
                    bucket = _digest(shared, anchor + number & _M64) >> 1
                    rows.append((bucket, _digest(data[a : b + length], a - low) >> 1, key, first + a, first + b, settled, anchor))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    ["bucket", "content", "key", "first", "last", "settled", "anchor"],
                )

    return run


CELL_DDL = "bucket long, content long, key binary, first int, last int, settled boolean, anchor long"


def _hot_spans(hot: DataFrame, length: int, gram: int, cell: int) -> DataFrame:
    """Spans of hot buckets: by cells, and by windows inside the cells that stay open."""
    cells = durable(hot.mapInArrow(_cells(length, gram, cell), CELL_DDL))
    contents = durable(cells.groupBy("bucket", "content").agg(F.count(F.lit(1)).alias("n")))
    again = contents.where("n > 1").select("bucket", "content")
    ends = [F.col("key"), F.col("first").alias("a"), (F.col("last") + length).alias("b")]
    spans = durable(cells.where("not settled").join(again, ["bucket", "content"]).select(*ends))
    several = durable(contents.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("bucket"))
    # one run of each cell content stands for all in the windows of open cells
    reps = cells.join(several, "bucket").groupBy("bucket", "content").agg(
        F.min(F.struct("key", "first", "last")).alias("one"), F.min("anchor").alias("anchor"), F.count(F.lit(1)).alias("n"), F.min("settled").alias("settled")
    )
    opened = durable(
        reps.select("anchor", "one.*", ((F.col("n") > 1) | F.col("settled")).alias("done"))
        .withColumnsRenamed({"first": "low", "last": "high"})
    )
    data = hot.select("anchor", "key", "first", "last", "data").join(opened, ["anchor", "key"]).where("low >= first and high <= last")
    part = F.expr(f"substring(data, low - first + 1, high - low + {length})")
    windows = durable(
        data.select("anchor", "key", F.col("low").alias("first"), F.col("high").alias("last"), F.col("done").alias("settled"), part.alias("data"))
        .mapInArrow(_windows(length), CELL_DDL)
    )
    often = durable(windows.groupBy("anchor", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", "bucket"))
    return spans.unionByName(durable(windows.where("not settled").join(often, ["anchor", "bucket"]).select(*ends)))


def _windows(length: int):
    """Parts of contents -> a row for each window, in the columns of ``_cells``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, key, first, last, settled, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = last - first + 1
                at = (first + np.arange(n)).astype(np.int32)
                hashes = np.fromiter((_digest(data[i : i + length]) for i in range(n)), np.uint64, n).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes),
                        pa.array(hashes),
                        pa.array([key] * n, pa.binary()),
                        pa.array(at),
                        pa.array(at),
                        pa.array([settled] * n, pa.bool_()),
                        pa.array(np.full(n, anchor, np.int64)),
                    ],
                    ["bucket", "content", "key", "first", "last", "settled", "anchor"],
                )

    return run


def _identity(text_col: str) -> Column:
    return F.unhex(F.md5(text_or_empty(text_col).cast("binary")))


def _spans_of(texts: DataFrame, length: int, gram: int, hot: int, cell: int) -> tuple[DataFrame, DataFrame]:
    """Spans (key, a, b) to remove, and the distinct texts (key, text) that have repeated anchors."""
    runs = durable(texts.mapInArrow(_run_rows(length, gram), "anchor long, content long, key binary, first int, last int"))
    again = durable(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    met = durable(runs.join(again, "anchor"))
    drop_durable(runs)
    # copies of a text have the same runs: one row for each place, with the number of copies
    places = durable(met.groupBy("anchor", "content", "key", "first", "last").agg(F.count(F.lit(1)).alias("n")))
    contents = durable(
        places.groupBy("anchor", "content").agg(F.sum("n").alias("n"), F.min(F.struct("key", "first", "last")).alias("one"))
    )
    drop_durable(met)
    active = durable(
        texts.groupBy("key").agg(F.first("text").alias("text")).join(places.select("key").distinct(), "key", "left_semi")
    )
    # written on its own, the join has nothing after it, so that Spark may split a content that many texts share
    settled = durable(
        places.join(contents.where("n > 1").select("anchor", "content"), ["anchor", "content"]).select(
            "key", F.col("first").alias("a"), (F.col("last") + length).alias("b")
        )
    )
    several = durable(contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    run = F.struct(
        "anchor", F.col("one.first").alias("first"), F.col("one.last").alias("last"), (F.col("n") > 1).alias("settled"), (F.col("k") > hot).alias("hot")
    )
    wanted = contents.join(several, "anchor").select(F.col("one.key").alias("key"), run.alias("run"))
    wanted = wanted.groupBy("key").agg(F.collect_list("run").alias("runs"))
    data = durable(active.join(wanted, "key").select("key", "text", "runs").mapInArrow(_contents(length), CONTENT_SCHEMA.ddl))
    one = [c for c in CONTENT_SCHEMA.names if c != "hot"]
    cold = data.where("not hot").select(*one).repartition("anchor").sortWithinPartitions("anchor")
    refined = durable(cold.mapInArrow(_refined(length), "key binary, a int, b int"))
    return settled.unionByName(refined).unionByName(_hot_spans(data.where("hot").select(*one), length, gram, cell)), active


def _cut(with_kept: bool):
    """(key, text, spans) -> what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_py().encode("utf-8", "replace")
                cuts = np.array([(s["a"], s["b"]) for s in spans.as_py()], np.int64)
                cuts = cuts[np.argsort(cuts[:, 0], kind="stable")]
                reach = np.maximum.accumulate(cuts[:, 1])
                head = np.flatnonzero(np.concatenate([[True], cuts[1:, 0] > reach[:-1]]))
                a, b = cuts[head, 0], reach[np.append(head[1:], len(cuts)) - 1]
                kept = b"".join(data[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(data)], strict=True))
                out[0].append(int((b - a).sum()))
                out[1].append(len(a))
                out[2].append(hashlib.sha256(kept).hexdigest())
                out[3].append(kept if with_kept else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.binary())],
                ["key", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    hot: int = HOT,
    cell: int = CELL,
    with_kept: bool = True,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``with_kept``, kept (binary)."""
    if gram & (gram - 1) or not 8 <= gram <= length:
        raise ValueError("gram is a power of two from 8 to length")
    key, n_bytes = _identity(text_col), F.octet_length(text_or_empty(text_col))
    texts = docs.select(key.alias("key"), F.col(text_col).alias("text")).where(F.octet_length("text") >= length)
    spans, active = _spans_of(texts, length, gram, hot, cell)
    spans = durable(spans.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    extra = [] if not with_kept else ["kept"]
    answers = active.join(spans, "key").select("key", "text", "spans")
    answers = answers.mapInArrow(_cut(with_kept), "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary")
    answers = durable(answers.select("key", "n_removed", "n_spans", F.col("kept_sha256").alias("cut_sha256"), *extra))
    whole = text_or_empty(text_col).cast("binary")
    slim = docs.select(
        F.col(id_col).alias("doc_id"), key.alias("key"), n_bytes.cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("sha"),
        *([whole.alias("whole")] if with_kept else []),
    )
    out = slim.join(answers, "key", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("cut_sha256", "sha").alias("kept_sha256"),
        *([F.coalesce("kept", "whole").alias("kept")] if with_kept else []),
    )
    return out
