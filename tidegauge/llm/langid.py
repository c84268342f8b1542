"""Language identification by rank-order n-gram profiles.

A profile lists the ``TOP`` most frequent letter n-grams (one to three letters, word ends
included) of a language, most frequent first. A document's own list is compared to each
profile by out-of-place distance: the differences of the ranks, summed, with ``TOP`` for an
n-gram that the profile lacks. The nearest language wins; ties go to the first in
alphabetical order.

Profiles are learned from about ``SAMPLE`` different whole texts a language, drawn by a hash of
the text among those of the labelled training rows, and from all if there are no more; the bound
is a parameter. Copies of a text count once, in the share that is drawn as well.
Prediction reads every whole text and nothing else, long ones in pieces whose counts add up,
and needs no shuffle. The profiles are broadcast: ``TOP`` n-grams for each of at most
``MAX_LANGUAGES`` languages.

Defined cases: a null text or one without letters is ``und`` with score 0, and so is every
text if nothing was learned; a null id counts as the empty string in the split; repeated
rows are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOP = 300
SAMPLE = 2000
MAX_LANGUAGES = 2000
UNKNOWN = "und"
PIECE_CHARS = 1 << 20
#: Bits of a letter in an n-gram (no letter lies above); the length stands above three of them.
_BITS = 20
_SIZE = 3 * _BITS


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Lower-case letters as numbers, one 0 for each run of other characters, 0 at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    codes = np.where(_letters()[codes], codes, 0)
    framed = np.concatenate([[0], codes, [0]])
    return framed[np.concatenate([[True], (framed[1:] > 0) | (framed[:-1] > 0)])]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as sorted numbers, and their counts."""
    keys, counts, a = [], [], 0
    while a < len(text):
        # a space ends a word either way, so a cut there changes no count
        cut = text.find(" ", a + PIECE_CHARS)
        cut = len(text) if cut < 0 else cut
        codes, a = _codes(text[a:cut]), cut
        if len(codes) < 3:  # no letters
            continue
        two, three = codes[:-1] << _BITS | codes[1:], codes[:-2] << 2 * _BITS | codes[1:-1] << _BITS | codes[2:]
        grams = [codes[codes > 0] | 1 << _SIZE, two | 2 << _SIZE, three[codes[1:-1] > 0] | 3 << _SIZE]
        k, n = np.unique(np.concatenate(grams), return_counts=True)
        keys.append(k)
        counts.append(n)
    if len(keys) == 1:
        return keys[0], counts[0]
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inverse, np.concatenate(counts), len(k)).astype(np.int64)


def top_grams(keys: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """Most frequent first; equal counts in the order of the n-grams' numbers."""
    return keys[np.argsort(-counts, kind="stable")[:top]]


class Profiles:
    """The ranks of all languages over the union of their n-grams."""

    def __init__(self, ranked: dict[str, list[int]], top: int = TOP) -> None:
        self.languages = sorted(ranked)
        self.top = top
        self.grams = np.unique(np.concatenate([np.zeros(0, np.int64), *[np.array(ranked[x], np.int64) for x in self.languages]]))
        # out of every rank's reach: the difference is cut at ``top``
        self.ranks = np.full((len(self.grams), len(self.languages)), 3 * top, np.int64)
        for j, x in enumerate(self.languages):
            self.ranks[np.searchsorted(self.grams, np.array(ranked[x], np.int64)), j] = np.arange(len(ranked[x]))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (how much nearer it is than the next, 0 to 1), distance (0 to 1)."""
        if not text or not self.languages:
            return UNKNOWN, 0.0, 1.0
        own = top_grams(*gram_counts(text), self.top)
        if not len(own):
            return UNKNOWN, 0.0, 1.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = np.flatnonzero(self.grams[at] == own)
        away = np.minimum(np.abs(self.ranks[at[known]] - known[:, None]), self.top).sum(0)
        away = (away + (len(own) - len(known)) * self.top) / (len(own) * self.top)
        best = int(away.argmin())
        others = np.delete(away, best)
        second = float(others.min()) if len(others) else 1.0
        score = 1 - away[best] / second if second > 0 else 0.0
        return self.languages[best], float(min(max(score, 0.0), 1.0)), float(away[best])


def remainder(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            by.setdefault(lang.as_py(), []).append(gram_counts(text.as_py()))
        for lang, found in by.items():
            keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([n for _, n in found]), len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])


def sample_texts(labelled: DataFrame, sample: int = SAMPLE) -> DataFrame | None:
    """About ``sample`` different texts of each language of (lang, text), all if it has no more; None without rows."""
    place = F.xxhash64("text", "lang")
    # copies count once, or a language of copies would leave too few texts or none
    sizes = {r["lang"]: r["count"] for r in labelled.select("lang", place.alias("place")).distinct().groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    if not sizes:
        return None
    share = labelled.sparkSession.createDataFrame([(x, min(1.0, sample / n)) for x, n in sizes.items()], "lang string, share double")
    fine = 10**12
    drawn = labelled.join(F.broadcast(share), "lang").where(F.pmod(place, F.lit(fine)) < F.col("share") * fine)
    return drawn.dropDuplicates(["lang", "text"]).select("lang", "text")


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, top: int = TOP) -> Profiles:
    """Profiles of the labelled rows; rows without text or label teach nothing."""
    labelled = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    drawn = sample_texts(labelled, sample)
    if drawn is None:
        return Profiles({}, top)
    counts = drawn.mapInArrow(_count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked: dict[str, list[int]] = {}
    for r in counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).orderBy("lang", "rank").collect():
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked, top)


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score, distance."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(2)]
            lang, score, distance = ([x[k] for x in found] for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(distance, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score", "distance"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), (remainder(id_col, folds) == 0).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        run, f"doc_id {rows.schema[0].dataType.simpleString()}, held_out boolean, lang_pred string, score double, distance double"
    )


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """Learn from the rows whose remainder is not 0 and predict every row."""
    return predict(docs, train(docs.where(remainder(id_col, folds) != 0), text_col, lang_col), id_col, text_col, folds)


def keep_languages(docs: DataFrame, profiles: Profiles, max_distance: float, text_col: str = "text") -> DataFrame:
    """The whole rows that have a language and lie within ``max_distance`` of its profile."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (shared.value.predict(t.as_py()) for t in batch.column(at))
            yield batch.filter(pa.array([lang != UNKNOWN and away <= max_distance for lang, _, away in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
