"""Token counts of a document's sections by offset-mapped attribution.

A document is encoded whole, once, so its tokens are those the model sees and the counts add
up to the document's. Each token has a character span; spans are joined to the sections by
position (both ascend, so two binary searches answer the interval join). A token inside one
section counts there. A token that crosses a boundary is allocated by the rule:

* ``largest``: the section that holds most of its characters, the earlier one on a tie;
* ``first``: the section of its first character;
* ``last``: the section of its last character.

Sections are the lines of the text by default, each with its line end, so they cover every
character; a column of arrays of boundaries may say otherwise. Nothing shuffles.

Defined cases: a null or empty text has one section, 0, without characters or tokens;
boundaries are clipped to the text, sorted and counted once; a token that is part of a
character spans that character; repeated rows are counted one by one; an empty table gives
an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec, chunks, codec, read_vocabulary

RULES = ("largest", "first", "last")


def token_spans(text: str, ids: list[int], coder: Codec) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last character of each token."""
    sizes = np.fromiter(map(len, map(coder.bytes_of.__getitem__, ids)), np.int64, len(ids))
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if len(raw) == len(text):
        ends = np.cumsum(sizes)
        return ends - sizes, ends
    char_of = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character that a byte belongs to
    ends = np.cumsum(sizes)
    return char_of[ends - sizes], char_of[ends - 1] + 1


def line_starts(text: str) -> list[int]:
    out, at = [0], text.find("\n")
    while 0 <= at < len(text) - 1:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return out


def attribute(starts: np.ndarray, length: int, first: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross a boundary."""
    low, high = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, end - 1, "right") - 1
    to = (high if rule == "last" else low).copy()
    crossing = np.flatnonzero(low != high)
    if rule == "largest":
        borders = np.append(starts, length)
        for k in crossing.tolist():
            cuts = np.clip(borders[low[k] : high[k] + 2], first[k], end[k])
            to[k] = low[k] + int(np.diff(cuts).argmax())
    return np.bincount(to, minlength=len(starts)), np.bincount(to[crossing], minlength=len(starts))


def section_tokens(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "largest", starts_col: str | None = None
) -> DataFrame:
    """doc_id, section, char_start, char_end, n_tokens, n_crossing; a row for each section."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value)
        for batch in batches:
            at = 0
            for texts in chunks(batch.column(1)):
                out: list[list[np.ndarray]] = [[] for _ in range(5)]
                sections = []
                for k, (text, ids) in enumerate(zip(texts, coder.encode_all(texts), strict=True)):
                    given = batch.column(2)[at + k].as_py()
                    starts = np.array(line_starts(text) if given is None else sorted({0, *(x for x in given if x and 0 < x < len(text))}), np.int64)
                    n, crossing = attribute(starts, len(text), *token_spans(text, ids, coder), rule)
                    for column, values in zip(out, (np.arange(len(starts)), starts, np.append(starts[1:], len(text)), n, crossing), strict=True):
                        column.append(values)
                    sections.append(len(starts))
                if texts:
                    ids_ = batch.column(0).take(pa.array(np.repeat(np.arange(at, at + len(texts)), sections)))
                    columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in out]
                    yield pa.RecordBatch.from_arrays([ids_, *columns], ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"])
                at += len(texts)

    starts = F.col(starts_col) if starts_col else F.lit(None)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), starts.cast("array<int>").alias("starts"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, section long, char_start long, char_end long, n_tokens long, n_crossing long")
