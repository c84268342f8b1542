"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass one gives each row two slots of an ``m``-bit filter and counts the rows of each slot;
only slots with two rows or more become bits of the second filter. Pass two probes it: a row
whose two bits are set is possibly repeated and shuffles by the digest of its text, every
other row is certainly unique and passes straight through.

The filter has 16 bits a row, so about 1.4 % of the unique rows shuffle needlessly; they
change no result. Its packed bitmaps are broadcast. A filter of more than ``MAX_FILTER_BITS``
(128 MB, a bound that holds by construction) is split by hash range into blocks of that size,
and each block's rows are probed by its block alone, one block after the other; the slim digests
are dealt by block first, the texts never are.

Whole rows are probed by a filter of their own, of the texts that really repeat: a row that it
does not know passes straight through with its text.

Defined cases: a null text is the empty text; a null id comes after every other id when the
row that stays is chosen; rows alike in id, length and normalised text tie, and exactly one
of them stays; an empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, text_or_empty

BITS_PER_ROW = 16
MAX_FILTER_BITS = 1 << 30
#: Bits of one bitmap of ``bitmap_construct_agg``.
BITMAP_BITS = 32768
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_or_empty(text), WHITE_SPACE, "")


@dataclass(frozen=True)
class Size:
    """``blocks`` filters of ``bits`` bits each, both powers of two."""

    bits: int
    blocks: int = 1


def filter_size(n_rows: int) -> Size:
    """At least ``BITS_PER_ROW`` bits a row and one bitmap, in blocks of at most ``MAX_FILTER_BITS``."""
    whole = max(BITMAP_BITS, 1 << (max(1, n_rows * BITS_PER_ROW) - 1).bit_length())
    bits = min(whole, max(BITMAP_BITS, MAX_FILTER_BITS))
    return Size(bits, whole // bits)


def _block(sha: str, size: Size) -> Column:
    return F.pmod(F.xxhash64(sha, F.lit(0)), F.lit(size.blocks))


def _slots(sha: str, size: Size) -> list[Column]:
    """The bits of a key, numbered through all blocks; both lie in the key's block."""
    return [_block(sha, size) * size.bits + F.pmod(F.xxhash64(sha, F.lit(seed)), F.lit(size.bits)) for seed in (1, 2)]


def repeat_filter(digests: DataFrame, size: Size) -> DataFrame:
    """Bitmaps ``(bitmap, bits)`` of the slots that two rows or more fall into."""
    crowded = (
        digests.select(F.explode(F.array(*_slots("text_sha256", size))).alias("slot"))
        .groupBy("slot")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    return _bitmaps(crowded)


def member_filter(keys: DataFrame, column: str, size: Size) -> DataFrame:
    """Bitmaps ``(bitmap, bits)`` of all slots of the keys: a plain Bloom filter."""
    return _bitmaps(keys.select(F.explode(F.array(*_slots(column, size))).alias("slot")))


def _bitmaps(slots: DataFrame) -> DataFrame:
    return slots.groupBy(F.expr(f"slot div {BITMAP_BITS}").alias("bitmap")).agg(
        F.bitmap_construct_agg(F.col("slot") % BITMAP_BITS).alias("bits")
    )


def _bit(bits: str, position: Column) -> Column:
    byte = F.substring(F.col(bits), (F.floor(position / 8) + 1).cast("int"), F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    mask = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (position % 8 + 1).cast("int"))
    return F.coalesce(value.bitwiseAND(mask) != 0, F.lit(False))


def _probed(rows: DataFrame, filter_: DataFrame, size: Size, sha: str) -> DataFrame:
    """``rows`` with ``candidate``, by the bitmaps of one block, whose size is bounded."""
    out = rows
    for k, slot in enumerate(_slots(sha, size)):
        side = filter_.select(F.col("bitmap").alias(f"_bitmap{k}"), F.col("bits").alias(f"_bits{k}"))
        out = out.withColumn(f"_slot{k}", slot).join(F.broadcast(side), F.expr(f"_slot{k} div {BITMAP_BITS} = _bitmap{k}"), "left")
    found = [_bit(f"_bits{k}", F.col(f"_slot{k}") % BITMAP_BITS) for k in (0, 1)]
    return out.withColumn("candidate", found[0] & found[1]).drop(
        *[f"{x}{k}" for k in (0, 1) for x in ("_slot", "_bitmap", "_bits")]
    )


def possibly_repeated(rows: DataFrame, filter_: DataFrame, size: Size, sha: str = "text_sha256") -> DataFrame:
    """``rows`` with a boolean ``candidate``: both bits of the row are set in the filter.

    Of several blocks each is broadcast alone; its rows are written before the next one's turn.
    """
    if size.blocks == 1:
        return _probed(rows, filter_, size, sha)
    per_block, parts = size.bits // BITMAP_BITS, []
    dealt = "_block" in rows.columns
    for b in range(size.blocks):
        own = rows.where(F.col("_block") == b).drop("_block") if dealt else rows.where(_block(sha, size) == b)
        parts.append(durable(_probed(own, filter_.where(F.col("bitmap").between(b * per_block, (b + 1) * per_block - 1)), size, sha)))
    return reduce(DataFrame.unionByName, parts)


def dealt_by_block(rows: DataFrame, size: Size, sha: str = "text_sha256") -> DataFrame:
    """Slim rows in one folder a block, so that a block's turn reads its own rows only."""
    if size.blocks == 1:
        return rows
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * size.blocks)
    dealt = rows.withColumn("_block", _block(sha, size).cast("int"))
    return durable(dealt.repartition(tasks, "_block", F.pmod(F.xxhash64(sha, F.lit(3)), F.lit(8))), ["_block"])


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(normalised(text_col), 256).alias("text_sha256"),
        F.length(text_or_empty(text_col)).cast("long").alias("n_points"),
    )


def _repeat_groups(candidates: DataFrame) -> DataFrame:
    """One row per text that really repeats: its size, the row that stays, and that row's ties.

    Two partial aggregations come before any row of a large group meets another.
    """
    return (
        candidates.groupBy("text_sha256", "n_points", "doc_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("uid"))
        .groupBy("text_sha256")
        .agg(
            F.sum("n").alias("group_size"),
            F.min(F.struct(-F.col("n_points"), F.col("doc_id").isNull(), "doc_id", "uid", "n", "n_points")).alias("first"),
        )
        .where("group_size > 1")
        .select(
            "text_sha256",
            "group_size",
            F.col("first.doc_id").alias("keep_id"),
            F.col("first.uid").alias("keep_uid"),
            F.col("first.n").alias("ties"),
            F.col("first.n_points").alias("keep_points"),
        )
    )


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    probed, groups = _prepare(docs, id_col, text_col)
    through = probed.where(~F.col("candidate")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    met = probed.where("candidate").join(groups, "text_sha256", "left")
    alone = F.col("group_size").isNull()
    shuffled = met.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("uid") == F.col("keep_uid"))).alias("kept"),
        "text_sha256",
    )
    return through.unionByName(shuffled)


def _prepare(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The slim digests with ``candidate``, and the groups of those that really repeat."""
    rows = durable(_digests(docs, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()))
    size = filter_size(rows.count())
    filter_ = durable(repeat_filter(rows, size))
    probed = possibly_repeated(dealt_by_block(rows, size), filter_, size)
    return probed, durable(_repeat_groups(probed.where("candidate")))


def split_known(rows: DataFrame, sha: str, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``sha`` is certainly not in ``keys``, and all others; no row shuffles.

    Beyond one block the rows are written once, a folder a block, and a block's turn reads its own alone.
    """
    size = filter_size(keys.count())
    if size.blocks > 1:
        rows = durable(rows.withColumn("_block", _block(sha, size).cast("int")), ["_block"])
    probed = possibly_repeated(rows, durable(member_filter(keys, column, size)), size, sha)
    return probed.where(~F.col("candidate")).drop("candidate"), probed.where("candidate").drop("candidate")


def only_known(rows: DataFrame, sha: str, keys: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``sha`` is in ``keys``, which has no key twice; none of the others shuffle but a few."""
    _, maybe = split_known(rows, sha, keys, column)
    return maybe.join(keys.select(F.col(column).alias(sha)), sha, "left_semi")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows whose text does not repeat never shuffle it.
    """
    _, groups = _prepare(docs, id_col, text_col)
    groups = groups.select(F.col("text_sha256").alias("_group"), "keep_id", "keep_points", "ties")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.sha2(normalised(text_col), 256).alias("_sha"),
        F.length(text_or_empty(text_col)).cast("long").alias("_points"),
        F.col(id_col).alias("_id"),
    )
    through, repeated = split_known(rows, "_sha", groups, "_group")
    met = repeated.join(groups, F.col("_sha") == F.col("_group"), "left")
    stays = F.col("_group").isNull() | ((F.col("_points") == F.col("keep_points")) & F.col("_id").eqNullSafe(F.col("keep_id")))
    met = met.where(stays)
    single = met.where(F.coalesce("ties", F.lit(1)) == 1).select("_row.*")
    tied = met.where("ties > 1").groupBy("_sha").agg(F.first("_row").alias("_row")).select("_row.*")
    return through.select("_row.*").unionByName(single).unionByName(tied)
