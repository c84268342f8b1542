"""Contiguous balanced shards from global byte-size prefix sums.

Documents are put in id order by a range sort of slim rows (id, size, checksum; no text moves),
each sorted partition reports its total, prefix sums over the totals give every partition its
start, and a running sum inside the partition gives every document its global byte position.
The cuts lie at equal byte targets: a document goes to the shard that holds its middle byte,
so shards are contiguous and differ from the target by less than one document at either end.

The only rows that reach the driver are the partition totals, whose number is the partition
count chosen from the row count (``ROWS_PER_RANGE`` rows each), and one row per shard.

Defined cases: a null text has no bytes and size 1; ids that are null come first; rows with
equal ids are ordered by checksum, size and then input position, so a repeated id never has to
fit one partition; an empty table gives an empty result. Other columns are carried by
``write_shards`` only.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, text_or_empty

ROWS_PER_RANGE = 200_000


def assign_shards(
    docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 inside the shard), one row per row."""
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    slim = durable(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("uid"),
        )
    )
    order = ["doc_id", "text_crc32", "size", "uid"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-slim.count() // rows_per_range))
    ranged = durable(slim.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).orderBy("part").collect()
    total = sum(t["bytes"] for t in totals)
    starts = zip(
        [t["part"] for t in totals],
        accumulate((t["bytes"] for t in totals), initial=0),
        accumulate((t["rows"] for t in totals), initial=0),
        strict=False,
    )
    start = F.broadcast(spark.createDataFrame(list(starts), "part int, bytes_before long, rows_before long"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ranged.withColumn("bytes_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("rows_in", F.count(F.lit(1)).over(inside))
        .join(start, "part")
        .withColumn("row", F.col("rows_before") + F.col("rows_in"))
        .withColumn("middle", 2 * (F.col("bytes_before") + F.col("bytes_in")) + F.col("size"))
        .withColumn("shard", F.expr(f"cast(middle * {n_shards} div {2 * max(total, 1)} as int)"))
    )
    placed = durable(placed.select(*order, "shard", "row"))
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write whole rows below ``path/shard=K/`` in the assigned shards; returns the assignment."""
    placed = durable(assign_shards(docs, n_shards, id_col, text_col))
    key = ["_id", "_size", "_crc"]
    text = text_or_empty(text_col)
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
    )
    # rows that agree in all three lie next to each other: they share the first one's shard
    target = placed.groupBy(F.col("doc_id").alias("_id2"), F.col("size").alias("_size2"), F.col("text_crc32").alias("_crc2")).agg(F.min("shard").alias("_shard"))
    match = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_size") == F.col("_size2")) & (F.col("_crc") == F.col("_crc2"))
    rows = keyed.join(target, match).select("_row.*", F.col("_shard").alias("shard")).drop(*key)
    rows.write.partitionBy("shard").parquet(path)
    return placed
