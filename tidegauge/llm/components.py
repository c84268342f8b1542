"""Connected components of a table of links, by alternating large and small stars.

Each round links the larger neighbours of every node to its least neighbour (large star), then
the smaller ones (small star); the links shrink to one star a component. Every round is a
written table, and the least neighbours are one too, so a join on a hub's key has plain
exchanges on both sides and is split at run time if the hub is heavy. Nothing is collected
but a count and a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_durable, durable


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """One star step over links (a, b) with a > b."""
    if larger:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links
    least = durable(near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a")))
    met = near.join(least, "a")
    if larger:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node that has a link, and the least node it reaches."""
    now = durable(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    )
    state = _state(now)
    while state[0]:
        new = durable(_star(durable(_star(now, True)), False))
        before, state = state, _state(new)
        drop_durable(now)
        now = new
        if state == before:
            break
    own = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own.select("node", F.col("node").alias("component")))
