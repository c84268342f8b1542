"""A large component of small sets is dealt to many tasks, and loses no link by it."""

import random

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import simhash as s

from .test_similar_sets import brute_kept, kept


def test_blocks_of_small_and_large_sets(spark):
    def blocks(n, size):
        return s.component_blocks(spark.range(n).select(F.lit(1).alias("component"), F.lit(size).alias("size"))).first()["blocks"]

    assert blocks(s.BLOCK_SETS, 60) == 1 and blocks(5 * s.BLOCK_SETS, 60) == 5
    assert blocks(100 * s.BLOCK_SETS, 60) == s.BLOCKS
    assert blocks(2 * s.BLOCKS, s.BLOCK_HASHES) == 2 * s.BLOCKS


@pytest.mark.parametrize("sets,blocks", [(128, 16), (7, 4)])
def test_one_group_of_copies_in_blocks(spark, monkeypatch, sets, blocks):
    monkeypatch.setattr(s, "BLOCK_SETS", sets)
    monkeypatch.setattr(s, "BLOCKS", blocks)
    rnd = random.Random(5)
    base = [f"{rnd.getrandbits(48):x}" for _ in range(60)]
    # links run from step to step, so that ends of a chain are joined by others only
    rows, words = [], list(base)
    for k in range(40):
        if k % 3 == 0:
            words[rnd.randrange(60)] = f"{rnd.getrandbits(48):x}"
        rows.append((k, " ".join([*words, f"end{k}"])))
    rows += [(100 + k, " ".join(rnd.sample(base, 60))) for k in range(5)]
    assert kept(spark, rows) == brute_kept(rows) and len(brute_kept(rows)) < 30
