"""Streams against their batch versions."""

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import scalar as S
from tidegauge.streaming import filters


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_stream_filter_is_the_batch_filter(spark, tmp_path):
    rows = [(s, t, float((t * 7 + len(s)) % 5) - 2) for s in ("a", "bb") for t in range(30) if t % 4 or s == "a"]
    whole = spark.createDataFrame(rows, "series_id string, t long, value double")
    for k, part in enumerate((whole.where("t < 10"), whole.where("t between 10 and 20"), whole.where("t > 20"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(filters.kalman_stream(stream), "filtered")
    got = {(r["series_id"], r["t"]): (r["z"], r["v"]) for r in spark.table("filtered").where("not late").collect()}
    grid = spark.createDataFrame([(s, t) for s in ("a", "bb") for t in range(30)], "series_id string, t long")
    arrays = S.as_arrays(grid.join(whole, ["series_id", "t"], "left"), "value")
    batch = {(r["series_id"], r["t"]): (r["z"], r["v"]) for r in S.filtered(arrays).collect()}
    assert len(got) == len(rows)
    for k, (z, v) in got.items():
        assert abs(z - batch[k][0]) < 1e-9 and abs(v - batch[k][1]) < 1e-9


def test_late_rows_are_marked(spark, tmp_path):
    schema = "series_id string, t long, value double"
    for t in (5, 3):
        spark.createDataFrame([("a", t, 1.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "late"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "late"))
    run(filters.kalman_stream(stream), "late_rows")
    rows = spark.table("late_rows").orderBy("t").collect()
    assert len(rows) == 2 and sum(r["late"] for r in rows) in (0, 1)


def test_epochs_and_missing_positions(spark, tmp_path):
    assert filters._advance((-1, 1.0, 1.0, 0.0), 2, None, 0.8, 0.1, 0.5)[1:3] == pytest.approx((0.8**3, 0.64 * (0.64 * 0.74 + 0.1) + 0.1))
    rows = [("a", 1_700_000_000, 1.0), ("a", None, 2.0), ("a", 1_700_000_001, None)]
    spark.createDataFrame(rows, "series_id string, t long, value double").coalesce(1).write.parquet(str(tmp_path / "epoch"))
    stream = spark.readStream.schema("series_id string, t long, value double").parquet(str(tmp_path / "epoch"))
    run(filters.kalman_stream(stream), "epochs")
    got = spark.table("epochs").collect()
    assert sorted((r["t"] is None, r["t"], r["late"]) for r in got) == [(False, 1_700_000_000, False), (False, 1_700_000_001, False), (True, None, True)]


def test_growing_panel(spark, tmp_path):
    rows = [(f"2024-01-{d:02d} 10:00:00", "x" if d % 2 else "y", float(d)) for d in range(1, 11)] * 2
    df = spark.createDataFrame(rows, "ts string, kind string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))
    run(filters.growing_panel(stream, "ts", "kind", "v"), "grown", "complete")
    got = {(str(r["period"]), r["series_id"]): r["value"] for r in spark.table("grown").collect()}
    assert got == {(f"2024-01-{d:02d}", "x" if d % 2 else "y"): 2.0 * d for d in range(1, 11)}
