"""Shared plumbing of the corpus operators: durable intermediate tables and text helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One folder a driver process, below the shared checkpoint folder.
_RUN = f"tidegauge-{uuid.uuid4().hex}"
_own_dirs: dict[str, str] = {}
_registered: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, read from ``spark.checkpoint.dir``.

    Only a session in local mode may go without the setting; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_dirs.setdefault("local", tempfile.mkdtemp(prefix="tidegauge-"))
    return f"{base.rstrip('/')}/{_RUN}"


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _cleanup(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone at interpreter exit
        pass


def durable(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back.

    The lineage ends at files that survive lost executors, each row is computed once, and
    later readers get column pruning. The files go when the driver ends.
    """
    spark = df.sparkSession
    top = shared_dir(spark)
    if top not in _registered:
        _registered.add(top)
        atexit.register(_cleanup, spark, top)
    path = f"{top}/{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_durable(df: DataFrame) -> None:
    """Delete the files of a table made by ``durable`` that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if _RUN in path:
            _remove(spark, path)


def text_or_empty(text: str | Column) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
