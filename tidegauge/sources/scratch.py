"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_known: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share, below ``spark.checkpoint.dir``; in local mode a temporary one will do.

    It goes when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if "local" not in _own:
            _own["local"] = tempfile.mkdtemp(prefix="tidegauge-panel-")
            atexit.register(shutil.rmtree, _own["local"], ignore_errors=True)
        base = _own["local"]
    path = f"{base.rstrip('/')}/panel-{spark.sparkContext.applicationId}"
    if path not in _known:
        _known.add(path)
        atexit.register(_gone, spark, path)
    return path


def _gone(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone at interpreter exit
        pass


def fresh(spark: SparkSession, name: str = "table") -> str:
    """A path below the folder that nothing else has or will have."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as Parquet files, read back: made once, and later plans start from them."""
    path = fresh(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
