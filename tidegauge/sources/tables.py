"""Reading and writing panels: CSV in either layout, Parquet, JDBC; a store of results."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_timestamp
from ..operators.models import Model, ModelSpec
from ..operators.panel import KEYS, finite, unpivot
from ..plans.kernel import State

STATE = "t int, z array<double>, v array<double>, loglik double, seen long, missing long"


def read_csv(spark: SparkSession, path: str, date_column: str | None = None) -> DataFrame:
    """A panel (period, series_id, value) from a CSV file, whose layout the header tells.

    Either the first column holds dates and each other column a series, or each row is a series
    and the other columns are dates. Cells that are no numbers are missing. The header is read on
    its own; the file is scanned once, without schema inference.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False)
    key = date_column or raw.columns[0]
    rest = [c for c in raw.columns if c != key]
    # a name that no series and no date has
    raw, key = raw.withColumnRenamed(key, "__key"), "__key"
    is_date = spark.createDataFrame([(c,) for c in rest], "name string").select(F.count_if(parse_timestamp("name").isNotNull()).alias("n")).first()["n"]
    if rest and is_date == len(rest):
        long = unpivot(raw, key, rest).select(parse_timestamp("series_id").cast("date").alias("period"), F.col(key).alias("series_id"), "value")
    else:
        long = unpivot(raw, key, rest).select(parse_timestamp(key).cast("date").alias("period"), "series_id", "value")
    return long.where(F.col("period").isNotNull()).select(*KEYS, finite(F.col("value").try_cast("double")).alias("value"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("period").cast("date").alias("period"), "series_id", finite("value").alias("value"))


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None) -> DataFrame:
    """A panel from a database table with the panel's columns; needs the database's driver."""
    rows = spark.read.jdbc(url, table, properties=properties or {})
    return rows.select(F.col("period").cast("date").alias("period"), "series_id", finite("value").alias("value"))


def in_memory(spark: SparkSession, rows: list[list[float | None]], series: list[str], start: str = "2000-01-01") -> DataFrame:
    """A monthly panel from rows of values, as they are."""
    cells = [(k, s, None if x is None or x != x else float(x)) for k, row in enumerate(rows) for s, x in zip(series, row, strict=True)]
    df = spark.createDataFrame(cells, "k int, series_id string, value double")
    return df.select(F.add_months(F.lit(start).cast("date"), F.col("k")).alias("period"), "series_id", "value")


def write(panel: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder a year: later readers of a range of dates read only its years."""
    panel.withColumn("year", F.year("period")).write.mode(mode).partitionBy("year").parquet(path)


class Database(Protocol):
    """Reads and writes panels by table name."""

    def read(self, table: str) -> DataFrame: ...
    def write(self, panel: DataFrame, table: str) -> None: ...


class JdbcDatabase:
    """A database by its JDBC address; Spark opens and closes the connections."""

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str] | None = None) -> None:
        self.spark, self.url, self.properties = spark, url, properties or {}

    def read(self, table: str) -> DataFrame:
        return read_jdbc(self.spark, self.url, table, self.properties)

    def write(self, panel: DataFrame, table: str) -> None:
        panel.select(*KEYS, "value").write.jdbc(self.url, table, mode="overwrite", properties=self.properties)


class ViewManager(Protocol):
    """Hands out views of a panel by date."""

    def get(self, view_date: str) -> DataFrame: ...
    def list(self) -> list[str]: ...
    def latest(self) -> DataFrame | None: ...


class ResultStore(Protocol):
    """Saves, loads and lists results."""

    def save(self, fits: DataFrame, spec: ModelSpec, note: str = "") -> str: ...
    def load(self, result_id: str) -> tuple[DataFrame, ModelSpec]: ...
    def list(self) -> list[dict]: ...


class ParquetStore:
    """Results as Parquet below a folder, with their specification as JSON beside them.

    Nothing is ever unpickled.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def save(self, fits: DataFrame, spec: ModelSpec, note: str = "") -> str:
        now = datetime.now(timezone.utc)
        result_id = f"result_{now:%Y%m%d_%H%M%S_%f}_{uuid.uuid4().hex[:6]}"
        fits.write.parquet(f"{self.folder}/fits/{result_id}")
        meta = {"result_id": result_id, "created": now.isoformat(), "note": note, "spec": spec.json()}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{self.folder}/meta/{result_id}")
        return result_id

    def list(self) -> list[dict]:
        """Newest first; empty if nothing was saved."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/meta")
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return []
        rows = self.spark.read.text(f"{self.folder}/meta/*").collect()
        return sorted((json.loads(r["value"]) for r in rows), key=lambda m: m["result_id"], reverse=True)

    def load(self, result_id: str) -> tuple[DataFrame, ModelSpec]:
        meta = json.loads(self.spark.read.text(f"{self.folder}/meta/{result_id}").first()["value"])
        return self.spark.read.parquet(f"{self.folder}/fits/{result_id}"), ModelSpec.from_json(meta["spec"])

    def save_state(self, result_id: str, state: State) -> None:
        """Where the result's filter stands, for views that go on from there; a later state takes its place."""
        row = (int(state.t), state.z.tolist(), state.v.ravel().tolist(), float(state.loglik), int(state.seen), int(state.missing))
        self.spark.createDataFrame([row], STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/states/{result_id}")

    def load_state(self, result_id: str) -> State:
        row = self.spark.read.schema(STATE).parquet(f"{self.folder}/states/{result_id}").first()
        z = np.array(row["z"])
        return State(row["t"], z, np.array(row["v"]).reshape(len(z), len(z)), row["loglik"], row["seen"], row["missing"])

    def model(self, result_id: str) -> Model:
        fits, spec = self.load(result_id)
        return Model.from_table(fits, spec)


class ViewCatalogue:
    """Views of a panel by date: made on first use, the newest first in the list."""

    def __init__(self, panel: DataFrame) -> None:
        self.panel = panel
        self._views: dict[str, DataFrame] = {}

    def get(self, view_date: str) -> DataFrame:
        from ..operators.vintage import view

        if view_date not in self._views:
            self._views[view_date] = view(self.panel, view_date)
        return self._views[view_date]

    def list(self) -> list[str]:
        return sorted(self._views, reverse=True)

    def latest(self) -> DataFrame | None:
        return self.get(self.list()[0]) if self._views else None
