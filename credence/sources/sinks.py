"""Sinks: logs of micro-batches, CSV and JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions.hotkeys import latest_per_key
from credence.session import run_dir


class BatchLog:
    """Results of micro-batches, one folder per batch number.

    A batch costs what it carries: nothing written before is touched.  A replayed batch overwrites
    its own folder, so it is not counted twice.  Stream progress is kept beside the data, because
    batch numbers only have a meaning together with it.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.progress = f"{self.root}/_progress"

    @classmethod
    def new(cls, spark: SparkSession, name: str) -> "BatchLog":
        return cls(spark, run_dir(spark, name))

    def add(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/batch={batch}")

    def read(self) -> DataFrame | None:
        """All rows with their batch number, None when there are none yet."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(target) or not any(s.getPath().getName().startswith("batch=") for s in fs.listStatus(target)):
            return None
        return self.spark.read.parquet(self.root)

    def latest(self, key: str) -> DataFrame:
        """The newest row of every key."""
        rows = self.read()
        return latest_per_key(rows, key, "batch").drop("batch")


def merge_into(rows: DataFrame, table: str, key: str) -> None:
    """Upsert into a catalog table whose format supports MERGE (not plain parquet)."""
    same = F.expr(f"{table}.{key} = new.{key}")
    rows.alias("new").mergeInto(table, same).whenMatched().updateAll().whenNotMatched().insertAll().merge()


def write_csv(rows: DataFrame, path: str, single_file: bool = False) -> None:
    """UTF-8 CSV with header; one file only for results known to be small."""
    out = rows.coalesce(1) if single_file else rows
    out.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def as_json(rows: DataFrame, *columns: str) -> DataFrame:
    """Chosen columns as one JSON text column named result."""
    return rows.withColumn("result", F.to_json(F.struct(*columns)))
