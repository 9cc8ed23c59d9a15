"""Tables in key buckets that change together: copy-on-write files under one manifest per version.

A version is one small JSON file that names, for every table and bucket, the folder with its rows.  A change writes
new folders for the buckets it touches, then publishes the next manifest by a rename that never overwrites:
readers see all of a change or nothing, and of two writers that started from one version only the first commits.
Nothing here holds rows on the driver; a manifest grows with the number of buckets.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from credence.session import run_dir

#: Buckets of a new table, and rows of a bucket, on average, beyond which a table gets twice as many.
BUCKETS = 16
ROWS_PER_BUCKET = 1_000_000
_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another change was committed since this one began."""


class TableSet:
    """Named tables below one folder on any file system that Spark reaches; each has a key that is unique and not null."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def new(cls, spark: SparkSession, name: str) -> TableSet:
        return cls(spark, run_dir(spark, name))

    # files

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list:
        fs, path = self._fs(), self._path(folder)
        return list(fs.listStatus(path)) if fs.exists(path) else []

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._names(f"{self.root}/manifest")]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """The content of a version, of the newest by default; an empty one before the first commit."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if version == 0:
            return {"version": 0, "tables": {}, "applied": {}}
        stream = self._fs().open(self._path(f"{self.root}/manifest/{version:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, content: dict) -> None:
        """Writes the manifest aside and renames it to its number; raises Conflict where that number is taken."""
        jvm, fs = self.spark._jvm, self._fs()
        aside, goal = (self._path(f"{self.root}/manifest/{n}") for n in (f".{uuid.uuid4().hex}", f"{content['version']:010d}.json"))
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        place = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            place.rename(aside, goal, no_options)
        except Py4JJavaError as error:
            fs.delete(aside, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise Conflict(f"version {content['version']} was committed by another change") from None
            raise

    # use

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return Change(self, self.manifest(version)).table(name)

    def begin(self) -> Change:
        """A change on top of the newest version."""
        return Change(self, self.manifest())

    def vacuum(self, keep: int = 2, older_than_s: int = 3600) -> int:
        """Removes manifests but the newest ``keep``, and the folders none of these names, if older than a change can last; returns their number."""
        fs, kept = self._fs(), self.versions()[-keep:]
        named = {"/".join(p.split("/")[:2]) for v in kept for t in self.manifest(v)["tables"].values() for p, _ in t["files"].values()}
        before = self.spark._jvm.java.lang.System.currentTimeMillis() - 1000 * older_than_s
        for version in self.versions()[:-keep]:
            fs.delete(self._path(f"{self.root}/manifest/{version:010d}.json"), False)
        gone = 0
        for table in self._names(self.root):
            if table.getPath().getName() == "manifest":
                continue
            for folder in self._names(table.getPath().toString()):
                if f"{table.getPath().getName()}/{folder.getPath().getName()}" not in named and folder.getModificationTime() < before:
                    gone += bool(fs.delete(folder.getPath(), True))
        return gone


class Change:
    """Reads of one version, and the new buckets of tables to be committed together."""

    def __init__(self, tables: TableSet, base: dict) -> None:
        self.tables, self.spark, self.base = tables, tables.spark, base
        self.state = json.loads(json.dumps(base))  # what the next version will be

    # reading

    def _bucket(self, name: str) -> Column:
        about = self.state["tables"][name]
        kind = StructType.fromJson(about["schema"])[about["key"]].dataType  # equal keys of another type hash otherwise
        return F.pmod(F.xxhash64(F.col(about["key"]).cast(kind)), F.lit(about["buckets"])).cast("int")

    def _rows(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        about = self.state["tables"][name]
        files = [p for b, (p, n) in about["files"].items() if n and (buckets is None or int(b) in buckets)]
        schema = StructType.fromJson(about["schema"])
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.tables.root}/{p}" for p in files])

    def table(self, name: str) -> DataFrame:
        """All rows, with the changes made here so far."""
        return self._rows(name)

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        """Rows of the given keys (one column, named as the table's key); only their buckets are read."""
        keys = keys.where(F.col(self.state["tables"][name]["key"]).isNotNull()).distinct()
        return self._rows(name, self._touched(name, keys)).join(keys, self.state["tables"][name]["key"], "left_semi")

    def _touched(self, name: str, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self._bucket(name).alias(_BUCKET)).distinct().collect()]

    def applied(self, stream: str) -> int:
        """Number of the last batch of a stream that is part of this version, -1 for none."""
        return self.base["applied"].get(stream, -1)

    # changing

    def _write(self, name: str, rows: DataFrame) -> dict[str, list]:
        """Rows as files of their buckets: {bucket: [folder, rows]}."""
        folder = f"{name}/{uuid.uuid4().hex[:16]}"
        path = f"{self.tables.root}/{folder}"
        rows.withColumn(_BUCKET, self._bucket(name)).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(path)
        if not any(s.getPath().getName().startswith(_BUCKET) for s in self.tables._names(path)):
            return {}
        counts = self.spark.read.parquet(path).groupBy(_BUCKET).count().collect()
        return {str(r[0]): [f"{folder}/{_BUCKET}={r[0]}", r[1]] for r in counts}

    def create(self, name: str, rows: DataFrame, key: str, buckets: int = BUCKETS) -> None:
        """A new table, or a new content of all its rows."""
        schema = json.loads(rows.schema.json())
        for field in schema["fields"]:
            field["nullable"] = True
        self.state["tables"][name] = {"key": key, "buckets": buckets, "schema": schema, "files": {}}
        self.state["tables"][name]["files"] = self._write(name, rows)
        self._grow(name)

    def _staged(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows written once: what touches them twice must see the same."""
        path = f"{self.tables.root}/{name}/{uuid.uuid4().hex[:16]}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Rows of a known key replace the old row, others are added; one row per key.  Buckets without any of the keys keep their files."""
        about = self.state["tables"][name]
        columns = [f.name for f in StructType.fromJson(about["schema"])]
        staged = self._staged(name, rows.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromJson(about["schema"])]))
        touched = self._touched(name, staged)
        old = self._rows(name, touched).join(staged.select(about["key"]), about["key"], "left_anti")
        self._replace(name, touched, old.select(columns).unionByName(staged))
        self._grow(name)

    def delete(self, name: str, keys: DataFrame) -> None:
        """Removes the rows of the given keys."""
        key = self.state["tables"][name]["key"]
        staged = self._staged(name, keys.select(key).distinct())
        touched = self._touched(name, staged)
        self._replace(name, touched, self._rows(name, touched).join(staged, key, "left_anti"))

    def _replace(self, name: str, touched: list[int], rows: DataFrame) -> None:
        about = self.state["tables"][name]
        written = self._write(name, rows) if touched else {}
        about["files"] = {b: f for b, f in about["files"].items() if int(b) not in touched} | written

    def _grow(self, name: str) -> None:
        """Doubles the buckets while they are too full, so that a key's bucket stays small however many keys there are."""
        about = self.state["tables"][name]
        total, buckets = sum(n for _, n in about["files"].values()), about["buckets"]
        while total > buckets * ROWS_PER_BUCKET:
            buckets *= 2
        if buckets > about["buckets"]:
            rows = self._rows(name)
            about["buckets"] = buckets
            about["files"] = self._write(name, rows)

    def commit(self, stream: str | None = None, batch: int | None = None) -> int:
        """Publishes all changes as the next version and returns its number; raises Conflict where another change came first.

        With a stream and batch, the version also says that this batch is part of it.
        """
        if stream is not None:
            self.state["applied"][stream] = batch
        self.state["version"] = self.base["version"] + 1
        self.tables._publish(self.state)
        return self.state["version"]
