"""Record sources: JSON with a noisy prefix, text batches, metrics files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_records(rows: DataFrame, raw: str, schema: str) -> DataFrame:
    """Adds ``record`` (from the first brace on) and ``error`` for output that carries no record."""
    text = F.coalesce(F.col(raw), F.lit(""))
    start = F.locate("{", text)
    body = F.substr(text, start)
    parsed = F.from_json(body, f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    step = rows.withColumn("_parsed", F.when(start > 0, parsed))
    error = (
        F.when(F.trim(text) == "", "No output")
        .when(start == 0, "No JSON in output")
        .when(F.col("_parsed._broken").isNotNull(), "JSON parse failed")
    )
    record = F.when(error.isNull(), F.col("_parsed").dropFields("_broken"))
    return step.withColumns({"record": record, "error": error}).drop("_parsed")


def pack_texts(rows: DataFrame, group: str, pos: str, text: str, size: int = 64) -> DataFrame:
    """Texts of each group as JSON arrays of at most ``size`` places: (group, chunk, batch).

    Chunk c holds positions c * size to c * size + size - 1, so a group of any length is packed in bounded pieces
    that need not meet; a place without a text is null.  Positions count from 0 and are unique in a group.
    """
    place = F.pmod(F.col(pos), F.lit(size)).cast("int")
    chunks = rows.groupBy(group, F.floor(F.col(pos) / size).cast("long").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), F.col(text).alias("text")))).alias("_t"))
    held = F.map_from_entries("_t")
    filled = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys(held))), lambda i: F.element_at(held, i))
    return chunks.select(group, "chunk", F.to_json(filled).alias("batch"))


def text_batches(rows: DataFrame, column: str) -> DataFrame:
    """A JSON array of texts to one row per text with its position."""
    others = [c for c in rows.columns if c != column]
    return rows.select(*others, F.posexplode(F.from_json(F.col(column), "array<string>")).alias("pos", "text"))


def metrics_file(spark: SparkSession, path: str) -> DataFrame | None:
    """A metrics JSON document, None when it does not exist."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.option("multiLine", True).json(path)
