"""Image folders: readable and unreadable files, and writing pictures from tasks."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def image_folder(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png,bmp,webp}") -> DataFrame:
    """path, height, width, data of every image; unreadable files have width and height -1."""
    reader = spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", pattern)
    rows = reader.load(path)
    return rows.select(
        F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"),
    ).withColumn("readable", F.col("width") >= 0)


def png_bytes(height: int, width: int, bgr: bytes) -> bytes:
    """A plain RGB picture file."""
    rgb = np.frombuffer(bgr, dtype=np.uint8).reshape(height, width, 3)[:, :, ::-1]
    raw = b"".join(b"\x00" + rgb[y].tobytes() for y in range(height))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def write_pictures(images: DataFrame, key: str, folder: str) -> None:
    """One picture file per row, see :func:`write_files`."""
    encode = F.udf(lambda height, width, data: png_bytes(height, width, bytes(data)), "binary")
    write_files(images.select(key, encode("height", "width", "data").alias("content")), key, folder)


def write_files(rows: DataFrame, key: str, folder: str) -> None:
    """``content`` of every row as a file named by its key, written by the tasks.

    ``folder`` is a local path or the address of a file system that Arrow can open in the tasks.  A file is written under
    a hidden name and then renamed, so a lost task leaves no partial picture and a repeated one leaves one file.
    """
    address = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = fs.FileSystem.from_uri(address)
        files.create_dir(path, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                hidden = f"{path}/.{name}-{uuid.uuid4().hex}"
                with files.open_output_stream(hidden) as out:
                    out.write(content.as_buffer())
                files.move(hidden, f"{path}/{name}.png")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    named = rows.where(F.col(key).isNotNull() & F.col("content").isNotNull()).select(F.col(key).cast("string"), "content")
    named.mapInArrow(save, "n long").agg(F.sum("n")).collect()  # one number
