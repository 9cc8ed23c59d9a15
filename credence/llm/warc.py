"""WARC archives written and read by Spark; records are told from magic inside payloads by their chain of boundaries."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm.common import written

#: First line of a record, of either version of the format.
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
#: (payload bytes from, records of a file at most): large payloads go to files of fewer records, so that a file, which one
#: task reads whole, holds 128 MB of payload or a single record.
SIZES = ((0, 2048), (1 << 16, 32), (1 << 22, 1))
#: Bytes that are unpacked at a time.
BLOCK = 1 << 20
#: Payloads of at least so many bytes are stored once and revisited.
LEAST_REVISIT = 0
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexes: Column) -> Column:
    """Upper-case base32 of a hash given in hexadecimal digits, five of which make four letters."""

    def letters(i: Column) -> Column:
        v = F.conv(F.substring(hexes, 5 * i + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(_BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), letters), "")


def write_archives(pages: DataFrame, path: str, least_revisit: int = LEAST_REVISIT, records_per_file: int = SIZES[0][1]) -> None:
    """One record per page in gzip files below ``path``: the html as payload, or a revisit of an equal payload.

    Of pages with equal payloads of at least ``least_revisit`` bytes the one with the largest page_id holds the payload
    and the others name it.  Equal payloads meet in an aggregate of digests, and the html joins its result once; a
    digest that many pages share is a skewed join key, which adaptive execution splits.  Null html is an empty
    payload; a null url has no target line; line ends in a url are percent-coded; a null page_id has an empty
    number and holds its payload only among its like; rows with equal ids and payloads are all responses; an
    empty table leaves no record; other columns are not read.  Payloads are written by SIZES: equal ones are of one size.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    for (least, most), below in zip(SIZES, [*(size for size, _ in SIZES[1:]), None]):
        of_size = F.octet_length("html") >= least if below is None else F.octet_length("html").between(least, below - 1)
        _append(rows.where(of_size), path, least_revisit, min(most, records_per_file))


def _append(rows: DataFrame, path: str, least_revisit: int, records_per_file: int) -> None:
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    owners = rows.groupBy("sha1").agg(F.max("page_id").alias("owner"))
    joined = rows.join(owners, "sha1")
    long_enough = F.octet_length("html") >= least_revisit
    again = long_enough & F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("page_id"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    body = F.when(again, "").otherwise(F.col("html"))
    lines = [
        F.lit("WARC/1.0"), F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), name("page_id")),
        F.concat(F.lit("WARC-Target-URI: "), target), F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha1"))),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), name("owner"))), F.when(again, F.concat(F.lit("X-Payload-Length: "), F.octet_length("html").cast("string"))),
        F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), body)
    writer = joined.select(record.alias("value")).write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip")
    writer.option("maxRecordsPerFile", records_per_file).text(path)


def unpacked(content: bytes) -> tuple[bytes, bool]:
    """All gzip members of a file one after another, or its bytes if it is not packed; and whether it is sound to its end.

    Of a file that is cut off or damaged, what was unpacked before that place remains.
    """
    if content[:2] != b"\x1f\x8b":
        return content, True
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as members:
        try:
            while block := members.read1(BLOCK):
                out.write(block)
        except (EOFError, gzip.BadGzipFile, zlib.error):
            return out.getvalue(), False
    return out.getvalue(), True


def parse(data: bytes, at: int) -> tuple[int, dict[str, str], int] | None:
    """(start of the block, headers, offset after the record) of the record that seems to start at ``at``; None if it can not be one."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    headers = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    after = end + 4 + int(length)
    if data[after : after + 4] != b"\r\n\r\n":
        return None
    return end + 4, headers, after + 4


def reachable(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches, by pointer jumping: twice as far in each round."""
    order = np.argsort(offsets)
    at, to = offsets[order], successors[order]
    n = len(at)
    place = np.searchsorted(at, to)
    known = (place < n) & (at[np.minimum(place, n - 1)] == to)
    jump = np.append(np.where(known, place, n), n)
    seen = np.zeros(n + 1, bool)
    seen[:1] = at[:1] == 0
    while True:
        ahead = jump[np.flatnonzero(seen)]
        fresh = not seen[ahead].all()
        seen[ahead] = True
        jump = jump[jump]
        if not fresh and (jump == n).all():
            break
    out = np.zeros(n, bool)
    out[order] = seen[:n]
    return out


#: A row without kind stands for a file: its length as ``at``, and whether it was unpacked to its end as ``next`` (1 or 0).
_CANDIDATE = "path string, at long, next long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place with the magic that parses as a record: its offset, its successor's, and the facts of the record there; and a row per file."""

    def number(name: str | None) -> int | None:
        digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits.lstrip("-").isdigit() else None

    def find(batches):
        for batch in batches:
            rows = []
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, sound = unpacked(content.as_py())
                rows.append((file, len(data), int(sound), None, None, None, None, None))
                for magic in MAGIC.finditer(data):
                    at = magic.start()
                    found = parse(data, at)
                    if found:
                        start, headers, after = found
                        block, kind = data[start : after - 4], headers.get("warc-type", "")
                        revisit = kind == "revisit"
                        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(block).digest()).decode()
                        length = headers.get("x-payload-length", "0") if revisit else str(len(block))
                        rows.append((file, at, after, number(headers.get("warc-record-id")), int(length) if length.isdigit() else 0, digest, kind, number(headers.get("warc-refers-to"))))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _CANDIDATE.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(~F.element_at(F.split("path", "/"), -1).rlike(r"^[._]")).select("path", "content").mapInArrow(find, _CANDIDATE)


def on_chains(found: DataFrame) -> DataFrame:
    """(path, at) of the candidates that the chain from the start of their file reaches."""

    def chain(table: pa.Table) -> pa.Table:
        keep = reachable(np.asarray(table["at"]), np.asarray(table["next"]))
        return table.filter(pa.array(keep)).select(["path", "at"])

    return found.where("record_type is not null").select("path", "at", "next").groupBy("path").applyInArrow(chain, "path string, at long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records of all archives below ``path``.

    Tasks emit candidates with their successors; per archive, which the writer bounds, pointer jumping from its
    start over (offset, successor) alone keeps the candidates on the chain, so magic and whole forged records
    inside payloads are left out.  Digest and length of a response are of the payload read, those of a revisit its headers'.
    Files may be plain, or gzip of one member or of many.  Where a chain breaks, its records up to there are
    returned; ``chain_report`` tells which files those are.  Empty folders give no rows.
    """
    found = written(candidates(spark, path), "candidates")
    kept = found.join(on_chains(found), ["path", "at"], "left_semi").where("record_type is not null")
    return kept.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def chain_report(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_bytes, n_candidates, n_records, read_to, whole) per archive.

    ``read_to`` is the offset behind the last record on the chain; ``whole`` says that this is the end of the file and that the
    file could be unpacked to its end.  A file without any record was read to 0.
    """
    found = written(candidates(spark, path), "candidates")
    files = found.where("record_type is null").select("path", F.col("at").alias("n_bytes"), (F.col("next") == 1).alias("sound"))
    reached = on_chains(found).withColumn("reached", F.lit(True))
    records = found.where("record_type is not null").join(reached, ["path", "at"], "left")
    counts = records.groupBy("path").agg(F.count("at").alias("n_candidates"), F.count("reached").alias("n_records"), F.max(F.when(F.col("reached"), F.col("next"))).alias("read_to"))
    out = files.join(counts, "path", "left").na.fill(0, ["n_candidates", "n_records", "read_to"])
    return out.select("path", "n_bytes", "n_candidates", "n_records", "read_to", (F.col("sound") & (F.col("read_to") == F.col("n_bytes"))).alias("whole"))
