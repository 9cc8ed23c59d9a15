"""Helpers shared by the operators: whole-batch word hashing, written intermediate tables, components, exact cuts.

Words are the maximal runs of bytes other than space and tab to carriage return.  They are found and
hashed for a whole Arrow column at once, straight on its UTF-8 buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.session import cut_lineage, run_dir

#: Bytes of text that are hashed at once; bounds the temporary arrays of a task (one longer text is taken alone).
SLICE_BYTES = 1 << 21

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_CODES = np.random.RandomState(20240229).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_CODES_LOWER = _CODES.copy()
_CODES_LOWER[ord("A") : ord("Z") + 1] = _CODES[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` bytes; a longer text stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def words(offsets: np.ndarray, data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a run of texts, and the number of words of each text; A-Z folded if ``lower``."""
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    power, inverse = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_CODES_LOWER if lower else _CODES)[data] * power[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    return hashes, np.diff(np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n``-word windows within each text, and their number per text.

    A text of 1 to n-1 words has one window, of all its words; a text without a word has none.
    """
    if n == 1:
        return hashes, counts
    total = len(hashes)
    factor = np.random.RandomState(n).randint(1, 2**62, n, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    padded = np.concatenate([hashes, np.zeros(n - 1, np.uint64)])
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(total)  # words from here to the end of the text
    full = left >= n
    short = (counts > 0) & (counts < n)
    keep = full.copy()
    keep[(ends - counts)[short]] = True
    at = np.flatnonzero(keep)
    sums = np.zeros(len(at), np.uint64)
    for j in range(n):
        sums += np.where(left[at] > j, padded[at + j] * factor[j], np.uint64(0))
    return mix(sums), np.where(short, 1, np.maximum(counts - n + 1, 0))


def text_words(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, words per row) over bounded slices of a column."""
    offsets, data = text_buffer(column)
    for start, end in slices(offsets):
        yield (start, end, *words(offsets[start : end + 1], data, lower))


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and bytes of text, to size partitions by."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the lowest id that can be reached from each end of an edge.

    Every round takes the lowest label among the neighbours (a partial minimum, so a node with many
    neighbours is no single group) and then the label's own label, which halves the remaining depth.
    Skewed labels meet only in inner joins, which adaptive execution splits.
    """
    pairs = cut_lineage(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v"))
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = cut_lineage(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("component")))
    while True:
        near = both.join(labels, F.col("v") == F.col("id")).groupBy("u").agg(F.min("component").alias("near"))
        met = labels.join(near, F.col("id") == F.col("u")).select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        own = labels.select(F.col("id").alias("at"), F.col("component").alias("jump"))
        new = cut_lineage(met.join(own, F.col("component") == F.col("at")).select("id", "was", F.least("component", "jump").alias("component")))
        labels = new.select("id", "component")
        if not new.where("component < was").limit(1).count():
            return labels


def mark_greatest(rows: DataFrame, score: Column, k: int, tie: Column, name: str, bits: int = 12) -> DataFrame:
    """Rows with a boolean ``name``: whether a row is among the k greatest scores, ties by the lowest ``tie``.

    No global sort: the k-th (score, tie) is found by counting digits of an order-preserving integer of
    the score, and then of the tie, ``bits`` at a time, so each step brings at most 2**bits counts to the
    driver.  Scores that agree to 2**-20 are ties.  Rows equal in both are all taken or all left.
    """
    keyed = rows.withColumn("_key", F.round(F.least(F.greatest(score, F.lit(-4.0e12)), F.lit(4.0e12)) * F.lit(float(1 << 20))).cast("long"))
    keyed = keyed.withColumn("_tie", F.bitwise_not(tie.cast("long")))
    if k <= 0:
        return keyed.withColumn(name, F.lit(False)).drop("_key", "_tie")
    need, found, left = k, [], keyed
    for column in ("_key", "_tie"):
        ordered = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))  # read as unsigned it has the order of the signed value
        value, done = 0, 0
        while done < 64:
            step = min(bits, 64 - done)
            digit = F.shiftrightunsigned(ordered, 64 - done - step).bitwiseAND(F.lit((1 << step) - 1))
            counts = left.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
            for d, n in sorted(((r["d"], r["n"]) for r in counts), reverse=True):
                if need <= n:
                    break
                need -= n
            else:
                return keyed.withColumn(name, F.lit(True)).drop("_key", "_tie")  # k rows at most
            left = left.where(digit == F.lit(d))
            value, done = value << step | d, done + step
        value ^= 1 << 63
        found.append(value - (1 << 64) if value >= 1 << 63 else value)
    taken = (F.col("_key") > F.lit(found[0])) | ((F.col("_key") == F.lit(found[0])) & (F.col("_tie") >= F.lit(found[1])))
    return keyed.withColumn(name, taken).drop("_key", "_tie")
