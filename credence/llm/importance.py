"""Importance resampling: a hashed n-gram model of target text against one of all text, drawn by Gumbel top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import mark_greatest, mix, text_words, written

#: Buckets of the hashed one- and two-word grams.
BUCKETS = 10_000
#: Labelled rows that the target model and the cut are fitted on, at most; taken in order of a hash of doc_id.
MOST_LABELLED = 20_000
#: Added to the count of every bucket.
SMOOTHING = 1.0


def _buckets(hashes: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all one- and two-word grams of a run of texts, and the row of each.

    A word followed by itself is one and the same gram for every word.
    """
    rows = np.repeat(np.arange(len(counts)), counts)
    if len(hashes) < 2:
        return (hashes % np.uint64(buckets)).astype(np.int64), rows
    two = mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    two[hashes[:-1] == hashes[1:]] = np.uint64(1)
    within = rows[:-1] == rows[1:]
    found = np.concatenate([hashes, two[within]])
    return (found % np.uint64(buckets)).astype(np.int64), np.concatenate([rows, rows[:-1][within]])


def gram_counts(docs: DataFrame, target: set[int] | np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Gram counts per bucket of all texts and of the target texts; sums of one vector per task."""
    wanted = np.sort(np.fromiter(target, np.int64, len(target)))

    def count(batches):
        raw, aim = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(-1))
            known = np.asarray(batch.column(0).is_valid())
            chosen = np.isin(ids, wanted) & known
            for start, end, hashes, counts in text_words(batch.column(1)):
                bucket, row = _buckets(hashes, counts, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                mine = chosen[start:end]
                if mine.any():
                    aim += np.bincount(bucket[mine[row]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(aim[at])], names=["bucket", "raw", "aim"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "bucket long, raw long, aim long")
    raw, aim = np.zeros(buckets), np.zeros(buckets)
    for r in rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("aim").alias("aim")).collect():  # at most ``buckets`` rows
        raw[r["bucket"]], aim[r["bucket"]] = r["raw"], r["aim"]
    return raw, aim


def log_ratios(raw: np.ndarray, aim: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Per bucket log p_target - log p_raw, both smoothed by adding ``smoothing`` to every bucket."""
    p = (aim + smoothing) / (aim.sum() + smoothing * len(aim))
    q = (raw + smoothing) / (raw.sum() + smoothing * len(raw))
    return np.log(p) - np.log(q)


def log_weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(doc_id, n_grams, log_weight): the log importance weight of every whole text; 0 for a text without words."""
    buckets = len(ratios)

    def weigh(batches):
        for batch in batches:
            total, number = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for start, end, hashes, counts in text_words(batch.column(1)):
                bucket, row = _buckets(hashes, counts, buckets)
                total[start:end] = np.bincount(row, ratios[bucket], minlength=end - start)
                number[start:end] = np.bincount(row, minlength=end - start)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number), pa.array(total)], names=["doc_id", "n_grams", "log_weight"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(weigh, "doc_id long, n_grams long, log_weight double")


def labelled_sample(labels: DataFrame, most: int = MOST_LABELLED) -> dict[int, bool]:
    """At most ``most`` labelled documents and whether all their labels call them good; order by a hash of the id."""
    rows = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    return {r["doc_id"]: r["quality"] == 1 for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()}


def best_cut(good: np.ndarray, bad: np.ndarray, care: float = 4.0) -> float:
    """The mean log ratio that parts good from bad best: ``care`` times the share of good kept plus that of bad dropped.

    Midway between two values; among equally good cuts the one with the widest gap counts.  Without bad rows nothing is rejected,
    without good rows there is no target and nothing is rejected either.
    """
    if not len(good) or not len(bad):
        return -np.inf
    values = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[values[0] - 1.0], (values[1:] + values[:-1]) / 2])
    gaps = np.concatenate([[0.0], np.diff(values)])
    g, b = np.sort(good), np.sort(bad)
    kept = 1 - np.searchsorted(g, cuts, "left") / len(g)
    dropped = np.searchsorted(b, cuts, "left") / len(b)
    balance = care * kept + dropped
    best = np.flatnonzero(balance >= balance.max() - 1e-12)
    return float(cuts[best[np.argmax(gaps[best])]])


def resample(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most_labelled: int = MOST_LABELLED, temperature: float = 1.0, seed: int = 7) -> DataFrame:
    """Every document with its log weights, its Gumbel key and whether the draw takes it.

    Target text is what the labels call good, raw text is every document.  ``log_weight`` is the sum of the log
    ratios of a text's grams, ``mean_weight`` that per gram.  Sums alone would draw by length, so every gram pays the
    cut that parts the labelled rows best: ``weight`` is log_weight less the cut for each gram, the log importance
    weight against raw text tilted by that much.  The key is ``weight`` over ``temperature`` plus Gumbel noise from a
    hash of doc_id; the k greatest keys are drawn without replacement, k being the number of documents whose weight
    is 0 or more.  Only documents some units from the cut are left to chance, short ones more than long ones.

    A text without words has weight 0, a null text is empty; repeated doc_ids are weighed each; ties in
    the key fall to the lowest doc_id; rows without doc_id are weighed with doc_id null and draw as 0.
    Other columns of ``docs`` are not read.  An empty table or one without usable labels keeps all rows.
    """
    sample = labelled_sample(labels, most_labelled)
    target = [k for k, good in sample.items() if good]
    raw, aim = gram_counts(docs, target, buckets)
    ratios = log_ratios(raw, aim) if target else np.zeros(buckets)
    mean = F.col("log_weight") / F.greatest(F.col("n_grams"), F.lit(1))
    rows = written(log_weights(docs, ratios).withColumn("mean_weight", mean), "importance")
    cut = best_cut(*_labelled_means(rows, sample))
    rows = rows.withColumn("weight", F.col("log_weight") - F.lit(cut if np.isfinite(cut) else 0.0) * F.col("n_grams"))
    k = rows.where("weight >= 0" if np.isfinite(cut) else F.lit(True)).count()
    uniform = (F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(seed)), F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float((1 << 52) - 1))
    keyed = rows.withColumn("gumbel_key", F.col("weight") / F.lit(temperature) - F.log(-F.log(uniform)))
    return mark_greatest(keyed, F.col("gumbel_key"), k, F.coalesce("doc_id", F.lit(0)), "kept")


def _labelled_means(rows: DataFrame, sample: dict[int, bool]) -> tuple[np.ndarray, np.ndarray]:
    """Mean weights of the labelled documents with words, good ones and bad ones; rows of one doc_id count as their mean."""
    if not sample:
        return np.empty(0), np.empty(0)
    known = rows.sparkSession.createDataFrame(list(sample.items()), "doc_id long, good boolean")
    seen = rows.where("n_grams > 0").join(F.broadcast(known), "doc_id").groupBy("doc_id", "good").agg(F.avg("mean_weight").alias("mean_weight")).collect()  # as many rows as the sample at most
    return tuple(np.array([r["mean_weight"] for r in seen if r["good"] == good]) for good in (True, False))
