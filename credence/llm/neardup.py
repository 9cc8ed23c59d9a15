"""Near-duplicates: improved consistent weighted sampling of IDF-weighted shingles, bands, weighted Jaccard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import components, grams, mix, text_words, written
from credence.session import cut_lineage

#: Words in a shingle, and the similarity (Jaccard index of the shingle sets) from which two texts are near-duplicates.
WORDS, SIMILARITY = 5, 0.8
#: Samples per text: bands of rows.  A pair at the weighted cut of 0.75 meets in a band with probability 0.9989, one at 0.8 with 0.9999.
BANDS, ROWS = 18, 4
#: A shingle in this share of the documents or less counts as fully rare; only commoner ones need their count.
COMMON_SHARE = 0.001
#: Least inverse document frequency, as a share of that of a rare shingle.
LEAST_IDF = 0.75
#: Variates of the sampling: rows of a table shared by all shingles.
_TABLE = 1 << 16
#: Cells, in words of 64, that the shingles of a text are hashed to for a bound of what two texts share.
CELL_WORDS = 64


def weighted_cut(similarity: float, least_idf: float = LEAST_IDF) -> float:
    """The weighted similarity that no pair of that plain similarity falls below when a shingle weighs the same in both, in [least_idf, 1]."""
    return least_idf * similarity / (least_idf * similarity + 1 - similarity)


def _unique(shingles: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, their counts, and how many each text has."""
    rows = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((shingles, rows))
    s, r = shingles[order], rows[order]
    if not len(s):
        return s, np.zeros(0, np.int64), np.zeros(len(counts), np.int64)
    first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (r[1:] != r[:-1])]))
    return s[first], np.diff(np.append(first, len(s))), np.bincount(r[first], minlength=len(counts))


def _frequencies(docs: DataFrame, n: int, least: int, words: int, only: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that occur in at least ``least`` documents, ascending, and in how many.

    ``only``: hashes of single words that all words of a counted shingle must be among.  A frequent
    shingle has frequent words only, so this loses none and leaves most shingles out of the shuffle.
    What comes back is bounded by the mean number of words a document times n / least.
    """
    shared = docs.sparkSession.sparkContext.broadcast(only)

    def count(batches):
        held, size = [], 0

        def out():
            values, numbers = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(numbers.astype(np.int64))], names=["hash", "n"])

        for batch in batches:
            for _, _, hashes, counts in text_words(batch.column(0)):
                if words > 1:
                    common = shared.value
                    frequent = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes if len(common) else np.zeros(len(hashes), bool)
                    runs = np.concatenate([[0], np.cumsum(frequent)])
                    shingles, per_text = grams(hashes, counts, words)
                    starts = np.repeat(np.cumsum(counts) - counts, per_text) + np.arange(len(shingles)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
                    span = np.minimum(np.repeat(counts, per_text), words)
                    keep = runs[starts + span] - runs[starts] == span
                    rows = np.repeat(np.arange(len(counts)), per_text)[keep]
                    hashes, counts = shingles[keep], np.bincount(rows, minlength=len(counts))
                held.append(_unique(hashes, counts)[0])
                size += len(held[-1])
                if size > 2_000_000:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "hash long, n long")
    found = rows.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    values = np.asarray(found["hash"].combine_chunks()).view(np.uint64) if found.num_rows else np.zeros(0, np.uint64)
    numbers = np.asarray(found["n"].combine_chunks()) if found.num_rows else np.zeros(0, np.int64)
    order = np.argsort(values)
    return values[order], numbers[order]


class Weights:
    """Weight of a shingle in any text that has it: its idf, 1 for a rare one and less the more documents have it, at least ``least``.

    How often a text repeats it does not count (tf is bounded to 1), as weighted_cut holds only where a shingle weighs the same in
    both texts and lies in [least, 1].
    """

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray, n: int, share: float = COMMON_SHARE, least: float = LEAST_IDF) -> None:
        self.hashes = hashes
        rarity = np.log(max(n, 1) / np.maximum(numbers, 1)) / np.log(1 / share)
        self.idf = least + (1 - least) * np.clip(rarity, 0, 1)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        weight = np.ones(len(shingles))
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, shingles), len(self.hashes) - 1)
            weight = np.where(self.hashes[at] == shingles, self.idf[at], 1.0)
        return weight


def learn_weights(docs: DataFrame, words: int = WORDS) -> Weights:
    """Document frequencies over all documents, held only for shingles in more than COMMON_SHARE of them."""
    n = docs.count()
    least = max(2, int(np.ceil(n * COMMON_SHARE)))
    common, _ = _frequencies(docs, n, least, 1, None)
    return Weights(*_frequencies(docs, n, least, words, common), n)


def _variates() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.RandomState(5)
    r, c, beta = rng.gamma(2, 1, _TABLE), rng.gamma(2, 1, _TABLE), rng.uniform(0, 1, _TABLE)
    return r.astype(np.float32), np.log(c).astype(np.float32), beta.astype(np.float32)


def sample(shingles: np.ndarray, weights: np.ndarray, per_text: np.ndarray, samples: int, table=None) -> np.ndarray:
    """Improved consistent weighted samples, texts x samples: two texts agree with the probability of their weighted Jaccard index.

    Per (shingle, sample) there are r, c ~ Gamma(2, 1) and beta ~ U(0, 1), here from a shared table at a
    place hashed from both; t = floor(ln w / r + beta), ln a = ln c - r (t - beta) - r; the shingle with the
    least ln a is sampled together with its t.  Every text must have a shingle; ties fall to the first,
    that is the lowest, shingle.
    """
    r_of, c_of, beta_of = table or _variates()
    starts = np.cumsum(per_text) - per_text
    log_w = np.log(weights).astype(np.float32)
    place, step = (shingles & np.uint64(_TABLE - 1)).astype(np.int64), ((shingles >> np.uint64(20)) & np.uint64(_TABLE - 1)).astype(np.int64) | 1
    out = np.empty((len(per_text), samples), np.uint64)
    for k in range(samples):
        place = (place + step) & (_TABLE - 1)
        r, beta = r_of[place], beta_of[place]
        t = np.floor(log_w / r + beta)
        a = c_of[place] - r * (t - beta) - r
        least = np.minimum.reduceat(a, starts)
        hit = np.flatnonzero(a == np.repeat(least, per_text))
        text = np.searchsorted(starts, hit, "right") - 1
        first = hit[np.concatenate([[True], text[1:] != text[:-1]])]
        out[:, k] = mix(shingles[first] + (t[first].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(k))
    return out


def signatures(docs: DataFrame, weights: Weights, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key1, key2, size, b0, b1, ...): two hashes of the word sequence, the distinct shingles, and one hash per band; texts without a word are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = ["doc_id", "key1", "key2", "size", *(f"b{i}" for i in range(bands))]

    def sign(batches):
        weigh, table = shared.value, _variates()
        for batch in batches:
            for start, end, hashes, counts in text_words(batch.column(1)):
                some = np.flatnonzero(counts)
                if not len(some):
                    continue
                counts_some = counts[some]
                begin = np.cumsum(counts_some) - counts_some
                nth = (np.arange(len(hashes)) - np.repeat(begin, counts_some)).astype(np.uint64)
                keys = [np.add.reduceat(mix(hashes + mix(nth + np.uint64(seed))), begin) for seed in (11, 1 << 40)]
                shingles, _, per_text = _unique(*grams(hashes, counts_some, words))
                drawn = sample(shingles, weigh(shingles), per_text, bands * rows, table)
                columns = [batch.column(0).take(pa.array(start + some)), *(pa.array(k.view(np.int64)) for k in keys), pa.array(per_text.astype(np.int64))]
                for i in range(bands):
                    band = np.zeros(len(some), np.uint64)
                    for j in range(rows):
                        band = mix(band * np.uint64(31) + drawn[:, i * rows + j])
                    columns.append(pa.array(band.view(np.int64)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows_in = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    return rows_in.mapInArrow(sign, ", ".join(f"{n} long" for n in names))


def _sets(column: pa.Array, weigh: Weights, words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of each text, ascending, and their weights."""
    out = []
    for _, _, hashes, counts in text_words(column):
        shingles, _, per_text = _unique(*grams(hashes, counts, words))
        ends = np.cumsum(per_text)
        weights = weigh(shingles)
        out += [(shingles[e - n : e], weights[e - n : e]) for e, n in zip(ends, per_text)]
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Weighted and plain Jaccard index of two weighted shingle sets."""
    if not len(a[0]) or not len(b[0]):
        return 0.0, 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    i = np.flatnonzero(b[0][at] == a[0])
    common = np.minimum(a[1][i], b[1][at[i]]).sum()
    return common / (a[1].sum() + b[1].sum() - common), len(i) / (len(a[0]) + len(b[0]) - len(i))


def verify(pairs: DataFrame, texts: DataFrame, weights: Weights, words: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts reach the weighted cut and then the plain similarity, with both.

    Two inner joins bring the texts; a document in many pairs is a skewed key there, which adaptive
    execution splits.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(weights)
    cut = weighted_cut(least)

    def check(batches):
        weigh = shared.value
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _sets(part.column(2), weigh, words), _sets(part.column(3), weigh, words))
                for a, b, set_a, set_b in found:
                    weighted, plain = similarity(set_a, set_b)
                    if weighted >= cut - 1e-9 and plain >= least - 1e-9:
                        out.append((a, b, weighted, plain))
            columns = list(zip(*out)) if out else [[], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["a", "b", "weighted", "plain"])

    first = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = first.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long, weighted double, plain double")


def lone_shingles(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, lone): how many shingles of a text are in no other of the texts; ids without any are left out."""

    def emit(batches):
        for batch in batches:
            for start, _, hashes, counts in text_words(batch.column(1)):
                shingles, _, per_text = _unique(*grams(hashes, counts, words))
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(per_text)) + start, per_text)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(shingles.view(np.int64))], names=["id", "hash"])

    rows = texts.select("doc_id", "text").mapInArrow(emit, "id long, hash long")
    alone = rows.groupBy("hash").agg(F.min("id").alias("id"), F.max("id").alias("last")).where("id = last")
    return alone.groupBy("id").agg(F.count(F.lit(1)).alias("lone"))


def cells(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, cells): a bitmap of the cells that the shingles of a text fall in; ids with different texts are left out."""

    def emit(batches):
        for batch in batches:
            for start, end, hashes, counts in text_words(batch.column(1)):
                shingles, _, per_text = _unique(*grams(hashes, counts, words))
                at = (mix(shingles) % np.uint64(64 * CELL_WORDS)).astype(np.int64)
                bits = np.zeros((end - start, 64 * CELL_WORDS), np.uint8)
                bits[np.repeat(np.arange(end - start), per_text), at] = 1
                held = np.packbits(bits, axis=1).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(end - start + 1, dtype=np.int32) * CELL_WORDS), pa.array(held.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), lists], names=["id", "cells"])

    rows = texts.select("doc_id", "text").mapInArrow(emit, "id long, cells array<long>")
    return rows.groupBy("id").agg(F.min("cells").alias("cells"), F.max("cells").alias("last")).where("cells = last").drop("last")


def near_duplicates(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, exact_id, class_id, n_links): the class of every document, one row per doc_id.

    exact_id is the lowest id with the same word sequence, class_id the lowest id of the class; a class
    is what links between different texts connect, a link being a weighted similarity at the cut that
    no pair of plain similarity ``least`` falls below, and then that plain similarity itself.  n_links
    counts the links that were checked and hold for the document's text; within a class already joined
    no further pairs are formed.

    Copies are first brought together by two hashes of the word sequence, so only one of each goes on.
    Documents with the same samples in a band are then compared with one of them, the one with the least
    share of shingles of its own.  Fellows of a band that are in different classes after that are compared
    with each other where the similarity can be reached at all: two texts of x and y distinct shingles, at
    most m of which either shares with anyone in a crowded band, have a similarity of at most m / (x + y - m);
    m falls further by the cells of hashed shingles that only one of the two fills.  So no pair of different classes that meets in a band is lost, and no group is spelt out in pairs.

    Null, empty and blank texts have no shingle and are classes of their own; rows without doc_id are left
    out; a repeated doc_id counts once, with all its texts in its class; an empty table gives no rows; other
    columns are not read.
    """
    weights = learn_weights(docs, words)
    signed = written(signatures(docs, weights, words), "signatures")
    band_names = [f"b{i}" for i in range(BANDS)]
    firsts = signed.groupBy("key1", "key2").agg(F.min("doc_id").alias("exact_id"), *[F.min(b).alias(b) for b in ("size", *band_names)])
    firsts = cut_lineage(firsts)
    stacked = ", ".join(f"{i}, {b}" for i, b in enumerate(band_names))
    banded = firsts.select(F.col("exact_id").alias("id"), "size", F.expr(f"stack({BANDS}, {stacked}) as (band, hash)"))
    full = banded.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut_lineage(banded.join(full, ["band", "hash"]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = written(texts.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), "candidates")

    crowd = members.where("n > 2")
    lone = lone_shingles(texts.join(crowd.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), words)
    apart = firsts.groupBy(F.col("exact_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    lone = lone.join(apart, "id", "left_anti")  # the counts of an id with different texts bound none of them
    can = F.col("lone") <= F.lit(1 - least) * F.col("size") + F.lit(1e-9)  # else no fellow can be near enough
    crowd = cut_lineage(crowd.join(lone, "id", "left").withColumn("lone", F.coalesce("lone", F.lit(0))).where(can).drop("n"))

    # the two of a band of two, and everyone with the centre of a crowded band
    twos = members.where("n = 2").groupBy("band", "hash").agg(F.min("id").alias("a"), F.max("id").alias("b")).select("a", "b")
    own = F.col("lone") / F.col("size") + F.pmod(F.xxhash64("id"), F.lit(1 << 20)) * F.lit(1e-12)
    centres = crowd.groupBy("band", "hash").agg(F.min_by("id", own).alias("a"))
    stars = crowd.join(centres, ["band", "hash"]).where("id <> a").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))
    first = cut_lineage(twos.unionByName(stars).distinct())
    links = cut_lineage(verify(first, texts, weights, words, least).select("a", "b").distinct())
    joined = components(links)

    placed = crowd.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("band", "hash").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band", "hash")
    all_bands = firsts.select(F.col("exact_id").alias("id"), F.array(*band_names).alias("bands"))
    open_ = placed.join(mixed, ["band", "hash"]).withColumn("shared", F.col("size") - F.col("lone"))
    filled = cells(texts.join(open_.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), words)
    rest = cut_lineage(open_.join(all_bands, "id").join(filled, "id", "left"))
    other = rest.select(*[F.col(c).alias(f"{c}_b") for c in ("band", "hash", "id", "size", "shared", "component", "bands", "cells")])
    reach = lambda m: m >= F.lit(least) * (F.col("size") + F.col("size_b") - m) - F.lit(1e-9)
    alone = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda n, k: n + k)
    within = F.least(F.col("size") - alone("cells", "cells_b"), F.col("size_b") - alone("cells_b", "cells"))
    near = reach(F.least("shared", "shared_b")) & F.coalesce(reach(within), F.lit(True))
    once = F.array_position(F.zip_with("bands", "bands_b", lambda x, y: x == y), F.lit(True)) == F.col("band") + 1  # in the first band that both share
    same = (F.col("band") == F.col("band_b")) & (F.col("hash") == F.col("hash_b"))
    cross = rest.join(other, same & (F.col("id") < F.col("id_b")) & (F.col("component") != F.col("component_b")) & once & near)
    second = cut_lineage(cross.select(F.col("id").alias("a"), F.col("id_b").alias("b")).distinct().join(first, ["a", "b"], "left_anti"))
    more = cut_lineage(verify(second, texts, weights, words, least).select("a", "b").distinct())
    if more.limit(1).count():
        links = links.unionByName(more)
        joined = components(links)

    degree = links.select(F.col("a").alias("exact_id")).unionByName(links.select(F.col("b").alias("exact_id"))).groupBy("exact_id").agg(F.count(F.lit(1)).alias("n_links"))
    known = firsts.select("key1", "key2", "exact_id").join(joined.withColumnRenamed("id", "exact_id"), "exact_id", "left").join(degree, "exact_id", "left")
    classes = signed.select("doc_id", "key1", "key2").join(known, ["key1", "key2"]).groupBy("doc_id").agg(
        F.min("exact_id").alias("exact_id"), F.min(F.coalesce("component", "exact_id")).alias("class_id"), F.max(F.coalesce("n_links", F.lit(0))).alias("n_links"))
    blank = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().join(classes, "doc_id", "left_anti")
    return classes.unionByName(blank.select("doc_id", F.col("doc_id").alias("exact_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))
