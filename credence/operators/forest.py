"""A random forest whose trees are dealt to tasks, kept as Spark ML's own model.

Spark's trainer deals rows to tasks: every task has statistics for every open node of all trees, looks up every row in every tree
once per level, and few rows are one task.  Here features become bins of a byte, equal rows one row with a count, and these few
bytes per row go to every task, which grows some of the trees.  Trees are as many as Spark's, grown by the same rules (bootstrap of
all rows, features drawn per node, at most 32 bins, Gini impurity by class weight, leaves of one prediction joined), by other random
numbers.  What a row counts for in a tree depends on the row, the tree and the seed only, not on where the row is.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from credence.session import run_dir

BINS = 32
#: Rows of a task that are summarised at a time, and the values that a summary of a feature has at most.
SUMMED_ROWS, SUMMED_VALUES = 1 << 17, 1 << 14
#: Rows of a tree that are counted at a time.
COUNTED_ROWS = 1 << 19
_MODEL = "org.apache.spark.ml.classification"


# --- bins -----------------------------------------------------------------------------------------------------------------------


def summary(values: np.ndarray, weights: np.ndarray, most: int = SUMMED_VALUES) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their weights; of more than ``most``, those that end equal shares of the weight, with the weight up to them."""
    distinct, place = np.unique(values, return_inverse=True)
    weights = np.bincount(place.ravel(), weights, len(distinct))
    if len(distinct) <= most:
        return distinct, weights
    upto = np.cumsum(weights)
    ends = np.unique(np.append(np.searchsorted(upto, upto[-1] * np.arange(1, most) / most), len(distinct) - 1))
    return distinct[ends], np.diff(upto[ends], prepend=0.0)


def cuts_of(values: np.ndarray, weights: np.ndarray, bins: int = BINS) -> list[float]:
    """Cuts between bins by Spark's rule: between all values, or, if these are too many, where the weight is nearest to the next share of it."""
    if len(values) <= bins:
        return ((values[:-1] + values[1:]) / 2).tolist()
    share, cuts = weights.sum() / bins, []
    upto, want = np.cumsum(weights).tolist(), share
    for i in range(1, len(values)):
        if abs(upto[i - 1] - want) < abs(upto[i] - want):
            cuts.append(float(values[i - 1] + values[i]) / 2)
            want += share
    return cuts[: bins - 1]


def _columns(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of a batch, one per row."""
    found = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    if not np.isfinite(found).all():
        raise ValueError("a feature to learn from is NaN or infinite")
    return found


def _cuts(rows: DataFrame, width: int) -> list[list[float]]:
    """Cuts of every feature out of all rows: summaries per task meet per feature."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def found() -> pa.RecordBatch:
            x, w = (np.concatenate(c) for c in zip(*held))
            some = [summary(x[:, f], w) for f in range(width)]
            return pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([v for v, _ in some]), pa.array([n for _, n in some])], names=["feature", "value", "weight"])

        for batch in batches:
            held.append((_columns(batch, width), batch.column("weight").to_numpy()))
            size += batch.num_rows
            if size >= SUMMED_ROWS:
                yield found()
                held, size = [], 0
        if size:
            yield found()

    def cut(table: pa.Table) -> pa.Table:
        values, weights = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("value", "weight"))
        return pa.table({"feature": table.column("feature").slice(0, 1), "cuts": pa.array([cuts_of(*summary(values, weights, len(values)))], pa.list_(pa.float64()))})

    parts = rows.select("x", "weight").mapInArrow(summed, "feature int, value array<double>, weight array<double>")
    found = parts.groupBy("feature").applyInArrow(cut, "feature int, cuts array<double>").collect()  # one row per feature
    return [r.cuts for r in sorted(found)]


def _packed(rows: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """(rows, counts): the bins and the label of rows as bytes, equal ones once, many to a record."""
    width = len(cuts)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _columns(batch, width)
                bins = [np.searchsorted(cuts[f], x[:, f]) for f in range(width)]
                flat = np.stack([*bins, batch.column("label").to_numpy()], axis=1).astype(np.uint8)
                found, counts = np.unique(flat, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in found], pa.binary()), pa.array(counts, pa.int64())], names=["row", "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                counts = batch.column(1).to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(batch.column(0).to_pylist())]), pa.array([counts.tobytes()])], names=["rows", "counts"])

    once = rows.select("x", "label").mapInArrow(binned, "row binary, n long").groupBy("row").agg(F.sum("n").alias("n"))
    return once.mapInArrow(pack, "rows binary, counts binary")


# --- one tree ---------------------------------------------------------------------------------------------------------------------


def _mixed(n: np.ndarray) -> np.ndarray:
    """Whole numbers of 64 bits scattered over all of them."""
    n = (n ^ (n >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    n = (n ^ (n >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return n ^ (n >> np.uint64(31))


class Rows:
    """Distinct rows, ordered by how often they come, with what a tree draws from."""

    def __init__(self, packed: list[bytes], counts: list[bytes], width: int, seed: int) -> None:
        flat = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, width + 1)
        n = np.frombuffer(b"".join(counts), np.int64)
        order = np.argsort(n, kind="stable")
        flat, n = flat[order], n[order]
        self.width, self.bins, self.labels = width, np.ascontiguousarray(flat[:, :-1]).ravel(), np.ascontiguousarray(flat[:, -1])
        self.often, self.starts = np.unique(n, return_index=True)
        words = np.pad(flat, ((0, 0), (0, -(width + 1) % 8))).view(np.uint64)
        self.scattered = np.full(len(flat), seed % (1 << 64), np.uint64)
        for i in range(words.shape[1]):
            self.scattered = _mixed(self.scattered * np.uint64(0x9E3779B97F4A7C15) + words[:, i])
        self.shares: dict[int, np.ndarray] = {}

    def _upto(self, n: int) -> np.ndarray:
        """Probability that a row which comes ``n`` times is drawn at most 0, 1, 2... times."""
        if n not in self.shares:
            k = np.arange(int(n + 12 * sqrt(n) + 30))
            self.shares[n] = np.cumsum(np.exp(k * np.log(n) - n - np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])))
        return self.shares[n]

    def drawn(self, tree: int) -> np.ndarray:
        """How often a tree draws every row: each of its copies by a Poisson number of mean 1, so all of them by one of mean ``n``."""
        mark = _mixed(np.array([tree + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        chance = (_mixed(self.scattered ^ mark) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        ends = [*self.starts[1:].tolist(), len(chance)]
        return np.concatenate([np.searchsorted(self._upto(int(n)), chance[a:b], side="right") for n, a, b in zip(self.often, self.starts, ends)])


def _total(stats: np.ndarray) -> np.ndarray:
    """Over the classes (first axis), which are few."""
    return sum(stats[1:], stats[0])


def gini(stats: np.ndarray) -> np.ndarray:
    """Impurity by the weight of each class (first axis), 0 without weight."""
    total = _total(stats)
    return np.where(total > 0, 1 - _total(stats * stats) / np.where(total > 0, total * total, 1), 0.0)


def best_splits(counts: np.ndarray, of_class: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of counts (class, node, feature, bin): the place of the feature and the last bin that goes left, the gain, and the left counts (class, node).

    The gain is 0 where no split parts a node.
    """
    left = np.cumsum(counts, axis=3)
    whole, left = left[..., -1:], left[..., :-1]
    right, by_class = whole - left, of_class[:, None, None, None]
    low, high, both = left * by_class, right * by_class, whole * by_class
    shares = _total(low) * gini(low) + _total(high) * gini(high)
    gain = gini(both) - shares / np.maximum(_total(both), 1e-300)
    gain = np.where((_total(left) > 0) & (_total(right) > 0), gain, -1.0).reshape(counts.shape[1], -1)
    best, nodes = gain.argmax(axis=1), np.arange(counts.shape[1])
    place, bin_ = np.divmod(best, counts.shape[3] - 1)
    return place, bin_, np.maximum(gain[nodes, best], 0.0), left[:, nodes, place, bin_]


def _joined(nodes: dict[str, np.ndarray], levels: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Without splits whose sides are leaves of one prediction; nodes are numbered anew, children after their parent."""
    left, right, stays = nodes["left"], nodes["right"], np.ones(len(nodes["left"]), bool)
    for level in reversed(levels):
        inner = level[left[level] >= 0]
        a, b = left[inner], right[inner]
        alike = (left[a] < 0) & (left[b] < 0) & (nodes["prediction"][a] == nodes["prediction"][b])
        stays[a[alike]] = stays[b[alike]] = False
        left[inner[alike]] = right[inner[alike]] = nodes["feature"][inner[alike]] = -1
        nodes["gain"][inner[alike]] = -1.0
    number = np.cumsum(stays) - 1
    for side in ("left", "right"):
        nodes[side] = np.where(nodes[side] >= 0, number[nodes[side]], -1)
    return {"id": number[stays], **{n: c[stays] for n, c in nodes.items()}}


def grown(rows: Rows, tree: int, depth: int, seed: int, of_class: np.ndarray, bins: int) -> dict[str, np.ndarray]:
    """The nodes of one tree, a row each: id, prediction, impurity, stats, count, gain, left, right, feature, bin."""
    rng, width, classes = np.random.default_rng([seed % (1 << 64), tree]), rows.width, len(of_class)
    some = ceil(sqrt(width))
    times = rows.drawn(tree)
    at = np.flatnonzero(times)
    times, labels, node = times[at].astype(np.float64), rows.labels[at].astype(np.int64), np.zeros(len(at), np.int64)
    root, by_class = np.bincount(labels, times, classes)[:, None], of_class[:, None]
    found = [{"counts": root, "gain": np.full(1, -1.0), **{n: np.full(1, -1, np.int64) for n in ("left", "right", "feature", "bin")}}]
    levels, open_, size = [np.zeros(1, np.int64)], np.flatnonzero(gini(root * by_class) > 0), 1  # places in the last level
    for level in range(depth):
        if not len(open_):
            break
        features = rng.random((len(open_), width)).argsort(axis=1)[:, :some]
        cells = len(open_) * some * bins
        counts = np.zeros(classes * cells)
        for start in range(0, len(at), COUNTED_ROWS):
            part = slice(start, start + COUNTED_ROWS)
            here, first = node[part], at[part] * width
            for j in range(some):
                value = rows.bins[first + features[:, j][here]].astype(np.int64)
                counts += np.bincount(labels[part] * cells + (here * some + j) * bins + value, times[part], len(counts))
        place, last, gain, left = best_splits(counts.reshape(classes, len(open_), some, bins), of_class)
        above = found[-1]
        parts = np.flatnonzero(gain > 0)
        split = open_[parts]
        above["gain"][split], above["bin"][split] = gain[parts], last[parts]
        above["feature"][split] = features[parts, place[parts]]
        above["left"][split] = size + 2 * np.arange(len(parts))
        above["right"][split] = above["left"][split] + 1
        below = np.stack([left[:, parts], above["counts"][:, split] - left[:, parts]], axis=2).reshape(classes, -1)
        found.append({"counts": below, "gain": np.full(2 * len(parts), -1.0), **{n: np.full(2 * len(parts), -1, np.int64) for n in ("left", "right", "feature", "bin")}})
        levels.append(size + np.arange(2 * len(parts)))
        size += 2 * len(parts)
        next_open = np.flatnonzero(gini(below * by_class) >= np.finfo(float).eps) if level + 1 < depth else np.zeros(0, np.int64)
        to = np.full(2 * len(open_), -1, np.int64)  # of the two sides of an open node, the place among the open ones below
        numbered = np.full(2 * len(parts), -1, np.int64)
        numbered[next_open] = np.arange(len(next_open))
        to.reshape(-1, 2)[parts] = numbered.reshape(-1, 2)
        by = features[np.arange(len(open_)), place]
        node = to[2 * node + (rows.bins[at * width + by[node]] > last[node])]
        go = node >= 0
        at, times, labels, node, open_ = at[go], times[go], labels[go], node[go], next_open
    nodes = {n: np.concatenate([f[n] for f in found], axis=-1) for n in found[0]}
    counts = nodes.pop("counts")
    stats = counts * by_class
    nodes |= {"stats": stats.T, "prediction": stats.argmax(axis=0).astype(np.float64), "impurity": gini(stats), "count": _total(counts).astype(np.int64)}
    return _joined(nodes, levels)


# --- the forest ---------------------------------------------------------------------------------------------------------------------

_NODES = "treeID int, id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, leftChild int, rightChild int, feature int, threshold double"


class DealtForest(Estimator):
    """Fits Spark's forest model on ``label`` (0, 1, ...), ``features`` and ``weight``, which rows of one label have in common."""

    def __init__(self, trees: int, depth: int, seed: int) -> None:
        super().__init__()
        self.trees, self.depth, self.seed = trees, depth, seed

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        spark = dataset.sparkSession
        rows = dataset.select("label", F.col("weight").cast("double").alias("weight"), vector_to_array("features").alias("x"))
        labels = rows.groupBy("label").agg(F.min("weight").alias("low"), F.max("weight").alias("high"), F.max(F.size("x")).alias("width")).collect()  # one row per label
        if not labels or any(r.label is None or r.low is None or r.label < 0 or r.label > 255 or r.label != int(r.label) or r.low != r.high for r in labels):
            raise ValueError(f"labels must be whole numbers from 0 to 255 with one weight each, not {labels[:9]}")
        of_class, width = np.zeros(int(max(r.label for r in labels)) + 1), max(r.width for r in labels)
        of_class[[int(r.label) for r in labels]] = [r.low for r in labels]
        rows = rows.withColumn("label", F.col("label").cast("int"))
        cuts = _cuts(rows, width)
        trees, depth, seed, bins = self.trees, self.depth, self.seed, max(2, 1 + max(map(len, cuts)))
        tasks = min(trees, 2 * spark.sparkContext.defaultParallelism)

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packed, counts, mine = [], [], None
            for batch in batches:
                packed += batch.column(1).to_pylist()
                counts += batch.column(2).to_pylist()
                mine = batch.column(0)[0].as_py() if batch.num_rows else mine
            if mine is None:
                return
            read = Rows(packed, counts, width, seed)
            packed = counts = None
            for tree in range(mine, trees, tasks):
                n = grown(read, tree, depth, seed, of_class, bins)
                at = [cuts[f][b] if f >= 0 else None for f, b in zip(n["feature"].tolist(), n["bin"].tolist())]
                whole = [pa.array(c.astype(np.int32)) for c in (np.full(len(at), tree), n["id"], n["left"], n["right"], n["feature"])]
                stats = pa.array(list(n["stats"]), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [*whole[:2], pa.array(n["prediction"]), pa.array(n["impurity"]), stats, pa.array(n["count"]), pa.array(n["gain"]), *whole[2:], pa.array(at, pa.float64())],
                    names=[c.split()[0] for c in _NODES.split(", ")])

        dealt = _packed(rows, cuts).select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "rows", "counts").repartitionById(tasks, F.col("task"))
        return self._stored(dealt.mapInArrow(grow, _NODES), width, len(of_class))

    def _stored(self, nodes: DataFrame, width: int, classes: int) -> RandomForestClassificationModel:
        """The model read from nodes that the tasks wrote in the layout Spark keeps its forests in."""
        spark, path = nodes.sparkSession, run_dir(nodes.sparkSession, "forest")
        split = F.struct(F.col("feature").alias("featureIndex"), F.when(F.col("feature") >= 0, F.array("threshold")).otherwise(F.expr("cast(array() as array<double>)")).alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
        data = F.struct("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", split.alias("split"))
        nodes.select("treeID", data.alias("nodeData")).write.parquet(f"{path}/data")
        settings = RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=self.trees, maxDepth=self.depth, seed=self.seed, minInstancesPerNode=1)
        given = {p.name: settings.getOrDefault(p) for p in settings.params if settings.isSet(p)}
        usual = {p.name: settings.getOrDefault(p) for p in settings.params if settings.hasDefault(p) and not settings.isSet(p)}
        about = lambda kind, uid, without, **more: json.dumps({
            "class": f"{_MODEL}.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid,
            **{n: {k: v for k, v in m.items() if k not in without} for n, m in (("paramMap", given), ("defaultParamMap", usual))}, **more})
        of_forest = ("numTrees", "bootstrap", "subsamplingRate", "featureSubsetStrategy")
        trees = [Row(_1=i, _2=about("DecisionTreeClassificationModel", f"{settings.uid}_{i}", of_forest), _3=1.0) for i in range(self.trees)]
        spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        whole = about("RandomForestClassificationModel", settings.uid, (), numFeatures=width, numClasses=classes, numTrees=self.trees)
        spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
        return RandomForestClassificationModel.load(path)
