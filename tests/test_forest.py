"""The forest whose trees are dealt to tasks, against plain loops, and where the rows it learns from come from."""

import re

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from credence.operators import corpus, forest, learning
from credence.plans import corpus_queries


def some_rows(spark, n=400):
    rows = [(i, int(i % 3 == 0), float((i * 37) % 23 + 6 * (i % 3 == 0)), float(i % 7), 1.0) for i in range(n)]
    return spark.createDataFrame([*rows, *rows[:40]], "id long, label int, a double, b double, c double")  # some come twice


def test_cuts_lie_between_all_values_or_at_equal_shares():
    assert forest.cuts_of(*forest.summary(np.array([3.0, 1.0, 1.0, 7.0]), np.ones(4))) == [2.0, 5.0]
    assert forest.cuts_of(np.array([4.0]), np.ones(1)) == []
    values = np.random.default_rng(1).random(50_000)
    cuts = forest.cuts_of(*forest.summary(values, np.ones(len(values))))
    assert len(cuts) == 31 and np.abs(np.array(cuts) - np.arange(1, 32) / 32).max() < 0.01
    distinct, weights = forest.summary(values, np.ones(len(values)))
    assert len(distinct) <= forest.SUMMED_VALUES and weights.sum() == len(values) and all((values <= v).sum() == w for v, w in list(zip(distinct, np.cumsum(weights)))[::100])


def test_best_split_equals_loops():
    rng = np.random.default_rng(3)
    counts, of_class = rng.integers(0, 4, (2, 30, 3, 5)).astype(float), np.array([0.7, 1.9])
    for node in range(30):  # every feature deals the same rows
        for f in (1, 2):
            counts[:, node, f] = [rng.permutation(c) for c in counts[:, node, 0]]
    counts[:, 0] = 0
    counts[:, 0, :, 2] = 3  # all rows in one bin

    def impurity(stats):
        return 1 - sum((s / sum(stats)) ** 2 for s in stats) if sum(stats) else 0.0

    place, last, gain, left = forest.best_splits(counts, of_class)
    for node in range(30):
        gains = {}
        for f in range(3):
            for b in range(4):
                low, high = counts[:, node, f, : b + 1].sum(axis=1), counts[:, node, f, b + 1 :].sum(axis=1)
                if low.sum() and high.sum():
                    low, high = low * of_class, high * of_class
                    gains[f, b] = impurity(low + high) - (low.sum() * impurity(low) + high.sum() * impurity(high)) / (low + high).sum()
        assert gain[node] == pytest.approx(max([0.0, *gains.values()]), abs=1e-12)
        if gain[node] > 0:
            assert gains[place[node], last[node]] == pytest.approx(gain[node])
            assert left[:, node].tolist() == counts[:, node, place[node], : last[node] + 1].sum(axis=1).tolist()
    assert gain[0] == 0


def test_a_tree_counts_every_drawn_row_where_its_splits_send_it():
    rng = np.random.default_rng(5)
    flat = np.unique(np.column_stack([rng.integers(0, 6, (600, 3)), rng.integers(0, 2, 600)]).astype(np.uint8), axis=0)
    often = rng.integers(1, 5, len(flat)).astype(np.int64)
    rows, of_class = forest.Rows([flat.tobytes()], [often.tobytes()], 3, 42), np.array([1.0, 2.0])
    turned = forest.Rows([flat[::-1].tobytes()], [often[::-1].tobytes()], 3, 42)
    drawn = [rows.drawn(t) for t in range(200)]
    assert np.mean(drawn) == pytest.approx(often.mean(), rel=0.02) and any((a != b).any() for a, b in zip(drawn, drawn[1:]))
    for tree in range(5):
        n, times = forest.grown(rows, tree, 4, 42, of_class, 6), rows.drawn(tree)
        assert all(np.array_equal(v, forest.grown(turned, tree, 4, 42, of_class, 6)[k]) for k, v in n.items())
        want, bins, depth = np.zeros((len(n["id"]), 2)), rows.bins.reshape(-1, 3), {0: 0}
        assert n["id"].tolist() == list(range(len(n["id"])))
        for b, label, t in zip(bins, rows.labels, times):
            at = 0
            while True:
                want[at, label] += t
                if n["left"][at] < 0:
                    break
                side = "left" if b[n["feature"][at]] <= n["bin"][at] else "right"
                depth[int(n[side][at])] = depth[at] + 1
                at = n[side][at]
        assert np.allclose(n["stats"], want * of_class) and n["count"].tolist() == want.sum(axis=1).tolist() and max(depth.values()) <= 4
        leaves = lambda at: n["left"][at] < 0
        for at in range(len(want)):
            if not leaves(at):
                a, b = n["left"][at], n["right"][at]
                assert n["gain"][at] > 0 and not (leaves(a) and leaves(b) and n["prediction"][a] == n["prediction"][b])


def test_trees_are_dealt_to_tasks_and_do_not_depend_on_where_rows_are(spark):
    rows = some_rows(spark)
    spark.sparkContext.setJobGroup("dealt", "dealt")
    try:
        model = learning.train(rows.coalesce(1), ["a", "b", "c"], trees=12, depth=5, dealt=True)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("dealt") for s in tracker.getJobInfo(j).stageIds]
    assert max(i.numTasks for i in map(tracker.getStageInfo, stages) if i) >= 12  # the rows are one task
    assert model.stages[-1].getNumTrees == 12 and model.stages[-1].numFeatures == 3
    again = learning.train(rows.repartition(7), ["a", "b", "c"], trees=12, depth=5, dealt=True)
    trees = lambda m: re.sub(r"-?\d+\.\d+(E-?\d+)?", lambda n: f"{float(n[0]):.6f}", m.stages[-1].toDebugString.split("\n", 1)[1])  # means of scaling differ in the last digits
    assert trees(model) == trees(again)
    right = lambda m: learning.score(m, rows).where("label = prediction").count()
    assert abs(right(model) - right(learning.train(rows, ["a", "b", "c"], trees=12, depth=5))) < 45  # both vary by some 20 of 440 with the seed


def test_labels_of_one_kind_and_values_that_are_no_numbers(spark):
    rows = some_rows(spark).withColumn("weight", F.lit(1.0))
    fit = lambda r: forest.DealtForest(3, 3, 1).fit(VectorAssembler(inputCols=["a", "b"], outputCol="features", handleInvalid="keep").transform(r))
    for label in (0, 1):
        model = fit(rows.where(f"label = {label}"))
        assert model.totalNumNodes == 3 and model.predict(VectorAssembler(inputCols=["a"], outputCol="f").transform(rows.limit(1)).first().f) == label
    for odd in (rows.withColumn("label", F.lit(None).cast("int")), rows.withColumn("a", F.lit(float("nan"))), rows.limit(0)):
        with pytest.raises(Exception, match="label|NaN"):
            fit(odd).totalNumNodes


def test_only_pictures_of_labelled_documents_are_drawn(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"Kigali 2019 text {i}", "en", "web", 10) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (2, 0, 0), (2, 0, 0), (5, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    vectors = [(i, [(((i or 9) * 64 + k) % 101) / 101 - 0.5 for k in range(64)], 0) for i in (0, 1, 2, 3, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    drawn, draw = [], corpus.vector_images
    monkeypatch.setattr(corpus, "vector_images", lambda v, *more: drawn.append(sorted(r.vec_id for r in v.collect())) or draw(v, *more))
    rows = {r.doc_id: r for r in corpus_queries.training_rows(spark, str(tmp_path)).collect()}
    assert drawn == [[0, 2]] and sorted(rows) == [0, 2, 5]
    seen = {r.vec_id: r for r in corpus.image_features(draw(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), "vec_id", "embedding"), ["vec_id"]).collect()}
    for i in (0, 2):
        assert all(rows[i][n] == seen[i][n] for n in corpus.IMAGE_FEATURES)
    assert all(rows[5][n] == 0 for n in corpus.IMAGE_FEATURES)
