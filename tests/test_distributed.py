"""Operators against brute force on small data, hot keys, tables, streams, pictures."""

import math
import random
from difflib import SequenceMatcher

import numpy as np
import picture_reference as reference
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from credence.functions.hotkeys import latest_per_key, left_join_spread, numbered, with_key_summary
from credence.functions.similarity import with_token_hits
from credence.operators import consistency, corpus, learning, persons
from credence.operators.duplicates import duplicate_pairs
from credence.sources.images import image_folder, write_files, write_pictures
from credence.sources.records import metrics_file, parse_records
from credence.sources.sinks import BatchLog, write_csv, write_json
from credence.sources.tableset import TableSet
from credence.streaming import verify_stream as streams


def hot_rows(n=3000, seed=1):
    """A third of all rows under one key."""
    rnd = random.Random(seed)
    return [(i, "hot" if i % 3 == 0 else f"k{rnd.randrange(n // 4)}", rnd.randrange(5)) for i in range(n)]


def test_duplicate_pairs_equal_brute_force(spark):
    rows = hot_rows()
    groups = {}
    for i, h, c in rows:
        groups.setdefault(h, []).append((i, c))
    docs = spark.createDataFrame([(i, c, h) for i, h, c in rows], "id long, candidate_id long, file_hash string")
    got = duplicate_pairs(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        others = sorted(p for p in groups[r.file_hash] if p[0] != r.id)
        assert r.other_id == (others[0][0] if others else None) and r.n_copies == len(others) + 1
        assert r.other_candidate == (others[0][1] if others else None)
        assert r.any_other_candidate == any(c != r.candidate_id for _, c in others)


def scans(df, column):
    """How often the executed plan reads files with that column (reused exchanges do not count)."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return sum("FileScan parquet" in line and column in line.split("]")[0] for line in plan.splitlines())


def test_duplicate_plan_reads_the_rows_once(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 7).alias("candidate_id"), F.md5("text").alias("file_hash"))
    assert scans(duplicate_pairs(docs), "text") == 1


def test_keeper_plan_reads_the_rows_once(spark, folder):
    people = spark.read.parquet(f"{folder}/customer.parquet").select(F.col("c_custkey").alias("id"), F.left("c_name", F.lit(17)).alias("full_name"), F.lit(None).cast("string").alias("email"))
    assert scans(persons.keeper_map(people), "c_name") == 1


def test_key_summary_keeps_every_row(spark):
    rows = hot_rows() + [(9999, None, 1)]
    df = spark.createDataFrame(rows, "id long, k string, v long")
    got = with_key_summary(df, ["k"], ["id"], {"_n": F.count(F.lit(1))}, {"n": F.sum("_n")}, F.col("n") > 1).collect()
    assert len(got) == len(rows)
    assert all(r.n == 1000 for r in got if r.k == "hot")


def test_left_join_spread_equals_left_join(spark):
    parents = spark.range(50).select(F.col("id").alias("pid"))
    kids = spark.createDataFrame([(i, 7 if i % 3 == 0 else i % 40) for i in range(300)], "kid long, owner long")
    want = sorted((r.pid, r.kid) if r.kid is not None else (r.pid, -1) for r in parents.join(kids, F.col("pid") == F.col("owner"), "left").collect())
    got = sorted((r.pid, r.kid) if r.kid is not None else (r.pid, -1) for r in left_join_spread(parents, kids, "pid", "owner").collect())
    assert got == want


def test_numbered(spark):
    rows = [(i, random.Random(i).randrange(20)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v long")
    got = {r.id: r.row_no for r in numbered(df, [F.col("v").desc(), F.col("id")]).collect()}
    want = {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == want
    parts = numbered(df.withColumn("g", F.col("id") % 3), [F.col("v"), F.col("id")], by=["g"]).collect()
    assert {r.id: r.row_no for r in parts} == {
        i: n + 1 for g in range(3) for n, (_, i) in enumerate(sorted((v, i) for i, v in rows if i % 3 == g))}


def test_latest_per_key(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, None, "c"), (2, 1, "d"), (3, None, "e"), (None, 9, "f")], "k int, t int, x string")
    assert {(r.k, r.x) for r in latest_per_key(df, "k", "t").collect()} == {(1, "b"), (2, "d"), (3, "e")}
    far = "timestamp_ntz'9999-12-31 23:59:59.999999'"
    times = spark.sql(f"select * from values (1, {far}, 5, 'a'), (1, {far}, 6, 'b'), (1, timestamp_ntz'2024-03-10 02:30:00.5', 99, 'c'), (2, timestamp_ntz'1960-01-01 00:00:00', -7, 'd'), "
                      "(2, timestamp_ntz'1960-01-01 00:00:00', -8, 'e'), (2, null, 99, 'f'), (3, null, null, 'g'), (3, null, -9223372036854775807, 'h') as t(k, at, id, x)").selectExpr("k", "at", "cast(id as bigint) id", "x")
    assert {(r.k, r.x) for r in latest_per_key(times, "k", "at", "id").collect()} == {(1, "b"), (2, "d"), (3, "h")}


def test_latest_is_found_without_a_sort(spark):
    from credence.plans.catalog import all_queries

    plan = all_queries()["w_latest"](spark, "/root/testdata/sf0.001")
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in text and "Sort" not in text.replace("isFinalPlan", "")


def test_token_hits_equal_brute_force(spark):
    rnd = random.Random(3)
    letters = "ABCDE"
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 13)))
    rows = []
    for i in range(150):
        tokens = [word() for _ in range(3)]
        words = [word() for _ in range(25)]
        for t in tokens:
            if rnd.random() < 0.6:
                at = rnd.randrange(len(t))
                words.append(t[:at] + rnd.choice(letters) + t[at + 1 :] + rnd.choice(["", "A"]))
        rows.append((i, tokens, words))

    def reach(t, w):
        limit = 0.90 if len(t) <= 5 else 0.88
        best = SequenceMatcher(None, t, w).ratio()
        if t in w or w in t:
            best = max(best, min(len(t), len(w)) / max(len(t), len(w)))
        return best >= limit

    want = {i: sum(any(reach(t, w) for w in words) for t in tokens) for i, tokens, words in rows}
    df = spark.createDataFrame(rows, "id int, tokens array<string>, words array<string>")
    got = {r.id: r.hits for r in with_token_hits(df, "tokens", "words", "hits").collect()}
    assert got == want and len(set(want.values())) > 1


def test_repeated_lines_equal_brute_force(spark):
    rnd = random.Random(5)
    docs = [(i, "\n".join(rnd.choice(["a", "b", " c", "c", "", "d"]) for _ in range(rnd.randrange(0, 25)))) for i in range(100)]
    df = spark.createDataFrame(docs, "id int, t string")
    for r in df.withColumn("r", consistency.repeated_lines(F.col("t"))).collect():
        lines = [s.strip() for s in r.t.split("\n") if s.strip()]
        counts = {s: lines.count(s) for s in lines}
        assert (r.r.lines, r.r.repeats, r.r.groups_over_two) == (len(lines), len(lines) - len(counts), sum(c > 2 for c in counts.values()))


def test_merge_is_idempotent(spark):
    cand = spark.createDataFrame([(1, "Ann Bee", None), (2, "ann bee", ""), (3, "Cy", None)], "id long, full_name string, email string")
    docs = spark.createDataFrame([(1, 2), (2, 3), (3, None)], "id long, candidate_id long")
    c1, d1, v1 = persons.merge_persons(cand, docs, docs)
    c2, d2, _ = persons.merge_persons(c1, d1, v1)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(c1) == rows(c2) and rows(d1) == rows(d2)
    assert {(r.id, r.candidate_id) for r in d1.collect()} == {(1, 1), (2, 3), (3, None)}


def test_batch_log_replay(spark):
    log = BatchLog.new(spark, "log")
    assert log.read() is None
    rows = lambda *r: spark.createDataFrame(list(r), "document_id int, status string")
    log.add(rows((1, "a"), (2, "b")), 0)
    for _ in range(2):  # the second time is a replay
        log.add(rows((2, "x"), (3, "y")), 1)
    assert log.read().count() == 4
    assert sorted(map(tuple, log.latest("document_id").collect())) == [(1, "a"), (2, "x"), (3, "y")]


def test_records(spark, tmp_path):
    rows = [('warn\n{"k": 3}', 3, None), ("nothing", None, "No JSON in output"), ("", None, "No output"), ('{"k": ', None, "JSON parse failed")]
    df = parse_records(spark.createDataFrame(rows, "raw string, want int, err string"), "raw", "k int")
    for r in df.collect():
        assert (r.record.k if r.record else None, r.error) == (r.want, r.err)
    assert metrics_file(spark, f"{tmp_path}/none") is None
    write_csv(spark.createDataFrame([("a", "é")], "filename string, predicted string"), f"{tmp_path}/c", single_file=True)
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/c").collect()] == [("a", "é")]
    write_json(spark.createDataFrame([(1, None)], "a int, b int"), f"{tmp_path}/j")
    assert metrics_file(spark, f"{tmp_path}/j").columns == ["a", "b"]


def test_training_set(spark):
    rows = spark.range(103).select("id", (F.col("id") % 4 == 0).cast("int").alias("label"))
    out = learning.balanced(rows, "id")
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {0: 77, 1: 77}
    assert out.where("label = 1").select("id").distinct().count() == 26
    folds = learning.with_folds(rows, "id").groupBy("fold", "label").count().collect()
    assert len(folds) == 10 and max(r["count"] for r in folds) - min(r["count"] for r in folds if r.label == folds[0].label) <= 16
    split = learning.with_split(rows, "id").where("is_test").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in split} == {0: 15, 1: 5}


def test_forest_learns(spark):
    rows = spark.range(300).select("id", (F.col("id") % 2).cast("int").alias("label"), ((F.col("id") % 2) * 10 + F.rand(1)).alias("a"), F.rand(2).alias("b"))
    model, tested = learning.train_and_hold_out(rows, ["a", "b"], "id", trees=10, depth=4)
    assert tested.where("label <> prediction").count() == 0 and tested.count() == 60
    top = learning.importances(model, ["a", "b"]).first()
    assert top.feature == "a" and top.importance > 50
    assert learning.train_and_hold_out(rows.where("id % 2 = 0 or id % 6 = 1"), ["a", "b"], "id", leaky=True, trees=5, depth=3)[1].count() > 0


def test_a_stored_model_is_measured(spark, tmp_path):
    rows = spark.range(200).select("id", (F.col("id") % 4 == 0).cast("int").alias("label"), ((F.col("id") % 4 == 0).cast("int") * 3 + F.rand(1)).alias("a"), F.rand(2).alias("b"))
    rows = rows.withColumn("label", F.when(F.col("id") == 3, 1).otherwise(F.col("label")))  # one that no model gets right
    predictions, metrics = learning.published_model(rows, ["a", "b"], "id", str(tmp_path / "m"), trees=5, depth=3)
    m, got = metrics.first(), predictions.collect()
    assert m.total_samples == len(got) == 40 and m.true_fake + m.false_fake + m.true_real + m.false_real == 40
    assert m.accuracy == pytest.approx(100 * sum(r.label == r.prediction for r in got) / 40, abs=0.005)
    assert metrics_file(spark, str(tmp_path / "m" / "metrics")).first().cv_mean == m.cv_mean and 95 < m.cv_mean < 100
    judged = learning.out_of_fold(rows, ["a", "b"], "id", trees=5, depth=3).collect()
    assert sorted(r.id for r in judged) == list(range(200))
    assert {(r.id, r.fold) for r in judged} == {(r.id, r.fold) for r in learning.with_folds(rows, "id").collect()}
    assert learning.cross_validated(rows.limit(0), ["a", "b"], "id", trees=5, depth=3).count() == 0


def test_each_fold_is_balanced_without_the_rows_held_out(spark):
    rows = spark.range(103).select("id", (F.col("id") % 4 == 0).cast("int").alias("label"))
    dealt = learning.with_folds(rows, "id")
    fold = {r.id: r.fold for r in dealt.collect()}
    sets = learning.fold_training_sets(dealt, "id").collect()
    assert all(fold[r.id] != r.for_fold for r in sets)
    for k in range(5):
        fakes, real = (sum(r.label == v for r in sets if r.for_fold == k) for v in (0, 1))
        assert fakes == real == sum(f != k and i % 4 != 0 for i, f in fold.items())


def test_written_pictures_are_whole_and_single(spark, tmp_path):
    rows = spark.createDataFrame([(1, b"a"), (1, b"a"), (2, b""), (None, b"x"), (3, None)], "id long, content binary").repartition(3)
    for _ in range(2):  # the second run repeats every task
        write_files(rows, "id", f"file:{tmp_path}/p")
    assert {f.name: f.read_bytes() for f in (tmp_path / "p").iterdir()} == {"1.png": b"a", "2.png": b""}


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(i, i % 3, f"h{i % 4}") for i in range(40)], "id long, candidate_id long, file_hash string")
    docs.repartition(4, "id").write.parquet(f"{tmp_path}/in")
    arriving = lambda: spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen, found = TableSet(spark, f"{tmp_path}/seen"), BatchLog(spark, f"{tmp_path}/found")
    for _ in range(2):  # the second run has nothing new
        streams.duplicates_on_arrival(arriving(), seen, found)
    assert sorted((r.file_hash, r.n_docs) for r in seen.read("files").collect()) == [(f"h{i}", 10) for i in range(4)]
    assert seen.versions() == [1, 2, 3, 4, 5]
    hits = found.read().collect()
    assert len(hits) == 36 and len({r.id for r in hits}) == 36 and all(r.id % 4 == r.earlier_id % 4 for r in hits)
    counts = TableSet(spark, f"{tmp_path}/counts")
    streams.live_counts(arriving(), counts, "candidate_id")
    assert {r.candidate_id: r.n for r in counts.read("counts").collect()} == {0: 14, 1: 13, 2: 13}
    pending = BatchLog(spark, f"{tmp_path}/pending")
    streams.pending_on_arrival(arriving(), docs.where("id < 30").select(F.col("id").alias("document_id")), pending)
    assert {r.id for r in pending.read().collect()} == set(range(30, 40))


def slow_laplacian(g):
    h, w = g.shape
    at = lambda y, x: g[abs(y) if y < h else 2 * h - 2 - y, abs(x) if x < w else 2 * w - 2 - x]
    return np.array([[at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * g[y, x] for x in range(w)] for y in range(h)])


def test_picture_statistics():
    rnd = np.random.default_rng(0)
    img = rnd.integers(0, 256, (40, 50, 3)).astype(np.uint8)
    gray = reference.gray_of(img)
    assert np.array_equal(reference.laplacian(gray), slow_laplacian(gray))
    flat = np.full((200, 200, 3), 250, dtype=np.uint8)
    feats = dict(zip(corpus.IMAGE_FEATURES, reference.describe(200, 200, flat.tobytes())))
    assert feats["white_ratio"] == 100 and feats["sharpness"] == feats["edge_density"] == feats["noise"] == feats["saturation"] == feats["texture"] == 0
    assert feats["clone_score"] == 100 and feats["resolution"] == pytest.approx(200 * 200 / 4800)
    blocks = reference.blocks_of(np.arange(100 * 64).reshape(100, 64), 16)
    assert len(blocks) == 6 * 3


def test_banded_picture_statistics_equal_those_of_whole_pictures(spark):
    """Several bands, sides narrower than what mirroring needs, cells, one flat colour, a strip narrower than the borders."""
    rnd = np.random.default_rng(1)
    images = {}
    for i, (h, w) in enumerate([(300, 21), (129, 131), (128, 60), (40, 50), (1, 1), (2, 9), (3, 3), (1, 40), (257, 2), (130, 110), (97, 49)]):
        img = rnd.integers(0, 256, (h, w, 3))
        if i in (1, 9):
            img = np.kron(rnd.integers(0, 256, (h // 10 + 1, w // 10 + 1, 3)), np.ones((10, 10, 1)))[:h, :w]
        if i == 10:
            img[:] = 7
        images[i] = img.astype(np.uint8)
    rows = [(i, *img.shape[:2], img.tobytes()) for i, img in images.items()] + [(None, -1, -1, b""), (90, 2, 2, b"short"), (91, None, None, None)]
    pictures = spark.createDataFrame(rows, "id long, height int, width int, data binary")
    feats = {r.id: r for r in corpus.image_features(pictures, ["id"]).collect()}
    stats = {r.id: r for r in corpus.image_channels(pictures, ["id"]).collect()}
    assert set(feats) == set(stats) == {*images, None, 90, 91}
    for k in (None, 90, 91):
        assert all(feats[k][n] is None for n in corpus.IMAGE_FEATURES) and all(stats[k][n] is None for n in corpus.CHANNEL_STATS)
    for i, img in images.items():
        h, w = img.shape[:2]
        for n, v in zip(corpus.IMAGE_FEATURES, reference.describe(h, w, img.tobytes())):
            assert feats[i][n] == pytest.approx(v, abs=1e-7), (i, n)
        for n, v in zip(corpus.CHANNEL_STATS, reference.channel_stats(h, w, img.tobytes())):
            assert (stats[i][n] is None) if math.isnan(v) else stats[i][n] == pytest.approx(v, abs=1e-6), (i, n)
    assert corpus.image_features(pictures.limit(0), ["id"]).collect() == [] and corpus.image_channels(pictures.limit(0), ["id"]).collect() == []


def test_pictures_are_drawn_once_in_small_batches_by_many_tasks(spark):
    """600 vectors of one partition: batches of pictures are bounded, tasks take turns, and no statistic draws them again."""
    vectors = spark.createDataFrame([(i, [((i * j) % 97) / 97 - 0.5 for j in range(64)]) for i in range(600)], "id long, v array<float>").coalesce(1)
    pictures = corpus.vector_images(vectors, "id", "v")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    assert pictures.rdd.getNumPartitions() == 3
    with_default = pictures.mapInArrow(sizes, "n long, bytes long").agg(F.sum("n"), F.max("bytes")).first()
    assert with_default[0] == 600 and with_default[1] < 300 << 20
    for stats in (corpus.image_features(pictures, ["id"]), corpus.image_channels(pictures, ["id"])):
        assert stats._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # drawn once, read once
        assert stats.count() == 600


def test_pictures_round_trip(spark, tmp_path):
    vectors = spark.createDataFrame([(1, [0.1] * 64), (2, [-0.2] * 32 + [0.3] * 32)], "id long, v array<double>")
    pictures = corpus.vector_images(vectors, "id", "v", scale=4)
    write_pictures(pictures, "id", str(tmp_path))
    (tmp_path / "bad.png").write_bytes(b"not a picture")
    read = {r.path.rsplit("/", 1)[1]: r for r in image_folder(spark, str(tmp_path), "*.png").collect()}
    want = {r.id: r for r in pictures.collect()}
    assert not read["bad.png"].readable and read["bad.png"].width == -1
    for k in (1, 2):
        got = read[f"{k}.png"]
        assert (got.width, got.height, bytes(got.data)) == (32, 32, bytes(want[k].data))
    cloned = consistency.clone_blocks(corpus.image_blocks(corpus.vector_images(vectors, "id", "v", 16), "id", size=16, step=4, min_std=0).withColumnRenamed("id", "image_id"))
    assert {r.image_id: r.blocks for r in cloned.collect()} == {1: 49, 2: 49}


def test_flat_blocks_count_towards_the_least_number_of_blocks(spark):
    blocks = spark.createDataFrame([(1, b) for b in "aaabbbcdef"[:10]], "image_id int, block string")
    images = spark.createDataFrame([(1, 30), (2, 30)], "image_id int, total_blocks int")
    got = {r.image_id: r.cloned for r in consistency.clone_blocks(blocks, images=images).collect()}
    assert got == {1: True, 2: False}
    assert not consistency.clone_blocks(blocks).first().cloned


def test_nameless_persons_stay_apart(spark):
    from credence.operators.persons import keeper_map

    rows = spark.createDataFrame([(1, None, None), (2, None, None), (3, "A ", None), (4, "a", "")], "id long, full_name string, email string")
    assert [tuple(r) for r in keeper_map(rows).collect()] == [(4, 3)]


def test_a_stream_reads_a_table_of_many_files(spark, tmp_path):
    from credence.plans.catalog import all_queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    orders.repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    pending = all_queries()["t_pending"]
    assert sorted(map(tuple, pending(spark, str(tmp_path)).collect())) == sorted(map(tuple, pending(spark, "/root/testdata/sf0.001").collect()))


def test_a_key_reaches_the_scan(spark):
    from credence.plans.catalog import all_queries

    plan = all_queries()["f_by_id"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_custkey,7)" in plan
