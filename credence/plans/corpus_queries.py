"""Image corpus, training and evaluation, files, streams, and the whole verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from credence import fixed_values as fv
from credence.functions.text import join_issues, labelize
from credence.operators import capture, consistency, corpus, evaluation, learning, listings
from credence.operators.content import text_features
from credence.operators.fusion import fuse
from credence.operators.verification import no_duplicate, no_link, no_printed_name, verify, verification_rows
from credence.plans.listing_queries import PAIRS
from credence.plans.registry import Registry
from credence.plans.rule_queries import _DESC, _MIN, _TYPE
from credence.plans.tables import CLASSES, DOC_TYPES, SOFTWARE, derived, link_text, pick, table_expressions, with_tables
from credence.plans.text_queries import sq
from credence.plans.verification_sql import TRUST, VERIFY
from credence.session import cut_lineage, run_dir
from credence.sources.images import image_folder, write_files, write_pictures
from credence.sources.records import metrics_file
from credence.sources.sinks import BatchLog, write_csv, write_json
from credence.sources.tableset import TableSet
from credence.sources.tables import parquet_table
from credence.streaming import verify_stream as streams
from credence.streaming.verification_view import VerificationView

R = Registry()

# --- evaluation over the given labels --------------------------------------------------------------------------


def predictions(spark, sf):
    labels = parquet_table(spark, sf, "labels")
    wrong = F.col("doc_id") % 5 == 0
    return labels.select("doc_id", F.col("quality").alias("label"), F.when(wrong, 1 - F.col("quality")).otherwise(F.col("quality")).alias("prediction"))


_PRED = "p AS (SELECT doc_id, quality AS label, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS prediction FROM labels)"
_CELLS = ("c AS (SELECT count(*) FILTER (label = 0 AND prediction = 0) AS true_fake, count(*) FILTER (label = 0 AND prediction = 1) AS false_real, "
          "count(*) FILTER (label = 1 AND prediction = 0) AS false_fake, count(*) FILTER (label = 1 AND prediction = 1) AS true_real FROM p)")


@R.add("a_confusion", f"WITH {_PRED}, {_CELLS} SELECT * FROM c")
def a_confusion(spark, sf):
    return evaluation.confusion(predictions(spark, sf))


@R.add("a_detect_rates", f"WITH {_PRED}, {_CELLS} SELECT round(coalesce(true_fake::DOUBLE / nullif(true_fake + false_real, 0), 0) * 100, 2) AS fake_detection_rate, "
       "round(coalesce(true_real::DOUBLE / nullif(false_fake + true_real, 0), 0) * 100, 2) AS real_detection_rate FROM c")
def a_detect_rates(spark, sf):
    return evaluation.detection_rates(predictions(spark, sf))


@R.add("a_accuracy", f"WITH {_PRED} SELECT round(avg(CAST(label = prediction AS INTEGER)) * 100, 2) AS accuracy FROM p")
def a_accuracy(spark, sf):
    return evaluation.accuracy(predictions(spark, sf))


_REPORT_ROWS = (
    "k AS (SELECT 'Fake' AS class, true_fake::DOUBLE / nullif(true_fake + false_fake, 0) AS p, true_fake::DOUBLE / nullif(true_fake + false_real, 0) AS r, true_fake + false_real AS support FROM c "
    "UNION ALL SELECT 'Real', true_real::DOUBLE / nullif(true_real + false_real, 0), true_real::DOUBLE / nullif(true_real + false_fake, 0), true_real + false_fake FROM c), "
    "kf AS (SELECT class, coalesce(p, 0) AS precision, coalesce(r, 0) AS recall, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1, support FROM k)"
)


@R.add("a_class_report", (
    f"WITH {_PRED}, {_CELLS}, {_REPORT_ROWS} SELECT class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM kf "
    "UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), CAST(sum(support) AS BIGINT) FROM kf "
    "UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 4), round(sum(recall * support) / sum(support), 4), round(sum(f1 * support) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM kf"))
def a_class_report(spark, sf):
    return evaluation.class_report(predictions(spark, sf))


@R.add("a_eval_summary", (
    f"WITH {_PRED} SELECT count(*) AS total_fake, count(*) FILTER (prediction = 0) AS identified_fake, count(*) FILTER (prediction <> 0) AS missed_fake, "
    "round(coalesce(count(*) FILTER (prediction = 0)::DOUBLE / nullif(count(*), 0), 0) * 100, 2) AS detection_rate FROM p WHERE label = 0"))
def a_eval_summary(spark, sf):
    return evaluation.fake_set_summary(predictions(spark, sf).where("label = 0"))


_FOLD_SCORES = "f AS (SELECT doc_id % 7 AS fold, avg(CAST(label = prediction AS INTEGER)) AS accuracy FROM p GROUP BY ALL)"


def fold_scores(spark, sf):
    hit = (F.col("label") == F.col("prediction")).cast("int")
    return predictions(spark, sf).groupBy((F.col("doc_id") % 7).alias("fold")).agg(F.avg(hit).alias("accuracy"))


@R.add("a_cv_stats", f"WITH {_PRED}, {_FOLD_SCORES} SELECT round(avg(accuracy) * 100, 2) AS cv_mean, round(stddev_pop(accuracy) * 100, 2) AS cv_std FROM f")
def a_cv_stats(spark, sf):
    return evaluation.fold_stats(fold_scores(spark, sf))


@R.add("m_metrics", (
    f"WITH {_PRED}, {_CELLS}, {_FOLD_SCORES} SELECT (SELECT count(*) FROM p) AS total_samples, false_fake + true_real AS real_samples, true_fake + false_real AS fake_samples, "
    "round((true_fake + true_real)::DOUBLE / (true_fake + true_real + false_fake + false_real) * 100, 2) AS accuracy, true_fake, false_real, false_fake, true_real, "
    "round(true_fake::DOUBLE / (true_fake + false_real) * 100, 2) AS fake_detection_rate, round(true_real::DOUBLE / (false_fake + true_real) * 100, 2) AS real_detection_rate, "
    "(SELECT round(avg(accuracy) * 100, 2) FROM f) AS cv_mean, (SELECT round(stddev_pop(accuracy) * 100, 2) FROM f) AS cv_std FROM c"))
def m_metrics(spark, sf):
    return evaluation.metrics(predictions(spark, sf), fold_scores(spark, sf))


# --- training set -----------------------------------------------------------------------------------------------------


def _labelled(spark, sf):
    """Few real rows, many fakes, as in the data the balancing is made for."""
    return parquet_table(spark, sf, "labels").select("doc_id", (1 - F.col("quality")).alias("label"))


_LAB = "l AS (SELECT doc_id, 1 - quality AS label FROM labels)"
_RANK = _LAB + ", r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat(doc_id, ':42')), doc_id) AS rank, count(*) OVER (PARTITION BY label) AS n FROM l)"


@R.add("m_balance", (
    f"WITH {_RANK}, w AS (SELECT count(*) FILTER (label = 0) AS want FROM l) SELECT doc_id, label, CAST(unnest(range(1, 1 + CASE WHEN label = 1 AND n < want THEN want // n + CASE WHEN rank <= want % n THEN 1 ELSE 0 END ELSE 1 END)) AS INTEGER) AS copy FROM r, w"))
def m_balance(spark, sf):
    return learning.balanced(_labelled(spark, sf), "doc_id").select("doc_id", "label", "copy")


@R.add("m_split", f"WITH {_RANK} SELECT doc_id, label, rank <= round(n * 0.2::DOUBLE) AS is_test FROM r")
def m_split(spark, sf):
    return learning.with_split(_labelled(spark, sf), "doc_id").select("doc_id", "label", "is_test")


@R.add("w_folds", f"WITH {_RANK} SELECT doc_id, label, CAST((rank - 1) % 5 AS INTEGER) AS fold FROM r")
def w_folds(spark, sf):
    return learning.with_folds(_labelled(spark, sf), "doc_id").select("doc_id", "label", "fold")


@R.add("m_scale", (
    "WITH d AS (SELECT doc_id, n_chars::DOUBLE AS chars, len(regexp_extract_all(text, '\\S+'))::DOUBLE AS words FROM documents), s AS (SELECT avg(chars) AS mc, stddev_pop(chars) AS sc, avg(words) AS mw, stddev_pop(words) AS sw FROM d) "
    "SELECT doc_id, round((chars - mc) / sc, 6) AS chars, round((words - mw) / sw, 6) AS words FROM d, s"))
def m_scale(spark, sf):
    docs = parquet_table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("chars"), F.regexp_count("text", F.lit(r"\S+")).cast("double").alias("words"))
    return learning.standardised(docs, ["chars", "words"]).select("doc_id", F.round("chars", 6).alias("chars"), F.round("words", 6).alias("words"))


def training_rows(spark, sf):
    """The fifteen features of every labelled document; those of a picture are 0 where a document has none.

    Only pictures of labelled documents have a row to go to, so the others are not drawn.
    """
    labels = _labelled(spark, sf)
    vectors = parquet_table(spark, sf, "embeddings").join(labels.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    seen = corpus.image_features(corpus.vector_images(vectors, "vec_id", "embedding"), ["vec_id"]).withColumnRenamed("vec_id", "doc_id")
    texts = derived(spark, sf, "submissions").join(labels.withColumnRenamed("doc_id", "id"), "id")
    read = texts.select(F.col("id").alias("doc_id"), "label", *[c.alias(n) for n, c in text_features(F.col("text")).items()],
                        (F.col("id") % 2).cast("double").alias("face_found"), (F.col("id") % 3 == 0).cast("double").alias("qr_found"))
    return cut_lineage(read.join(seen, "doc_id", "left").select("doc_id", "label", *fv.FEATURE_NAMES).na.fill(0.0, list(fv.FEATURE_NAMES)))


@R.add("m_forest")
def m_forest(spark, sf):
    rows = training_rows(spark, sf)
    _, tested = learning.train_and_hold_out(rows, fv.FEATURE_NAMES, "doc_id")
    return tested.select("doc_id", "label", "prediction", "probability")


@R.add("m_cv")
def m_cv(spark, sf):
    return learning.cross_validated(training_rows(spark, sf), fv.FEATURE_NAMES, "doc_id")


@R.add("m_cv_folds", (
    "WITH l AS (SELECT doc_id, 1 - quality AS label FROM labels JOIN documents USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat(doc_id, ':42')), doc_id) AS rank FROM l), "
    "d AS (SELECT *, (rank - 1) % 5 AS fold FROM r), s AS (SELECT f.for_fold::INTEGER AS for_fold, d.* FROM d, range(0, 5) f(for_fold) WHERE f.for_fold <> d.fold), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY for_fold, label ORDER BY md5(concat(doc_id, ':42')), doc_id) AS place, count(*) OVER (PARTITION BY for_fold, label) AS n, count(*) FILTER (label = 0) OVER (PARTITION BY for_fold) AS want FROM s) "
    "SELECT for_fold, doc_id, label, CAST(CASE WHEN label = 1 AND n < want THEN want // n + CASE WHEN place <= want % n THEN 1 ELSE 0 END ELSE 1 END AS BIGINT) AS copies FROM o"))
def m_cv_folds(spark, sf):
    """What each fold's model is fitted on, and how often."""
    labels = _labelled(spark, sf).join(parquet_table(spark, sf, "documents").select("doc_id"), "doc_id")
    dealt = cut_lineage(learning.with_folds(labels, "doc_id"))
    return learning.fold_training_sets(dealt, "doc_id").groupBy("for_fold", "doc_id", "label").agg(F.count(F.lit(1)).alias("copies"))


@R.add("m_model_metrics")
def m_model_metrics(spark, sf):
    """Training, the stored model, its predictions and folds, and the metrics of them, read back from their JSON."""
    folder = run_dir(spark, "published")
    learning.published_model(training_rows(spark, sf), fv.FEATURE_NAMES, "doc_id", folder)
    return metrics_file(spark, f"{folder}/metrics")


@R.add("m_importance")
def m_importance(spark, sf):
    rows = training_rows(spark, sf)
    return learning.importances(learning.train(learning.balanced(rows, "doc_id"), fv.FEATURE_NAMES), fv.FEATURE_NAMES)


@R.add("s_importance", (
    "WITH s AS (SELECT round(avg(CAST(n_chars > 500 AS INTEGER)) * 100, 2) AS a, round(avg(CAST(contains(text, 'the') AS INTEGER)) * 100, 2) AS b, round(avg(CAST(lang = 'fr' AS INTEGER)) * 100, 2) AS c FROM documents) "
    "SELECT 'long_text' AS feature, a AS importance, 'Long text' AS label FROM s UNION ALL SELECT 'common_words', b, 'Common words' FROM s UNION ALL SELECT 'language', c, 'Language' FROM s"))
def s_importance(spark, sf):
    """A map of feature weights shown with labels, greatest first."""
    share = lambda c: F.round(F.avg(c.cast("int")) * 100, 2)
    weights = parquet_table(spark, sf, "documents").agg(F.create_map(
        F.lit("long_text"), share(F.col("n_chars") > 500), F.lit("common_words"), share(F.col("text").contains("the")), F.lit("language"), share(F.col("lang") == "fr")).alias("w"))
    rows = weights.select(F.explode("w").alias("feature", "importance"))
    return rows.withColumn("label", labelize(F.col("feature"))).orderBy(F.desc("importance"), "feature")


@R.add("m_eval")
def m_eval(spark, sf):
    """Model scored on fakes that it was not fitted on, predictions to CSV and summary to JSON, both read back."""
    _, tested = learning.train_and_hold_out(training_rows(spark, sf), fv.FEATURE_NAMES, "doc_id")
    scored = tested.where("label = 0")
    named = scored.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("filename"), F.when(F.col("prediction") == 0, "Fake").otherwise("Real").alias("predicted"),
                          F.format_string("%.1f%%", F.col("probability")).alias("probability"), "prediction")
    folder = run_dir(spark, "fake-evaluation")
    write_csv(named.drop("prediction"), f"{folder}/csv")
    back = spark.read.option("header", True).csv(f"{folder}/csv")
    write_json(evaluation.fake_set_summary(back.select(F.when(F.col("predicted") == "Fake", 0).otherwise(1).alias("prediction"))), f"{folder}/json")
    return metrics_file(spark, f"{folder}/json")


# --- files -----------------------------------------------------------------------------------------------------------------


@R.add("sink_csv", f"WITH {_PRED} SELECT concat('doc_', doc_id) AS filename, CASE WHEN prediction = 0 THEN 'Fake' ELSE 'Real' END AS predicted, concat(CAST(doc_id % 100 AS VARCHAR), '.5%') AS probability FROM p")
def sink_csv(spark, sf):
    rows = predictions(spark, sf).select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("filename"), F.when(F.col("prediction") == 0, "Fake").otherwise("Real").alias("predicted"),
                                         F.concat((F.col("doc_id") % 100).cast("string"), F.lit(".5%")).alias("probability"))
    path = run_dir(spark, "predictions-csv")
    write_csv(rows, path)
    return spark.read.option("header", True).csv(path)


@R.add("sink_json", R.oracles["m_metrics"])
def sink_json(spark, sf):
    path = run_dir(spark, "metrics-json")
    write_json(m_metrics(spark, sf), path)
    return spark.read.schema(m_metrics(spark, sf).schema).json(path)


@R.add("src_metrics_json", f"SELECT *, true AS evaluation_missing FROM ({R.oracles['m_metrics']})")
def src_metrics_json(spark, sf):
    """Metrics document present, evaluation document absent."""
    path = run_dir(spark, "metrics-file")
    write_json(m_metrics(spark, sf), path)
    absent = metrics_file(spark, f"{path}-missing") is None
    return metrics_file(spark, path).withColumn("evaluation_missing", F.lit(absent))


@R.add("src_images", "SELECT vec_id AS id, CASE WHEN label % 5 = 4 THEN -1 ELSE 128 END AS width, CASE WHEN label % 5 = 4 THEN -1 ELSE 128 END AS height, label % 5 <> 4 AS readable FROM embeddings")
def src_images(spark, sf):
    """Pictures of the vectors written by tasks and read back; the files of one label in five hold no picture."""
    vectors = parquet_table(spark, sf, "embeddings")
    folder = run_dir(spark, "pictures")
    pictures = corpus.vector_images(vectors, "vec_id", "embedding")
    broken = pictures.join(vectors.where("label % 5 = 4").select("vec_id"), "vec_id", "left_semi")
    write_pictures(pictures.join(vectors.where("label % 5 <> 4").select("vec_id"), "vec_id", "left_semi"), "vec_id", folder)
    write_files(broken.select("vec_id", F.lit(b"no picture").alias("content")), "vec_id", folder)
    return image_folder(spark, folder, "*.png").select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("bigint").alias("id"), "width", "height", "readable")


def _pictures(spark, sf, scale=16):
    return corpus.vector_images(parquet_table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", scale)


def _feature_query(name, scale=16):
    def run(spark, sf):
        return corpus.image_features(_pictures(spark, sf, scale), ["vec_id"], [name]).select("vec_id", F.round(name, 4).alias(name))

    return run


_CELL = "least(255, greatest(0, (v::DOUBLE + 0.5::DOUBLE) * 255))"


def _drawn_sql(scale=16):
    """Pixels (vec_id, y, x) of the pictures; ``value_at`` and ``gray_at`` read the cells of the vector that they lie in."""
    side = 8 * scale
    return (
        f"c AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor({_CELL}) AS INTEGER)) AS g, list_transform(embedding, lambda v: CAST(floor(255 - {_CELL}) AS INTEGER)) AS b FROM embeddings), "
        "k AS (SELECT *, list_transform(range(0, 64), lambda i: g[(i // 8) * 8 + (i + 7) % 8 + 1]) AS r FROM c), "
        "p AS (SELECT *, list_transform(range(0, 64), lambda i: CAST(floor(0.114::DOUBLE * b[i + 1] + 0.587::DOUBLE * g[i + 1] + 0.299::DOUBLE * r[i + 1] + 0.5::DOUBLE) AS INTEGER)) AS gray FROM k), "
        f"px AS (SELECT p.*, ys.y, xs.x FROM p, (SELECT unnest(range(0, {side})) AS y) ys, (SELECT unnest(range(0, {side})) AS x) xs)")


def _value_at(plane, y="y", x="x", scale=16):
    return f"{plane}[(({y}) // {scale}) * 8 + ({x}) // {scale} + 1]"


def _mirror_sql(n, size="128"):
    return f"(CASE WHEN {n} < 0 THEN -({n}) WHEN {n} >= {size} THEN 2 * {size} - 2 - ({n}) ELSE {n} END)"


def _gray_near(dy, dx):
    return _value_at("gray", _mirror_sql(f"y + {dy}"), _mirror_sql(f"x + {dx}"))


def _variance_sql(value, where=""):
    """From exact sums, in the order of the query, so that ties of rounding fall alike."""
    total = lambda v: f"(sum({v}){where})::DOUBLE / (count(*){where})"
    return f"greatest({total(f'({value}) * ({value})')} - ({total(value)}) * ({total(value)}), 0)"


_LAPLACE = f"{_gray_near(-1, 0)} + {_gray_near(1, 0)} + {_gray_near(0, -1)} + {_gray_near(0, 1)} - 4 * {_value_at('gray')}"
_SOBEL = " + ".join(
    f"abs({a} - ({b}))" for a, b in (
        (f"({_gray_near(-1, 1)} + 2 * {_gray_near(0, 1)} + {_gray_near(1, 1)})", f"{_gray_near(-1, -1)} + 2 * {_gray_near(0, -1)} + {_gray_near(1, -1)}"),
        (f"({_gray_near(1, -1)} + 2 * {_gray_near(1, 0)} + {_gray_near(1, 1)})", f"{_gray_near(-1, -1)} + 2 * {_gray_near(-1, 0)} + {_gray_near(-1, 1)}")))
_BLUR = " + ".join(f"{v * w} * {_gray_near(dy, dx)}" for dy, v in zip(range(-2, 3), (1, 4, 6, 4, 1)) for dx, w in zip(range(-2, 3), (1, 4, 6, 4, 1)))

R.add("i_sharpness", f"WITH {_drawn_sql()}, l AS (SELECT vec_id, {_LAPLACE} AS v FROM px) SELECT vec_id, round(least(100, {_variance_sql('v')} / 5), 4) AS sharpness FROM l GROUP BY vec_id")(_feature_query("sharpness"))
R.add("i_edges", (
    f"WITH {_drawn_sql()}, e AS (SELECT vec_id, y, x, {_SOBEL} AS size FROM px), "
    "tall AS (SELECT *, max(size) OVER (PARTITION BY vec_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM e), "
    "near AS (SELECT *, max(m) OVER (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS beside FROM tall) "
    "SELECT vec_id, round(avg(CASE WHEN size > 50 AND beside > 150 THEN 1 ELSE 0 END) * 100, 4) AS edge_density FROM near GROUP BY vec_id"))(_feature_query("edge_density"))
R.add("i_noise", f"WITH {_drawn_sql()} SELECT vec_id, round(stddev_pop({_value_at('gray')} - floor(({_BLUR})::DOUBLE / 256 + 0.5::DOUBLE)), 4) AS noise FROM px GROUP BY vec_id")(_feature_query("noise"))
# cells of 12 pixels, so that blocks of 16 are not flat
R.add("i_texture", (
    f"WITH {_drawn_sql(12)}, s AS (SELECT vec_id, stddev_pop({_value_at('gray', scale=12)}) AS std FROM px WHERE y < 80 AND x < 80 GROUP BY vec_id, y // 16, x // 16) "
    "SELECT vec_id, round(avg(std), 4) AS texture FROM s GROUP BY vec_id"))(_feature_query("texture", 12))

@R.add("i_resolution", "SELECT vec_id, round(least(100, pow(16 * sqrt(len(embedding)), 2) / 480000::DOUBLE * 100), 4) AS resolution FROM embeddings")
def i_resolution(spark, sf):
    """The size of the picture that a vector gives is known without drawing it."""
    side = F.sqrt(F.size("embedding")) * 16
    return parquet_table(spark, sf, "embeddings").select("vec_id", F.round(corpus.resolution(side, side), 4).alias("resolution"))


# one picture cell per vector value: g from the value, b its opposite, r from the left neighbour in the row
R.add("i_saturation", (
    f"WITH c AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor({_CELL}) AS INTEGER)) AS g, list_transform(embedding, lambda v: CAST(floor(255 - {_CELL}) AS INTEGER)) AS b FROM embeddings), "
    "y AS (SELECT vec_id, list_transform(range(0, 64), lambda i: [b[i + 1], g[i + 1], g[(i // 8) * 8 + (i + 7) % 8 + 1]]) AS px FROM c) "
    "SELECT vec_id, round(list_avg(list_transform(px, lambda p: CASE WHEN list_max(p) > 0 THEN floor(255 * (list_max(p) - list_min(p))::DOUBLE / list_max(p) + 0.5::DOUBLE) ELSE 0 END)), 4) AS saturation FROM y"))(_feature_query("saturation"))
R.add("i_white", (
    f"WITH c AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor({_CELL}) AS INTEGER)) AS g, list_transform(embedding, lambda v: CAST(floor(255 - {_CELL}) AS INTEGER)) AS b FROM embeddings), "
    "y AS (SELECT vec_id, list_transform(range(0, 64), lambda i: floor(0.114::DOUBLE * b[i + 1] + 0.587::DOUBLE * g[i + 1] + 0.299::DOUBLE * g[(i // 8) * 8 + (i + 7) % 8 + 1] + 0.5::DOUBLE)) AS gray FROM c) "
    "SELECT vec_id, round(len(list_filter(gray, lambda x: x > 245))::DOUBLE / 64 * 100, 4) AS white_ratio FROM y"))(_feature_query("white_ratio"))


# a block of 32 is two by two cells, of which every sample holds all four
@R.add("i_clone", (
    f"WITH {_drawn_sql()}, q AS (SELECT vec_id, [{_value_at('gray')}, {_value_at('gray', x='x + 16')}, {_value_at('gray', y='y + 16')}, {_value_at('gray', 'y + 16', 'x + 16')}] AS cells FROM px WHERE y IN (0, 32, 64) AND x IN (0, 32, 64)), "
    "n AS (SELECT vec_id, cells, count(*) AS n FROM q WHERE list_stddev_pop(cells) >= 2 GROUP BY vec_id, cells), "
    "t AS (SELECT vec_id, sum(n) AS blocks, sum(n - 1) AS repeats, count(*) FILTER (n > 2) AS over FROM n GROUP BY vec_id) "
    "SELECT vec_id, CAST(9 AS BIGINT) AS total_blocks, CAST(coalesce(blocks, 0) AS BIGINT) AS blocks, CAST(coalesce(repeats, 0) AS BIGINT) AS repeats, CAST(coalesce(over, 0) AS BIGINT) AS groups_over_two, "
    "CAST(least(100, coalesce(repeats, 0) * 10) AS INTEGER) AS clone_score, false AS cloned FROM embeddings LEFT JOIN t USING (vec_id)"))
def i_clone(spark, sf):
    """Repeated blocks per picture."""
    pictures = _pictures(spark, sf)
    sizes = pictures.select("vec_id", corpus.block_count(F.col("height"), F.col("width")).alias("total_blocks"))
    return consistency.clone_blocks(corpus.image_blocks(pictures, "vec_id"), "vec_id", images=sizes)


def _channels_sql():
    plane = lambda c: f"{_value_at(c)}::DOUBLE"
    top, low = (f"{f}({', '.join(plane(c) for c in 'bgr')})" for f in ("greatest", "least"))
    near = lambda dy, dx: _value_at("gray", "top + " + _mirror_sql(f"(y - top + {dy})", "high"), "lft + " + _mirror_sql(f"(x - lft + {dx})", "broad"))
    return (
        f"WITH {_drawn_sql()}, t AS (SELECT vec_id, y, x, {plane('b')} AS b, {plane('g')} AS g, {plane('r')} AS r, {plane('gray')} AS gray, {top} AS hi, {low} AS lo FROM px), "
        "u AS (SELECT *, CASE WHEN hi > 0 THEN floor(255 * (hi - lo) / hi + 0.5::DOUBLE) ELSE 0 END AS sat, "
        "CASE WHEN hi = r THEN (g - b) / (hi - lo) WHEN hi = g THEN 2 + (b - r) / (hi - lo) ELSE 4 + (r - g) / (hi - lo) END * 60 AS h, "
        "y >= 96 AND y < 121 AND x >= 44 AND x < 83 AS seal, y < 32 AND x >= 32 AND x < 96 AS header FROM t), "
        "v AS (SELECT *, CASE WHEN hi > lo THEN floor((CASE WHEN h < 0 THEN h + 360 ELSE h END) / 2 + 0.5::DOUBLE) % 180 ELSE 0 END AS hue FROM u), "
        "tones AS (SELECT vec_id, avg(b) / (avg(r) + 1) AS blue_red, avg(CASE WHEN b + g + r > 660 THEN 1 ELSE 0 END) FILTER (header) AS header_bright, "
        f"sqrt({_variance_sql('sat')}) AS sat_std, {_variance_sql('gray')} AS gray_var, sqrt({_variance_sql('hue', ' FILTER (seal)')}) AS seal_hue_std, "
        " avg(sat) FILTER (seal) AS seal_sat_mean FROM v GROUP BY vec_id), "
        "w AS (SELECT * FROM (VALUES (0, 0, 0, 128, 128), (1, 0, 0, 50, 128), (2, 78, 0, 50, 128), (3, 0, 0, 128, 50), (4, 0, 78, 128, 50)) w(part, top, lft, high, broad)), "
        f"m AS (SELECT vec_id, part, {near(-1, 0)} + {near(1, 0)} + {near(0, -1)} + {near(0, 1)} - 4 * {_value_at('gray')} AS v FROM px, w "
        "WHERE y >= top AND y < top + high AND x >= lft AND x < lft + broad), "
        f"l AS (SELECT vec_id, part, {_variance_sql('v')} AS v FROM m GROUP BY vec_id, part), "
        "d AS (SELECT vec_id, max(v) FILTER (part = 0) AS laplace_var, (max(v) FILTER (part = 1) + max(v) FILTER (part = 2) + max(v) FILTER (part = 3) + max(v) FILTER (part = 4)) / 4 AS border_detail FROM l GROUP BY vec_id), "
        "bars AS (SELECT vec_id, gray AS level, count(*) AS n FROM t GROUP BY vec_id, gray), "
        "sums AS (SELECT *, sum(n) OVER low AS below, sum(n * level) OVER low AS mass, sum(n) OVER every AS total, sum(n * level) OVER every AS whole FROM bars "
        "WINDOW low AS (PARTITION BY vec_id ORDER BY level ROWS UNBOUNDED PRECEDING), every AS (PARTITION BY vec_id)), "
        "spread AS (SELECT *, CASE WHEN below < total THEN pow(whole * below / total - mass, 2) / (below * (total - below)) ELSE -1 END AS s FROM sums), "
        "dark AS (SELECT vec_id, arg_max(level, (s, -level)) AS dark, max(s) AS s FROM spread GROUP BY vec_id), "
        "ink AS (SELECT vec_id, CASE WHEN sum(n) > 100 THEN sqrt(greatest(sum(n * level * level) / sum(n) - (sum(n * level) / sum(n)) * (sum(n * level) / sum(n)), 0)) END AS ink_std FROM bars JOIN dark USING (vec_id) "
        "WHERE level <= CASE WHEN s < 0 THEN 0 ELSE dark END GROUP BY vec_id), "
        "a AS (SELECT * FROM tones JOIN d USING (vec_id) LEFT JOIN ink USING (vec_id)), "
        "points AS (SELECT *, least(100, greatest(0, 100 - CASE WHEN blue_red > 1.1 THEN -5 WHEN blue_red < 0.6 THEN 15 ELSE 0 END - CASE WHEN header_bright < 0.05 THEN 10 ELSE 0 END - CASE WHEN NOT sat_std > 30 THEN 10 ELSE 0 END)) AS uv, "
        "100 - CASE WHEN laplace_var <= 50 THEN 10 ELSE 0 END AS laser, "
        "least(100, 100 - CASE WHEN seal_hue_std > 40 AND seal_sat_mean > 60 THEN -5 WHEN seal_hue_std > 20 THEN 0 ELSE 15 END) AS holo, "
        "least(100, 100 - CASE WHEN border_detail > 200 THEN -5 WHEN border_detail <= 50 THEN 10 ELSE 0 END) AS micro FROM a) "
        f"SELECT vec_id, {', '.join(f'round({c} + 1e-9::DOUBLE, 4) AS {c}' for c in corpus.CHANNEL_STATS)}, "
        "CAST(round_even(uv * 0.20::DOUBLE + laser * 0.35::DOUBLE + holo * 0.25::DOUBLE + micro * 0.20::DOUBLE, 0) AS INTEGER) AS score FROM points")


@R.add("i_channels", _channels_sql())
def i_channels(spark, sf):
    stats = corpus.image_channels(_pictures(spark, sf), ["vec_id"])
    checked = stats.withColumn("s", capture.security_check(
        F.lit("certificate"), F.col("blue_red"), F.col("header_bright"), F.col("sat_std"), F.col("laplace_var"), F.col("ink_std"), F.col("seal_hue_std"), F.col("seal_sat_mean"), F.lit(False), F.col("border_detail")))
    # strips of 6,400 pixels give values halfway between two; all of them are rounded up
    return checked.select("vec_id", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in corpus.CHANNEL_STATS], "s.score")


@R.add("i_prepare", "SELECT doc_id, least(n_chars, 2000) AS width, CASE WHEN n_chars > 2000 THEN CAST(floor((n_chars // 3) * (2000::DOUBLE / n_chars)) AS BIGINT) ELSE n_chars // 3 END AS height FROM documents")
def i_prepare(spark, sf):
    w, h = corpus.prepared_size(F.col("n_chars"), F.expr("n_chars div 3"))
    return parquet_table(spark, sf, "documents").select("doc_id", w.cast("bigint").alias("width"), h.cast("bigint").alias("height"))


@R.add("i_augment", (
    f"SELECT vec_id, CAST(v AS INTEGER) AS variant, list_extract([{', '.join(sq(m) for m in fv.TAMPER_METHODS)}], CAST(v % 7 AS INTEGER) + 1) AS method, "
    f"concat('fake_', CAST(vec_id AS VARCHAR), '_', list_extract([{', '.join(sq(m) for m in fv.TAMPER_METHODS)}], CAST(v % 7 AS INTEGER) + 1), '_', CAST(v AS VARCHAR), '.jpg') AS file FROM embeddings, range(0, 5) t(v)"))
def i_augment(spark, sf):
    rows = parquet_table(spark, sf, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("stem"))
    return corpus.augmentation_plan(rows, 5, "stem").select("vec_id", "variant", "method", "file")


# --- streams -----------------------------------------------------------------------------------------------------------------


def _arriving(spark, folder, name):
    """A given table as a stream of files; the pattern takes a table of one file and a folder of files alike."""
    schema = parquet_table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.[p]arquet")


_SIMPLE = (
    "s1 AS (SELECT doc_id, {kind} AS doc_type, {cls} AS cls, round((doc_id % 100) / 100::DOUBLE * 100, 1) AS conf FROM documents), "
    "s2 AS (SELECT *, {mn} AS mn, {need} AS need, {typ} AS typ, {descr} AS descr FROM s1), "
    "s3 AS (SELECT *, conf >= mn AS verified, CASE doc_type WHEN 'national_id' THEN typ = 'id' WHEN 'driving_license' THEN typ = 'license' WHEN 'certificate' THEN typ IN ('certificate', 'degree') WHEN 'transcript' THEN typ = 'transcript' ELSE false END AS fit, "
    "CASE doc_type WHEN 'national_id' THEN 'id' WHEN 'driving_license' THEN 'license' WHEN 'certificate' THEN 'certificate, degree' WHEN 'transcript' THEN 'transcript' END AS expected FROM s2), "
    "simple AS (SELECT doc_id AS document_id, CASE WHEN verified AND conf >= need AND fit THEN 100 ELSE 0 END AS authenticity_score, CASE WHEN verified AND conf >= need AND fit THEN 'Verified' ELSE 'Fake' END AS status, "
    "CASE WHEN verified AND conf >= need AND fit THEN '' WHEN NOT verified THEN 'No trained model document class detected.' WHEN NOT fit AND expected IS NOT NULL THEN concat('Type mismatch: expected ', expected, ', got ', descr, ' (', typ, ') at ', format('{{:.1f}}', conf), '%.') "
    "ELSE concat('Low-confidence detection: ', descr, ' (', format('{{:.1f}}', conf), '%, required ', CAST(CAST(need AS INTEGER) AS VARCHAR), '%).') END AS issues FROM s3)"
).format(kind=pick(DOC_TYPES, "doc_id // 3", "duck"), cls=pick(CLASSES, "doc_id", "duck"), mn=_MIN.format(c="cls", d=25), need=_MIN.format(c="cls", d=60), typ=_TYPE.format(c="cls"), descr=_DESC.format(c="cls"))


def _in_parts(spark, rows, part, parts, name):
    """Yields a stream of files after each of the parts of the rows has arrived."""
    folder = run_dir(spark, name)
    for k in range(parts):
        rows.where(part == k).write.mode("append").parquet(folder)
        yield spark.readStream.schema(rows.schema).parquet(folder)


@R.add("t_verify_stream", VERIFY)
def t_verify_stream(spark, sf):
    """Documents arrive in two batches, in no order; the verifications kept beside the stream are those of the whole table."""
    at = F.lit("2026-06-01 00:00:00").cast("timestamp")
    view = VerificationView(TableSet.new(spark, "verification-view"), as_of=at, verified_at=at)
    view.start(derived(spark, sf, "portal_pages"), derived(spark, sf, "candidates"))
    docs = parquet_table(spark, sf, "documents")
    for stream in _in_parts(spark, docs, F.pmod(F.xxhash64("doc_id"), F.lit(2)), 2, "submitted"):
        view.follow(submissions(stream))
    return view.read().drop("verified_at")


@R.add("t_dup_stream", "SELECT md5(text) AS file_hash, min(doc_id) AS first_id, count(*) AS n_docs FROM documents WHERE text IS NOT NULL GROUP BY 1")
def t_dup_stream(spark, sf):
    """Documents arrive in three batches; of every file the first document and the number so far are kept."""
    return _duplicate_stream(spark, sf)[0].read("files").select("file_hash", "first_id", "n_docs")


@R.add("t_dup_found", "SELECT doc_id AS id, first AS earlier_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first FROM documents WHERE text IS NOT NULL) WHERE doc_id <> first")
def t_dup_found(spark, sf):
    """Every document whose file had arrived before, with the first document of that file."""
    return _duplicate_stream(spark, sf)[1].read().select("id", "earlier_id")


def _duplicate_stream(spark, sf):
    """Documents in order of id, a third at a time; (table of seen files, log of found duplicates)."""
    docs = parquet_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("file_hash"))
    low, high = docs.agg(F.percentile_approx("id", F.array(F.lit(1 / 3), F.lit(2 / 3)))).first()[0] or (0, 0)
    seen, found = TableSet.new(spark, "seen-files"), BatchLog.new(spark, "found-duplicates")
    for stream in _in_parts(spark, docs, (F.col("id") > low).cast("int") + (F.col("id") > high).cast("int"), 3, "arrivals"):
        streams.duplicates_on_arrival(stream, seen, found)
    return seen, found


@R.add("t_dup_window")
def t_dup_window(spark, sf):
    """First event per user and type within the watermark; state is bounded."""
    arriving = _arriving(spark, sf, "events").withColumn("file_hash", F.md5(F.concat_ws("|", F.col("user_id").cast("string"), "event_type")))
    log = BatchLog.new(spark, "unique-events")
    first = streams.unique_within(arriving, "ts", "10 minutes").select("event_id", "file_hash", "ts")
    streams.run_available(first, log.add, "unique", progress=log.progress)
    return log.read().drop("batch")


@R.add("t_pending", with_tables("SELECT id, doc_type FROM docs WHERE id NOT IN (SELECT document_id FROM ver WHERE status <> 'Pending')", "documents", "verifications"))
def t_pending(spark, sf):
    arriving = _arriving(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.expr(pick(DOC_TYPES, "doc_id", "spark")).alias("doc_type"))
    log = BatchLog.new(spark, "pending")
    streams.pending_on_arrival(arriving, derived(spark, sf, "verifications").where("status <> 'Pending'"), log)
    return log.read().select("id", "doc_type")


@R.add("t_status_counts", with_tables("SELECT status, count(*) AS n FROM ver GROUP BY status", "verifications"))
def t_status_counts(spark, sf):
    status = F.expr("case when o_orderkey % 19 = 0 then 'Pending' when o_orderstatus = 'F' then 'Fake' when o_orderstatus = 'O' then 'Suspicious' else 'Verified' end")
    tables = TableSet.new(spark, "counts")
    streams.live_counts(_arriving(spark, sf, "orders").select(status.alias("status")), tables)
    return tables.read("counts").select("status", "n")


# --- the whole verification -------------------------------------------------------------------------------------------------------


def submissions(docs):
    """Everything known about each document on arrival, from rows of documents; one in eleven has its link in the text only."""
    key = F.col("id")
    columns = {**table_expressions("documents"), **table_expressions("submissions")}
    docs = docs.selectExpr(*[f"{columns[c]} as {c}" for c in ("id", "candidate_id", "candidate_name", "text")]).withColumn("doc_type", F.expr(pick(DOC_TYPES, "id div 3", "spark")))
    link = link_text("id", "spark")
    software = F.expr(pick(SOFTWARE, "id", "spark"))
    exif = F.map_filter(F.create_map(F.lit("Software"), software, F.lit("Make"), F.lit("Acme")), lambda k, v: v != "")
    at = F.expr("timestamp_ntz'2024-02-01 00:00:00'")
    return docs.withColumns({
        "payload": F.when(key % 11 != 5, F.expr(link)), "exif": exif,
        "text": F.when(key % 11 != 5, F.col("text")).otherwise(F.concat_ws("\n", "text", F.expr(link))),
        "detections": F.array(capture.detection(F.expr(pick(CLASSES, "id", "spark")), (key % 97 + 3) / F.lit(100.0))),
        "file_size_kb": F.lit(200.0), "created": at, "modified": at, "pdf_failed": key % 50 == 49, "pdf_converted": key % 10 == 3,
        # the hash of the file itself, without the added heading
        "file_hash": F.md5(F.element_at(F.split(F.col("text"), "\n", 2), -1)),
    })


def verified(spark, sf):
    owners = derived(spark, sf, "candidates").select("id", "full_name")
    return verify(submissions(parquet_table(spark, sf, "documents")), derived(spark, sf, "portal_pages"), owners, as_of=F.lit("2026-06-01 00:00:00").cast("timestamp"))


@R.add("verify_documents", VERIFY)
def verify_documents(spark, sf):
    """Verification row of every document, all checks."""
    rows = verification_rows(verified(spark, sf), F.lit("2026-06-01 00:00:00").cast("timestamp"))
    return rows.drop("verified_at")


@R.add("candidate_trust", TRUST)
def candidate_trust(spark, sf):
    """Flagship: all checks on every document, fused, then one report per candidate."""
    rows = verification_rows(verified(spark, sf))
    report = listings.candidate_report(derived(spark, sf, "candidates").select("id", "full_name"), rows)
    return report.select("id", "full_name", "n_docs", "avg_score", "overall_status", "recommendation")


_CORE = (
    *PAIRS,
    _SIMPLE,
    "core AS (SELECT s.document_id, dp.candidate_id, CASE WHEN s.authenticity_score = 0 THEN 0 WHEN coalesce(o.candidate_id <> dp.candidate_id, false) THEN 30 ELSE 100 END AS score, "
    "CASE WHEN s.authenticity_score = 0 OR coalesce(o.candidate_id <> dp.candidate_id, false) THEN 'Fake' ELSE 'Verified' END AS status "
    "FROM simple s JOIN dp ON dp.id = s.document_id LEFT JOIN hd o ON o.id = dp.other_id)",
)


@R.add("candidate_trust_core", with_tables(
    "SELECT c.id, count(core.document_id) AS n_docs, coalesce(CAST(round(avg(score)) AS INTEGER), 0) AS avg_score, "
    "CASE WHEN coalesce(bool_or(status = 'Fake'), false) THEN 'Fake' ELSE 'Verified' END AS overall_status FROM cand c LEFT JOIN core ON core.candidate_id = c.id GROUP BY c.id",
    "candidates", extra=_CORE))
def candidate_trust_core(spark, sf):
    """Detector verdict and duplicate search fused, then the report per candidate."""
    from credence.operators.duplicates import duplicate_outcome, duplicate_pairs
    from credence.plans.listing_queries import hashed_documents

    docs = parquet_table(spark, sf, "documents")
    cls = F.expr(pick(CLASSES, "doc_id", "spark"))
    rows = docs.select("doc_id", F.expr(pick(DOC_TYPES, "doc_id div 3", "spark")).alias("doc_type"), F.array(capture.detection(cls, (F.col("doc_id") % 100) / F.lit(100.0))).alias("detections"))
    dup = duplicate_outcome(duplicate_pairs(hashed_documents(spark, sf))).select(F.col("id").alias("doc_id"), "candidate_id", "duplicate")
    rows = capture.with_detect_check(rows).join(dup, "doc_id").withColumns({
        "pdf_failed": F.lit(False), "pdf_converted": F.lit(False), "candidate_name": F.lit(""), "link": no_link(), "printed": no_printed_name(),
        "metadata": F.struct(F.lit(None).cast("string").alias("software"), F.lit(False).alias("software_suspicious"))})
    ver = fuse(rows).select("candidate_id", F.col("verdict.score").alias("authenticity_score"), F.col("verdict.status").alias("status"))
    report = listings.candidate_report(derived(spark, sf, "candidates").select("id"), ver)
    return report.select("id", "n_docs", "avg_score", "overall_status")


