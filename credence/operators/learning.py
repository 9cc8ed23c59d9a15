"""Training set preparation, the forest classifier, cross validation and scoring with Spark ML."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions.hotkeys import numbered
from credence.operators import evaluation
from credence.operators.forest import DealtForest
from credence.session import cut_lineage, run_dir
from credence.sources.sinks import write_json

TREES, DEPTH, SEED = 300, 12, 42


def shuffled_rank(rows: DataFrame, key: str, label: str = "label", seed: int = SEED, within: tuple[str, ...] = ()) -> DataFrame:
    """Position of each row in a fixed random order within its label (and part ``within``, which are few too), and the label's size.

    The order is that of a digest of key and seed; labels are few, so ranks come from range
    partitions instead of one task per label.
    """
    keyed = rows.withColumn("_order", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))))
    ranked = numbered(keyed, [F.col("_order"), F.col(key)], "rank", by=[*within, label]).drop("_order")
    sizes = ranked.groupBy(*within, label).agg(F.count(F.lit(1)).alias("label_size"))
    return ranked.join(F.broadcast(sizes), [*within, label])  # one row per label and part


def with_folds(rows: DataFrame, key: str, folds: int = 5, label: str = "label", seed: int = SEED) -> DataFrame:
    ranked = shuffled_rank(rows, key, label, seed)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % folds).cast("int")).drop("rank", "label_size")


def with_split(rows: DataFrame, key: str, test_share: float = 0.2, label: str = "label", seed: int = SEED) -> DataFrame:
    """Stratified hold-out flag."""
    ranked = shuffled_rank(rows, key, label, seed)
    return ranked.withColumn("is_test", F.col("rank") <= F.round(F.col("label_size") * test_share)).drop("rank", "label_size")


def balanced(rows: DataFrame, key: str, label: str = "label", seed: int = SEED, within: tuple[str, ...] = ()) -> DataFrame:
    """Real rows (label 1) repeated until they are as many as the fakes (of their part); never reduced.

    Copies are dealt out evenly in shuffled order, so the result has exactly the wanted size.
    """
    ranked = shuffled_rank(rows, key, label, seed, within)
    fakes = rows.groupBy(*within, F.lit(1).alias("_one")).agg(F.count_if(F.col(label) == 0).alias("_fakes"))
    joined = ranked.withColumn("_one", F.lit(1)).join(F.broadcast(fakes), [*within, "_one"])  # one row per part
    n, want = F.col("label_size"), F.col("_fakes")
    copies = F.when(
        (F.col(label) == 1) & (n < want), F.floor(want / n) + F.when(F.col("rank") <= want % n, 1).otherwise(0)
    ).otherwise(1)
    out = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    return out.drop("rank", "label_size", "_fakes", "_one")


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns to mean 0 and population deviation 1; a constant column becomes 0."""
    stats = rows.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns], F.lit(1).alias("_one"))
    joined = rows.withColumn("_one", F.lit(1)).join(F.broadcast(stats), "_one")  # one row
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return joined.withColumns(scaled).select(*rows.columns)


def with_class_weight(rows: DataFrame, label: str = "label", within: tuple[str, ...] = ()) -> DataFrame:
    """Weight n / (2 * rows of the label), n and rows counted per part ``within``."""
    sizes = rows.groupBy(*within, label).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.groupBy(*within, F.lit(1).alias("_one")).agg(F.count(F.lit(1)).alias("_all"))
    joined = rows.join(F.broadcast(sizes), [*within, label]).withColumn("_one", F.lit(1)).join(F.broadcast(total), [*within, "_one"])
    return joined.withColumn("weight", F.col("_all") / (2 * F.col("_n"))).drop("_n", "_all", "_one")


def forest(features: list[str], trees: int = TREES, depth: int = DEPTH, seed: int = SEED, dealt: bool = False) -> Pipeline:
    return Pipeline(stages=[assembler(features), *scaled_forest(trees, depth, seed, dealt)])


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="keep")


def scaled_forest(trees: int = TREES, depth: int = DEPTH, seed: int = SEED, dealt: bool = False) -> list:
    """Scaling and the forest; ``dealt`` deals trees to tasks instead of rows (:mod:`credence.operators.forest`), with other random draws."""
    scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)
    if dealt:
        return [scaler, DealtForest(trees, depth, seed)]
    return [
        scaler,
        RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed,
                               minInstancesPerNode=1),
    ]


def train(rows: DataFrame, features: list[str], **options) -> PipelineModel:
    """Fits on a checkpointed copy: the forest passes over its input once per tree level."""
    return forest(features, **options).fit(cut_lineage(with_class_weight(rows).select("label", "weight", *features)))


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds prediction and the probability of the predicted class in percent."""
    scored = model.transform(rows)
    top = F.array_max(vector_to_array("probability"))
    return scored.withColumns({"prediction": F.col("prediction").cast("int"), "probability": F.round(top * 100, 1)}).drop("_raw", "features", "rawPrediction")


def hold_out(rows: DataFrame, key: str, leaky: bool = False) -> tuple[DataFrame, DataFrame]:
    """Training part, balanced, and hold-out part.

    By default the split comes first and only the training part is balanced.  ``leaky`` balances
    first, so copies of a real row can be on both sides.
    """
    if leaky:
        copies = balanced(rows, key).withColumn("_key", F.concat_ws("#", F.col(key).cast("string"), F.col("copy").cast("string")))
        split = with_split(copies, "_key").drop("_key")
        return split.where("not is_test"), split.where("is_test")
    split = cut_lineage(with_split(rows, key))
    return balanced(split.where("not is_test"), key), split.where("is_test")


def train_and_hold_out(rows: DataFrame, features: list[str], key: str, leaky: bool = False, **options) -> tuple[PipelineModel, DataFrame]:
    """Model and its hold-out predictions."""
    fit_on, test = hold_out(rows, key, leaky)
    model = train(fit_on, features, **options)
    return model, score(model, test)


def fold_training_sets(dealt: DataFrame, key: str, folds: int = 5) -> DataFrame:
    """The rows that each fold's model is fitted on, balanced, all in one frame: ``for_fold`` names the fold held out."""
    sets = dealt.withColumn("for_fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("for_fold <> fold")
    return balanced(sets, key, within=("for_fold",))


def out_of_fold(rows: DataFrame, features: list[str], key: str, folds: int = 5, side_by_side: int = 5, **options) -> DataFrame:
    """(key, label, fold, prediction, probability): every row judged by the model of the folds it is not in.

    Folds are dealt among the rows given and each training part is balanced after that, so copies of a
    row are never on both sides.  The assembled matrix is made once; all training sets are written by the fold
    held out, so a fit reads only its own.  The loop is over folds, ``side_by_side`` of which run at a time; the
    work inside is distributed.
    """
    matrix = assembler(features).transform(rows).select(key, "label", "_raw")
    dealt = cut_lineage(with_folds(matrix, key, folds))
    path = run_dir(rows.sparkSession, "fold-sets")
    sets = with_class_weight(fold_training_sets(dealt, key, folds), within=("for_fold",)).select("label", "weight", "_raw", "for_fold")
    sets.write.partitionBy("for_fold").parquet(path)

    def judge(k: int) -> DataFrame | None:
        fit_on = rows.sparkSession.read.schema(sets.schema).parquet(path).where(F.col("for_fold") == k)
        if fit_on.isEmpty():  # nothing but this fold
            return None
        model = Pipeline(stages=scaled_forest(dealt=True, **options)).fit(fit_on)
        return score(model, dealt.where(F.col("fold") == k))

    with ThreadPoolExecutor(side_by_side) as pool:
        judged = [j for j in pool.map(inheritable_thread_target(rows.sparkSession)(judge), range(folds)) if j is not None]
    if not judged:
        return dealt.select(key, "label", "fold", F.lit(None).cast("int").alias("prediction"), F.lit(None).cast("double").alias("probability")).limit(0)
    out = judged[0]
    for more in judged[1:]:
        out = out.unionByName(more)
    return out.select(key, "label", "fold", "prediction", "probability")


def fold_accuracies(judged: DataFrame) -> DataFrame:
    """(fold, accuracy) of out-of-fold predictions."""
    return judged.groupBy("fold").agg(F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("accuracy"))


def cross_validated(rows: DataFrame, features: list[str], key: str, folds: int = 5, **options) -> DataFrame:
    """(fold, accuracy) of :func:`out_of_fold`."""
    return fold_accuracies(out_of_fold(rows, features, key, folds, **options))


def published_model(rows: DataFrame, features: list[str], key: str, folder: str, folds: int = 5, **options) -> tuple[DataFrame, DataFrame]:
    """Trains, stores the model below ``folder``, and measures the model as it is read back: (hold-out predictions, metrics).

    The metrics are also written below ``folder`` as JSON, beside the model they belong to.
    """
    fit_on, test = hold_out(rows, key)
    train(fit_on, features, dealt=True, **options).write().save(f"{folder}/model")
    predictions = cut_lineage(score(PipelineModel.load(f"{folder}/model"), test).select(key, "label", "prediction", "probability"))
    measured = cut_lineage(evaluation.metrics(predictions, cross_validated(rows, features, key, folds, **options)))
    write_json(measured, f"{folder}/metrics")
    return predictions, measured


def importances(model: PipelineModel, features: list[str]) -> DataFrame:
    """(feature, importance in percent), most important first."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, round(float(v) * 100, 2)) for f, v in zip(features, values)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
