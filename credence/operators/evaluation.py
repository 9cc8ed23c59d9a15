"""Classifier evaluation as aggregates over (label, prediction): 1 is real, 0 is fake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(label: int, prediction: int) -> Column:
    return F.count_if((F.col("label") == label) & (F.col("prediction") == prediction))


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        _cell(0, 0).alias("true_fake"), _cell(0, 1).alias("false_real"), _cell(1, 0).alias("false_fake"), _cell(1, 1).alias("true_real")
    )


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def detection_rates(predictions: DataFrame) -> DataFrame:
    """Share of fakes and of real documents recognised, in percent."""
    c = confusion(predictions)
    tf, fr, ff, tr = (F.col(n) for n in ("true_fake", "false_real", "false_fake", "true_real"))
    return c.select(
        F.round(_share(tf, tf + fr) * 100, 2).alias("fake_detection_rate"),
        F.round(_share(tr, ff + tr) * 100, 2).alias("real_detection_rate"),
    )


def accuracy(predictions: DataFrame) -> DataFrame:
    hit = (F.col("label") == F.col("prediction")).cast("int")
    return predictions.agg(F.round(F.avg(hit) * 100, 2).alias("accuracy"))


def class_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, macro and weighted averages; 0 where undefined."""
    c = confusion(predictions)
    cell = {(0, 0): "true_fake", (0, 1): "false_real", (1, 0): "false_fake", (1, 1): "true_real"}
    rows = []
    for k, name in ((0, "Fake"), (1, "Real")):
        hit, support = F.col(cell[(k, k)]), F.col(cell[(k, 0)]) + F.col(cell[(k, 1)])
        predicted = F.col(cell[(0, k)]) + F.col(cell[(1, k)])
        p, r = _share(hit, predicted), _share(hit, support)
        rows.append(F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                             _share(2 * p * r, p + r).alias("f1"), support.alias("support")))
    both = c.select(F.array(*rows).alias("k"))
    a, b = F.col("k")[0], F.col("k")[1]
    total = a["support"] + b["support"]

    def average(name, weigh):
        value = lambda m: weigh(a[m], b[m])
        return F.struct(F.lit(name).alias("class"), value("precision").alias("precision"), value("recall").alias("recall"),
                        value("f1").alias("f1"), total.alias("support"))

    macro = average("macro avg", lambda x, y: (x + y) / 2)
    weighted = average("weighted avg", lambda x, y: _share(x * a["support"] + y * b["support"], total))
    out = both.select(F.explode(F.concat("k", F.array(macro, weighted))).alias("r")).select("r.*")
    return out.withColumns({m: F.round(m, 4) for m in ("precision", "recall", "f1")})


def fold_stats(scores: DataFrame, score: str = "accuracy") -> DataFrame:
    """Mean and population deviation of fold accuracies (fractions), in percent."""
    return scores.agg(F.round(F.avg(score) * 100, 2).alias("cv_mean"), F.round(F.stddev_pop(score) * 100, 2).alias("cv_std"))


def fake_set_summary(predictions: DataFrame) -> DataFrame:
    """Evaluation on a set of fakes only."""
    total, hit = F.count(F.lit(1)), F.count_if(F.col("prediction") == 0)
    return predictions.agg(
        total.alias("total_fake"), hit.alias("identified_fake"), (total - hit).alias("missed_fake"),
        F.round(_share(hit, total) * 100, 2).alias("detection_rate"),
    )


def metrics(predictions: DataFrame, folds: DataFrame) -> DataFrame:
    """One row with every published metric of a model."""
    samples = predictions.agg(
        F.count(F.lit(1)).alias("total_samples"), F.count_if(F.col("label") == 1).alias("real_samples"),
        F.count_if(F.col("label") == 0).alias("fake_samples"),
        F.round(F.avg((F.col("label") == F.col("prediction")).cast("int")) * 100, 2).alias("accuracy"),
        _cell(0, 0).alias("true_fake"), _cell(0, 1).alias("false_real"), _cell(1, 0).alias("false_fake"), _cell(1, 1).alias("true_real"),
    )
    tf, fr, ff, tr = (F.col(n) for n in ("true_fake", "false_real", "false_fake", "true_real"))
    rated = samples.withColumns({
        "fake_detection_rate": F.round(_share(tf, tf + fr) * 100, 2), "real_detection_rate": F.round(_share(tr, ff + tr) * 100, 2),
    })
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(rated).join(one(fold_stats(folds)), "_one").drop("_one")
