"""Layer weights learnt from labelled samples and scores built from them."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope.functions.arrays import array_mean, weighted_sum
from answerscope.operators.evaluate import auroc, correctness, pearson, separation
from answerscope.operators.sampling import with_features

# A weight counts as non-zero above this size.
NONZERO = 1e-6

# Share of the elastic-net mix per penalty name.
PENALTY_MIX = {"l1": 1.0, "l2": 0.0}


def features_and_labels(
    results: DataFrame, multi_reference: bool = False, stem: bool = True, id_col: str = "id"
) -> DataFrame:
    """(id, layer_scores, label, similarity) for records that have layer scores."""
    return correctness(with_features(results), "rouge", multi_reference, stem).select(
        id_col, "layer_scores", "similarity", "label"
    )


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def fit_layer_weights(
    train: DataFrame,
    penalty: str = "elasticnet",
    C: float = 1.0,
    l1_ratio: float = 0.5,
    max_iter: int = 1000,
    features: str = "layer_scores",
    label: str = "label",
) -> LogisticRegressionModel:
    """Logistic regression on unscaled layer scores with an unpenalised intercept.

    ``C`` weighs the summed loss against the penalty; the equivalent weight on the mean
    loss is 1 / (C·n), n the number of training rows. Only the coefficients (one per
    layer) reach the driver.
    """
    if penalty != "elasticnet" and penalty not in PENALTY_MIX:
        raise ValueError("penalty is 'l1', 'l2' or 'elasticnet'")
    mix = PENALTY_MIX.get(penalty, l1_ratio)
    rows = train.select(array_to_vector(F.col(features).cast("array<double>")).alias("x"), F.col(label).cast("double").alias("y"))
    rows = rows.persist()
    n = rows.count()
    estimator = LogisticRegression(
        featuresCol="x", labelCol="y", regParam=1.0 / (C * n), elasticNetParam=mix,
        standardization=False, maxIter=max_iter, tol=1e-12, fitIntercept=True,
    )
    try:
        return estimator.fit(rows)
    finally:
        rows.unpersist()


def predictions(
    model: LogisticRegressionModel, df: DataFrame, keep: list[str], features: str = "layer_scores"
) -> DataFrame:
    """``probability`` of the positive class and the predicted label next to ``keep``."""
    x = df.withColumn("x", array_to_vector(F.col(features).cast("array<double>")))
    scored = model.setFeaturesCol("x").transform(x)
    return scored.select(
        *keep,
        vector_to_array("probability")[1].alias("probability"),
        F.col("prediction").cast("int").alias("predicted"),
    )


def fit_metrics(model: LogisticRegressionModel, df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Accuracy and AUROC of the probabilities per split."""
    scored = predictions(model, df, [split, label]).withColumnRenamed("probability", "score")
    scored = scored.withColumnRenamed(label, "label") if label != "label" else scored
    acc = scored.groupBy(split).agg(
        F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    )
    return acc.join(auroc(scored, [split]), split)


def weights_of(model: LogisticRegressionModel) -> list[float]:
    return [float(w) for w in model.coefficients.toArray()]


def weighted_score(features: Column, weights: list[float]) -> Column:
    """Σ w_l·E_l, without the intercept."""
    return weighted_sum(features, weights)


def mean_layer_score(features: Column, orientation: int = 1) -> Column:
    """Mean over layers; ``orientation=-1`` turns it so that larger means more reliable."""
    return array_mean(features) * F.lit(float(orientation))


def weight_stats(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Per run: weights away from zero, min, max, mean and population deviation.

    ``weights`` is long: keys..., layer, weight.
    """
    w = F.col("weight")
    return weights.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_features"),
        F.sum((F.abs(w) > NONZERO).cast("int")).cast("bigint").alias("num_nonzero"),
        F.min(w).alias("min_weight"),
        F.max(w).alias("max_weight"),
        F.avg(w).alias("mean_weight"),
        F.stddev_pop(w).alias("std_weight"),
    )


def weighted_vs_mean(df: DataFrame, weights: list[float], orientation: int = 1) -> DataFrame:
    """Learnt weights against the plain layer mean, for both correctness measures.

    ``df``: layer_scores, rouge_score, y_rouge, sim_score, y_sim. One row per measure with
    AUROC, threshold and PCC of both scores and their difference in AUROC. Held-out rows
    carry features and labels together, so nothing is paired by position.
    """
    f = F.col("layer_scores")
    scored = df.select(
        weighted_score(f, weights).alias("weighted"),
        mean_layer_score(f, orientation).alias("baseline"),
        F.array(
            F.struct(F.lit("rouge").alias("measure"), F.col("rouge_score").alias("similarity"), F.col("y_rouge").alias("label")),
            F.struct(F.lit("cosine").alias("measure"), F.col("sim_score").alias("similarity"), F.col("y_sim").alias("label")),
        ).alias("_m"),
    )
    flat = scored.select("weighted", "baseline", F.explode("_m").alias("m")).select("m.*", "weighted", "baseline")
    rows = flat.unpivot(["measure", "similarity", "label"], ["weighted", "baseline"], "kind", "score")
    keys = ["measure", "kind"]
    each = separation(rows, keys, size_bound=df.count() * 4).join(pearson(rows, keys), keys)

    def of(kind: str, value: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(value)))

    return each.groupBy("measure").agg(
        *[of(k, v).alias(f"{name}_{k}") for name, v in (("auc", "auroc"), ("threshold", "threshold"), ("pcc", "pcc")) for k in ("weighted", "baseline")],
        (of("weighted", "auroc") - of("baseline", "auroc")).alias("improvement"),
    )
