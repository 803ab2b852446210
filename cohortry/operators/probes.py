"""Probes on pooled vectors with pyspark.ml: out-of-fold predictions with probabilities over all classes."""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cohorts


def linear_probe(max_iter: int = 100) -> Estimator:
    return LogisticRegression(featuresCol="features", labelCol="code", family="multinomial", maxIter=max_iter, regParam=1e-3)


def mlp_probe(dims: int, classes: int, hidden: int = 256, max_iter: int = 100, seed: int = 42) -> Estimator:
    """One hidden layer. Its units are sigmoid ones, so figures compare with a ReLU network's only statistically."""
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol="code", layers=[dims, hidden, classes], maxIter=max_iter, seed=seed)


def stacked(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def fit_predict(train: DataFrame, test: DataFrame, estimator: Estimator) -> DataFrame:
    """(uid, y_true, y_pred, proba) of ``test`` under a model of ``train``; both have uid, code and features."""
    scored = estimator.fit(train).transform(test)
    return scored.select("uid", F.col("code").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"), vector_to_array("probability").alias("proba"))


def cross_validated(df: DataFrame, estimator: Estimator, k: int = 5, seed: int = 42, balance: bool = False) -> DataFrame:
    """Every row predicted once, by the model of the other folds. ``df`` has uid, label and embedding.

    Codes come from all labels, so every fold's probabilities span all classes. Classes of the training rows are
    oversampled to the largest if ``balance``.
    """
    codes = cohorts.label_codes(df)
    rows = stacked(cohorts.folds(df.join(F.broadcast(codes), "label"), k, seed)).withColumn("code", F.col("code").cast("double"))
    out = None
    for fold in range(k):  # k is a constant of the protocol
        train = rows.where(F.col("fold") != fold)
        part = fit_predict(cohorts.oversample(train) if balance else train, rows.where(F.col("fold") == fold), estimator).withColumn("fold", F.lit(fold))
        out = part if out is None else out.unionByName(part)
    return out


def centre_effect(df: DataFrame, centres: list[str], estimator: Estimator, k: int = 5) -> DataFrame:
    """Out-of-fold predictions of the cohort of origin itself, for two cohorts or more."""
    chosen = df.where(F.col("dataset").isin(centres)).withColumn("label", F.col("dataset"))
    present = {r["label"] for r in chosen.select("label").distinct().limit(len(centres) + 1).collect()}
    if len(present) < 2:
        raise ValueError("a centre effect needs two cohorts or more")
    return cross_validated(chosen, estimator, k)
