"""Learners over feature vectors, on Spark's own ML library."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import trees as T
from loomwork.operators.features import FEATURES
from loomwork.session import materialize, shared_dir

#: Rows up to which a task holds all of them to fit trees, at some 60 bytes each.
IN_TASK = 8_000_000


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds weight n / (2 * rows of the class), as balanced classes ask."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = df.count()
    return df.join(F.broadcast(sizes), label).withColumn("weight", F.lit(float(total)) / (2 * F.col("_n"))).drop("_n")


def logistic(features: list[str] | None = None, iterations: int = 1000) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features or FEATURES, outputCol="features"), LogisticRegression(maxIter=iterations, weightCol="weight", labelCol="label")])


def forest(features: list[str] | None = None, trees: int = 300, depth: int = 10) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features or FEATURES, outputCol="features"), RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=42, labelCol="score")])


def boosted(features: list[str] | None = None, rounds: int = 300, depth: int = 6) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features or FEATURES, outputCol="features"), GBTRegressor(maxIter=rounds, maxDepth=depth, stepSize=0.05, seed=42, labelCol="score")])


def score_pairs(rows: DataFrame, group: str, features: list[str]) -> DataFrame:
    """(features, label, weight) of every two different scores of a group: the difference of the mean feature vectors of
    the rows that have them, weighted by the pairs of rows it stands for. Every row of a group with two scores takes part,
    and equal scores form no pair. Without an intercept a pair and its mirror image have the same loss, so each is listed
    one way round, half of them with label 0. Pairs grow with the square of a group's different scores, not of its rows."""
    levels = rows.groupBy(group, "score").agg(*[F.avg(f).alias(f) for f in features], F.count("*").alias("_n"))
    # few bytes and many pairs: without a stated number the adaptive planner would give a few tasks all of them
    levels = levels.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, group)
    high, low = levels.alias("high"), levels.alias("low")
    pairs = high.join(low, (F.col(f"high.{group}") == F.col(f"low.{group}")) & (F.col("high.score") > F.col("low.score")))
    label = F.pmod(F.xxhash64(f"high.{group}", "high.score", "low.score"), F.lit(2)).cast("double")
    weight = F.col("high._n").cast("double") * F.col("low._n")
    pairs = pairs.select(*[(F.col(f"high.{f}") - F.col(f"low.{f}")).alias(f) for f in features], label.alias("label"), weight.alias("weight"))
    return pairs.select(*[F.when(F.col("label") == 1, F.col(f)).otherwise(-F.col(f)).alias(f) for f in features], "label", "weight")


def pairwise_ranker(rows: DataFrame, group: str, features: list[str] | None = None) -> PipelineModel:
    """A linear ranker: logistic regression on differences of feature vectors of two scores of one group, see
    score_pairs."""
    features = features or FEATURES
    stages = [VectorAssembler(inputCols=features, outputCol="features"), LogisticRegression(fitIntercept=False, weightCol="weight", labelCol="label")]
    return Pipeline(stages=stages).fit(score_pairs(rows, group, features))


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    out = model.transform(rows.drop("label") if "label" in rows.columns else rows)
    if "probability" in out.columns:
        # a ranker has no intercept; far from 0 its probabilities round to 1 and would tie, its margins do not
        by = "probability" if model.stages[-1].getOrDefault("fitIntercept") else "rawPrediction"
        out = out.withColumn("prediction", vector_to_array(by)[1])
    return out


def compare(train: DataFrame, test: DataFrame, score: str) -> DataFrame:
    """(model, label, prediction) of the four learners on test, each with the whole number of rounds, trees and iterations
    that its function has as default. While train has at most IN_TASK rows, which is checked, its trees are those of
    operators.trees, fitted inside of tasks; beyond that Spark's. The ranker lists no pairs."""
    spark = train.sparkSession
    shared_dir(spark)  # boosting checkpoints there, else its lineage grows with the rounds
    # few bytes and many rounds over them: without a stated number the adaptive planner would give one task all rows
    train = train.repartition(spark.sparkContext.defaultParallelism, "id").withColumn("label", (F.col(score) >= 0.5).cast("double"))
    train = materialize(train)
    label = (F.col(score) >= 0.5).cast("double").alias("label")
    fitted = {"logistic": logistic().fit(balanced(train, "label"))}
    few = 0 < train.count() <= IN_TASK
    if not few:
        fitted |= {"forest": forest().fit(train), "boosted": boosted().fit(train)}
    out = None
    for name, model in fitted.items():
        rows = predict(model, test).select(F.lit(name).alias("model"), label, F.col("prediction").cast("double").alias("prediction"))
        out = rows if out is None else out.unionByName(rows)
    beta = T.fit_ranker(train.withColumn("score", F.col(score)), "resume_id", FEATURES)
    margin = sum((F.lit(float(w)) * F.col(f) for f, w in zip(FEATURES, beta, strict=True)), F.lit(0.0))
    out = out.unionByName(test.select(F.lit("ranker").alias("model"), label, margin.alias("prediction")))
    if few:
        one, more = forest().getStages()[-1], boosted().getStages()[-1]
        sizes = (one.getNumTrees(), one.getMaxDepth()), (more.getMaxIter(), more.getMaxDepth(), more.getStepSize())
        models = spark.sparkContext.broadcast(T.fit_trees(train.withColumn("score", F.col(score)), FEATURES, *sizes))

        def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            splits, trees, rounds = models.value
            for pdf in batches:
                rows = T.Rows((pdf[f].to_numpy(np.float64) for f in FEATURES), splits)
                for name, values in (("forest", T.predict_trees(rows, trees) / len(trees)), ("boosted", T.predict_trees(rows, rounds))):
                    yield pd.DataFrame({"model": name, "label": pdf["label"], "prediction": values})

        dealt = test.select(label, *FEATURES).repartition(4 * spark.sparkContext.defaultParallelism)
        out = out.unionByName(dealt.mapInPandas(guess, "model string, label double, prediction double"))
    return materialize(out)  # metrics read it several times


def save_model(model: PipelineModel, path: str, about: dict) -> None:
    """The fitted pipeline and, beside it, what is known about it."""
    model.write().overwrite().save(f"{path}/model")
    SparkSession.active().createDataFrame([(json.dumps(about, sort_keys=True),)], "about string").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load_model(path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(SparkSession.active().read.json(f"{path}/about").first()["about"])
