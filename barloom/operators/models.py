"""Prediction of labels from factors with Spark ML."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.numeric import safe_corr
from barloom.operators.evaluate import fill_null, split_column
from barloom.operators.timeseries import DATE, INSTRUMENT


def boosted_trees(rounds: int = 1000, depth: int = 6) -> GBTRegressor:
    """Gradient-boosted trees of up to 64 leaves on the train rows, up to `rounds` of them; fit() stops them by the valid ones."""
    return GBTRegressor(featuresCol="features", labelCol="label", predictionCol="predict", stepSize=0.05, maxDepth=depth, maxIter=rounds, featureSubsetStrategy="0.8", subsamplingRate=0.8, seed=42)


def stop_round(losses: Iterable[float], patience: int) -> int:
    """The round (from 1) of least loss before `patience` rounds in a row that bring no lower one."""
    best, least = 0, float("inf")
    for i, loss in enumerate(losses, 1):
        if loss < least:
            best, least = i, loss
        elif i - best >= patience:
            break
    return max(best, 1)


def first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model of the first n rounds of another one."""
    if n >= model.getNumTrees:
        return model
    spark = SparkSession.active()
    java, gateway = model._java_obj, spark.sparkContext._gateway
    trees = gateway.new_array(spark._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for i in range(n):
        trees[i], weights[i] = java.trees()[i], java.treeWeights()[i]
    cut = GBTRegressionModel(spark._jvm.org.apache.spark.ml.regression.GBTRegressionModel(f"{model.uid}_{n}", trees, weights))
    return cut.setFeaturesCol(model.getFeaturesCol()).setPredictionCol(model.getPredictionCol())


def linear(reg: float = 0.0) -> LinearRegression:
    """Least squares, from the normal equations of one pass; `reg` shrinks coefficients of features that go together."""
    return LinearRegression(featuresCol="features", labelCol="label", predictionCol="predict", regParam=reg, solver="normal")


def prepare(df: DataFrame, features: Iterable[str], train_end: str, valid_end: str) -> DataFrame:
    """date, instrument, features, label and split of every row with a label; null and NaN features become 0, the mean of standardized ones."""
    features = list(features)
    rows = df.where(F.col("label").isNotNull() & ~F.isnan("label"))
    rows = rows.select(DATE, INSTRUMENT, "label", *[F.nanvl(fill_null(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    end = lambda d: F.to_date(F.lit(d))
    rows = rows.withColumn("split", split_column(end(train_end), end(valid_end)))
    return VectorAssembler(inputCols=features, outputCol="features").transform(rows).select(DATE, INSTRUMENT, "features", "label", "split")


def fit(prepared: DataFrame, estimator=None, patience: int = 30):
    """Trains on the train rows. Boosted trees then end at the round of least squared loss on the valid rows, found with `patience`.

    Trees are trained for twice as many rounds as patience lasts, and anew for twice as many again while it has not run
    out: the first trees of a longer training are those of a shorter one, so the model is the one that watching every
    round would give. Without valid rows all rounds are trained and stay.
    """
    estimator = estimator or boosted_trees()
    # every level of a tree is a job over all rows: one task for each core is enough
    cores, rows = prepared.sparkSession.sparkContext.defaultParallelism, prepared
    if prepared.rdd.getNumPartitions() > cores:
        rows = prepared.coalesce(cores)
    train, valid = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "valid")
    if not isinstance(estimator, GBTRegressor) or valid.isEmpty():
        return estimator.fit(train)
    most, rounds = estimator.getMaxIter(), 2 * patience
    while True:
        rounds = min(rounds, most)
        model = estimator.copy({estimator.maxIter: rounds}).fit(train)
        best = stop_round(model.evaluateEachIteration(valid, "squared"), patience)
        if rounds == most or rounds - best >= patience:
            return first_trees(model, best)
        rounds *= 2


def fit_predict(df: DataFrame, features: Iterable[str], train_end: str, valid_end: str, estimator=None) -> DataFrame:
    """date, instrument, predict of the test rows; ValueError if there are none."""
    prepared = prepare(df, features, train_end, valid_end).persist()
    try:
        if prepared.where("split = 'test'").isEmpty():
            raise ValueError("no test rows")
        model = fit(prepared, estimator)
    finally:
        prepared.unpersist()
    return model.transform(prepared.where("split = 'test'")).select(DATE, INSTRUMENT, "predict")


def importances(model, features: Iterable[str], spark) -> DataFrame:
    """feature, importance of a tree model, or the size of a linear one's coefficients."""
    weights = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    # a model cut to its first trees ends its vector at the last feature that they use
    found = dict(enumerate(weights.toArray()))
    return spark.createDataFrame([(f, abs(float(found.get(i, 0.0)))) for i, f in enumerate(features)], "feature string, importance double")


def top_importances(table: DataFrame, n: int = 20) -> DataFrame:
    return table.orderBy(F.desc("importance"), "feature").limit(n)


def validation_ic(predicted: DataFrame) -> DataFrame:
    """One row: the correlation of predict and label over all valid rows."""
    return predicted.where("split = 'valid'").agg(safe_corr(F.col("predict"), F.col("label")).alias("ic"))


