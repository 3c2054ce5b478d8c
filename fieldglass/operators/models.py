"""Learned readings: logistic and multinomial models, two-way clustering with a discriminant, held-out likelihood."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _vectors(df: DataFrame, features: str) -> DataFrame:
    return df.withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))


def view_model(df: DataFrame, features: str, label: str, penalty: float = 1.0) -> LogisticRegressionModel:
    """Logistic regression with an L2 penalty on standardised features; the intercept is free."""
    rows = _vectors(df, features).withColumn("_y", F.col(label).cast("double"))
    return LogisticRegression(featuresCol="_v", labelCol="_y", regParam=penalty / max(1, df.count()), elasticNetParam=0.0, standardization=True,
        maxIter=200, tol=1e-9).fit(rows)


def class_model(df: DataFrame, features: str, label: str, penalty: float = 1.0) -> LogisticRegressionModel:
    """Multinomial regression in which every class has the same weight."""
    n, classes = df.count(), df.select(label).distinct().count()
    rows = _vectors(df, features).withColumn("_y", F.col(label).cast("double")).withColumn("_w",
        F.lit(n / max(1, classes)) / F.count("*").over(Window.partitionBy(label)))
    return LogisticRegression(featuresCol="_v", labelCol="_y", weightCol="_w", family="multinomial", regParam=penalty / max(1, n), maxIter=200,
        tol=1e-9).fit(rows)


def read_model(model: LogisticRegressionModel, df: DataFrame, features: str, name: str = "p") -> DataFrame:
    """df with the model's class probabilities (array)."""
    out = model.transform(_vectors(df, features))
    return out.select(*df.columns, vector_to_array("probability").alias(name))


def held_out_likelihood(df: DataFrame, features: str, label: str, order: str, folds: int = 5) -> float:
    """Mean over classes of the mean log likelihood of rows that their fold's model hasn't seen; folds by row number."""
    rows = df.withColumn("_fold", F.pmod(F.row_number().over(Window.orderBy(order)) - 1, F.lit(folds))).cache()
    parts = None
    for k in range(folds):
        test = read_model(class_model(rows.filter(F.col("_fold") != k), features, label), rows.filter(F.col("_fold") == k), features)
        one = test.select(F.col(label).alias("y"), F.log(F.greatest(F.element_at("p", F.col(label).cast("int") + 1), F.lit(1e-300))).alias("l"))
        parts = one if parts is None else parts.unionByName(one)
    value = parts.groupBy("y").agg(F.avg("l").alias("l")).agg(F.avg("l")).first()[0]
    rows.unpersist()
    return value


def _pooled_covariance(rows: DataFrame, means: dict[int, np.ndarray]) -> np.ndarray:
    """rows (x, _c): the mean outer product of x less its cluster's mean. A task sends one matrix, however many rows it has."""
    size = len(next(iter(means.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((size, size)), 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, size)
            x = x - np.array([means[c] for c in batch.column(1).to_pylist()]).reshape(-1, size)
            total, n = total + x.T @ x, n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], ["s", "n"])

    sums = rows.mapInArrow(run, "s array<double>, n long").agg(Summarizer.sum(array_to_vector("s")).alias("s"), F.sum("n").alias("n")).first()
    return sums["s"].toArray().reshape(size, size) / sums["n"]


def two_teams(df: DataFrame, features: str, brightness: str, restarts: int = 5, rounds: int = 10, ridge: float = 0.1) -> dict[str,
    list[float] | float]:
    """A discriminant between two clusters: {axis, bias}; axis . x + bias is above 0 for the brighter one's opposite (team 1).

    The best of some 2-means starts, then rounds of a pooled-covariance discriminant and reassignment. Only moments come to the driver.
    """
    rows = _vectors(df, features).cache()
    models = [KMeans(k=2, featuresCol="_v", predictionCol="_c", seed=s).fit(rows) for s in range(restarts)]
    labelled = min(models, key=lambda m: m.summary.trainingCost).transform(rows).select("_v", brightness, F.col("_c").cast("int").alias("_c"))
    axis, bias = None, 0.0
    for _ in range(rounds):
        stats = labelled.groupBy("_c").agg(Summarizer.mean(F.col("_v")).alias("mean"), F.count("*").alias("n"),
            F.avg(brightness).alias("light")).orderBy("_c").collect()
        if len(stats) < 2:
            break
        means = [r["mean"].toArray() for r in stats]
        size = len(means[0])
        array = vector_to_array("_v")
        cov = _pooled_covariance(labelled.select(array.alias("x"), "_c"), {r["_c"]: m for r, m in zip(stats, means, strict=True)})
        cov += np.eye(size) * ridge * max(np.trace(cov) / size, 1e-12)
        lighter = int(stats[1]["light"] > stats[0]["light"])
        m0, m1 = means[lighter], means[1 - lighter]
        new = np.linalg.solve(cov, m1 - m0)
        new /= max(abs(new @ (m1 - m0)) / 2, 1e-12)
        fresh = float(-new @ (m0 + m1) / 2)
        done = axis is not None and np.allclose(axis, new, atol=1e-9)
        axis, bias = new, fresh
        if done:
            break
        dot = F.aggregate(F.zip_with(array, F.array(*map(F.lit, axis.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        labelled = rows.select("_v", brightness, (dot + bias > 0).cast("int").alias("_c"))
    rows.unpersist()
    return {"axis": [] if axis is None else axis.tolist(), "bias": bias}


def margins(df: DataFrame, features: str, model: dict) -> DataFrame:
    """Signed distance, about 1 for a typical member of team 1 and -1 for one of team 0."""
    dot = F.aggregate(F.zip_with(F.col(features).cast("array<double>"), F.array(*map(F.lit, model["axis"])), lambda a, b: a * b), F.lit(0.0),
        lambda s, x: s + x)
    return df.withColumn("margin", dot + F.lit(model["bias"]))


def dominant_orientation(df: DataFrame, keys: Sequence[str], angle: str, weight: str) -> DataFrame:
    """The weighted circular mean of line directions (degrees, where 180 is 0), of the strongest 15 % of each key's rows."""
    floor = F.percentile(weight, 0.85).over(Window.partitionBy(*keys))
    strong = df.withColumn("_f", floor).filter(F.col(weight) >= F.col("_f"))
    double = F.radians(angle) * 2
    return strong.groupBy(*keys).agg(F.degrees(F.atan2(F.sum(F.col(weight) * F.sin(double)), F.sum(F.col(weight) * F.cos(double))) / 2).alias("tilt"))


def orientation_histogram(df: DataFrame, keys: Sequence[str], angle: str, weight: str, bins: int = 18) -> DataFrame:
    """Shares of the weight by direction, `bins` of them over 180 degrees, as an array."""
    bin_ = F.floor(F.pmod(F.col(angle), F.lit(180.0)) / (180.0 / bins)).cast("int")
    sums = [F.sum(F.when(bin_ == k, F.col(weight)).otherwise(F.lit(0.0))) for k in range(bins)]
    return df.groupBy(*keys).agg(F.array(*sums).alias("_s"), F.sum(weight).alias("_t")).select(*keys,
        F.transform("_s", lambda x: F.coalesce(F.try_divide(x, F.col("_t")), F.lit(0.0))).alias("histogram"))


def block_means(pixels: DataFrame, keys: Sequence[str], x: str, y: str, value: str, width: int, height: int) -> DataFrame:
    """Means of blocks of width x height pixels."""
    return pixels.groupBy(*keys, F.floor(F.col(x) / width).alias("bx"), F.floor(F.col(y) / height).alias("by")).agg(F.avg(value).alias("mean"))
