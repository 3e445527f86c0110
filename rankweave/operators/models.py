"""Learned scorers, linear stand-ins for the data side of the neural models: closed forms over sums, and ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, PCA, HashingTF, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.operators import features as ft
from rankweave.operators import tags
from rankweave.session import cut_lineage


def _summed(rows: DataFrame, size: int, per_block) -> np.ndarray:
    """The sum over all rows of ``per_block(x, y, w)``, an array of ``size`` numbers; a task sends one row of sums."""
    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total += per_block(x, batch["y"].to_numpy(zero_copy_only=False), batch["w"].to_numpy(zero_copy_only=False)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    return np.array(rows.mapInArrow(run, "s array<double>").agg(vector_to_array(Summarizer.sum(array_to_vector("s")))).first()[0])


def _staged(rows: DataFrame, features: str, label: str, weight: Column | None, intercept: bool) -> tuple[DataFrame, int]:
    """Stored (x, y, w) of the rows that have a label and features, and the number of columns of x."""
    x = F.transform(features, lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
    used = rows.where(F.col(label).isNotNull() & F.col(features).isNotNull())
    staged = cut_lineage(used.select((F.concat(x, F.array(F.lit(1.0))) if intercept else x).alias("x"), F.col(label).cast("double").alias("y"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w")))
    return staged, staged.agg(F.max(F.size("x"))).first()[0] or 0


def _penalty(squares: np.ndarray, reg: float, intercept: bool) -> np.ndarray:
    """``reg`` times a column's own sum of squares, so that scales do not matter; 1 for a column of zeros, which gets weight 0."""
    out = np.where(squares == 0, 1.0, reg * squares)
    if intercept and len(out):
        out[-1] = 0.0
    return out


def ridge(rows: DataFrame, features: str, label: str, reg: float = 1e-6, intercept: bool = True) -> list[float]:
    """Weights of a linear regression on an array column, the intercept last: one pass for the moments, solved once."""
    staged, d = _staged(rows, features, label, None, intercept)
    if not d:
        return []

    def moments(x, y, w):
        return x.T @ np.hstack([x, y[:, None]])

    sums = _summed(staged, d * (d + 1), moments).reshape(d, d + 1)
    gram = sums[:, :d]
    return np.linalg.solve(gram + np.diag(_penalty(np.diag(gram).copy(), reg, intercept)), sums[:, d]).tolist()


def logistic(rows: DataFrame, features: str, label: str, weight: Column | None = None, reg: float = 0.01, intercept: bool = True, steps: int = 8) -> list[float]:
    """Weights of a logistic regression on an array column, the intercept last.

    A fixed number of Newton steps from zero, each a weighted least-squares fit from sums of one pass over the rows.
    """
    staged, d = _staged(rows, features, label, weight, intercept)
    if not d:
        return []
    penalty = _penalty(_summed(staged, d, lambda x, y, w: (w[:, None] * x * x).sum(axis=0)), reg, intercept)
    beta = np.zeros(d)
    for _ in range(steps):
        def sums_at(x, y, w, beta=beta):
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -500, 500)))
            return np.hstack([x.T @ (x * (w * p * (1 - p))[:, None]), (x.T @ (w * (y - p)))[:, None]])

        sums = _summed(staged, d * (d + 1), sums_at).reshape(d, d + 1)
        beta = beta + np.linalg.solve(sums[:, :d] + np.diag(penalty), sums[:, d] - penalty * beta)
    return beta.tolist()


def pairwise_ranker(pairs: DataFrame, reg: float = 0.01) -> list[float]:
    """Linear scorer from (pos_features, neg_features) arrays: logistic regression on the difference of each pair."""
    gap = F.zip_with("pos_features", "neg_features", lambda a, b: a.cast("double") - b.cast("double"))
    return logistic(pairs.select(gap.alias("d"), F.lit(1.0).alias("label")), "d", "label", reg=reg, intercept=False)


def linear_score(weights: Sequence[float], features: Column) -> Column:
    """Weighted sum; a weight more than there are features is the intercept."""
    listed = F.array(*[F.lit(float(w)) for w in weights])
    filled = F.concat(features.cast("array<double>"), F.array_repeat(F.lit(1.0), F.lit(len(weights)) - F.size(features)))
    return F.aggregate(F.zip_with(filled, listed, lambda x, w: x * w), F.lit(0.0).cast("double"), lambda s, x: s + x)


def debiased_click_model(rows: DataFrame, features: Sequence[str], label: str, propensity: str = "propensity") -> list[float]:
    """Logistic regression with inverse-propensity weights; the intercept last."""
    staged = rows.select(F.array(*[F.col(c).cast("double") for c in features]).alias("x"), label, propensity)
    return logistic(staged, "x", label, 1.0 / F.greatest(F.col(propensity), F.lit(1e-3)))


def predict_probability(weights: Sequence[float], rows: DataFrame, features: Sequence[str], out: str) -> DataFrame:
    score = linear_score(weights, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]))
    return rows.withColumn(out, 1.0 / (1.0 + F.exp(-score)))


def text_classifier(rows: DataFrame, tokens: str, label: str, buckets: int = 1 << 14) -> PipelineModel:
    """Hashed TF-IDF and multinomial logistic regression."""
    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="label_id", stringOrderType="alphabetAsc", handleInvalid="keep"),
        HashingTF(inputCol=tokens, outputCol="tf", numFeatures=buckets),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(labelCol="label_id", regParam=0.01, maxIter=30),
    ]).fit(rows)


def user_segments(rows: DataFrame, key: str, columns: Sequence[str], dims: int, k: int, seed: int = 7) -> DataFrame:
    """(id, q, label): scale, reduce by principal components, cluster, soft assignment."""
    scaled = ft.standard_scale(rows, columns)
    staged = scaled.select(F.col(key).alias("id"), array_to_vector(F.array(*[F.col(f"{c}_z") for c in columns])).alias("features"))
    reduced = PCA(k=dims, inputCol="features", outputCol="reduced").fit(staged).transform(staged)
    points = reduced.select("id", vector_to_array("reduced").alias("vec"))
    return tags.soft_assign(points, tags.kmeans_centroids(points, k, seed))


def next_step_baselines(prefixes: DataFrame, feature: int) -> DataFrame:
    """MSE of repeating the last month and of the mean of the seen months, for one feature position."""
    seen = F.transform(F.slice("input", F.lit(1), F.col("step")), lambda m: m[feature])
    mean = F.aggregate(seen, F.lit(0.0).cast("double"), lambda s, x: s + x) / F.size(seen)
    goal = F.col("target")[feature]
    square = lambda x: x * x
    return prefixes.agg(
        F.avg(square(goal - F.element_at(seen, -1))).alias("mse_last"), F.avg(square(goal - mean)).alias("mse_mean"), F.count(F.lit(1)).alias("rows"))


def next_step_rows(prefixes: DataFrame, feature: int) -> DataFrame:
    """(user_id, step, features, label): the padded prefix of one feature and its length, and the feature's next value."""
    inputs = F.concat(F.transform("input", lambda m: m[feature]), F.array(F.col("step").cast("double")))
    return prefixes.select("user_id", "step", inputs.alias("features"), F.col("target")[feature].alias("label"))


def next_step_regression(prefixes: DataFrame, feature: int) -> list[float]:
    """Weights of a ridge regression of the next month's feature on the padded prefix and its length."""
    return ridge(next_step_rows(prefixes, feature), "features", "label")
