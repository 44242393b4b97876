"""MLlib models, ensembles and forests: fitting, applying, storing."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.columns import uniform
from tidewell.operators import forest
from tidewell.operators.moments import moments, newton_sums
from tidewell.session import stage


def _prepared(columns: Sequence[str]) -> list:
    return [
        VectorAssembler(inputCols=list(columns), outputCol="_tw_raw", handleInvalid="error"),
        StandardScaler(inputCol="_tw_raw", outputCol="features", withMean=False, withStd=True),
    ]


def fit_binary(
    train: DataFrame, columns: Sequence[str], label: str, weight: str | None = None, max_iter: int = 100
) -> PipelineModel:
    """Assemble, scale, logistic regression."""
    model = LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter)
    if weight:
        model = model.setWeightCol(weight)
    return Pipeline(stages=[*_prepared(columns), model]).fit(train)


def apply_binary(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds the prediction and, as ``score``, the probability of class 1."""
    out = model.transform(df)
    return out.withColumn("score", vector_to_array("probability")[1]).select(
        *df.columns, F.col("prediction").cast("int").alias("prediction"), "score"
    )


def fit_multiclass(train: DataFrame, features: str, label: str, max_iter: int = 200) -> PipelineModel:
    model = LogisticRegression(featuresCol=features, labelCol=label, maxIter=max_iter, family="multinomial")
    return Pipeline(stages=[model]).fit(train)


def with_vector(df: DataFrame, array_column: str, name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.col(array_column).cast("array<double>")))


def fit_forest(
    train: DataFrame, columns: Sequence[str], label: str, trees: int = 20, depth: int = 5, seed: int = 174
) -> forest.Forest:
    """Bootstrap weights, a third of the columns for each node, bins and gain as MLlib's random forest has them, from one pass over the rows."""
    return forest.fit(train, columns, label, trees, depth, seed)


def project(df: DataFrame, features: str, k: int = 2, name: str = "pca") -> DataFrame:
    return PCA(k=k, inputCol=features, outputCol=name).fit(df).transform(df)


def standardised(df: DataFrame, features: str, name: str) -> DataFrame:
    """Vectors centred and scaled to unit deviation."""
    scaler = StandardScaler(inputCol=features, outputCol=name, withMean=True, withStd=True)
    return scaler.fit(df).transform(df)


def fit_clusters(df: DataFrame, features: str, k: int = 3, seed: int = 42, name: str = "cluster") -> KMeansModel:
    return KMeans(k=k, seed=seed, featuresCol=features, predictionCol=name).fit(df)


def cluster(df: DataFrame, features: str, k: int = 3, seed: int = 42, name: str = "cluster") -> DataFrame:
    return fit_clusters(df, features, k, seed, name).transform(df)


def silhouette(df: DataFrame, features: str, cluster_column: str) -> float:
    """Mean silhouette with squared Euclidean distance."""
    return ClusteringEvaluator(
        featuresCol=features, predictionCol=cluster_column, metricName="silhouette"
    ).evaluate(df)


def save_model(model: PipelineModel | forest.Forest, path: str) -> None:
    if isinstance(model, forest.Forest):
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps({"forest": asdict(model)}),)], "value string").write.mode("overwrite").text(f"{path}/metadata")
        return
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | forest.Forest:
    """Load a stored model; a missing one is refused with a clear message."""
    spark = SparkSession.getActiveSession()
    try:
        stored = spark.read.text(f"{path}/metadata").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no fitted model at {path}") from error
    found = json.loads(stored[0]).get("forest") if stored else None
    if found:
        parts = (tuple(map(tuple, found[k])) for k in ("feature", "threshold", "value"))
        return forest.Forest(tuple(found["columns"]), *parts)
    return PipelineModel.load(path)


def prediction_log(model: PipelineModel, df: DataFrame, key: str, inputs: Sequence[str]) -> DataFrame:
    """Inputs, predicted class and creation time, ready to append to a log table."""
    out = model.transform(df)
    return out.select(
        key,
        *inputs,
        F.col("prediction").cast("int").alias("predicted_class"),
        F.current_timestamp().alias("created_at"),
    )


def poisson_levels() -> list[float]:
    """Cumulative probabilities of Poisson(1); 32 bits leave nothing above 12."""
    return list(accumulate(math.exp(-1) / math.factorial(k) for k in range(12)))


def poisson_weight(u: Column) -> Column:
    """Poisson(1) draw from a uniform of 32 bits."""
    cumulative = poisson_levels()
    weight = F.lit(12.0)
    for count, upto in reversed(list(enumerate(cumulative))):
        weight = F.when(u < upto, F.lit(float(count))).otherwise(weight)
    return weight


def bootstrap_models(
    train: DataFrame, columns: Sequence[str], label: str, key: str, members: int = 30, balance: str | None = None
) -> list[PipelineModel]:
    """Members fitted on Poisson-weighted copies of the rows.

    The weight of a row is drawn from its key and the member number, so no copy is
    stored and the draw does not depend on the partitioning. ``balance`` names a weight column that multiplies it.
    """
    models = []
    for member in range(members):
        weight = poisson_weight(uniform(F.col(key), seed=f"bootstrap{member}"))
        if balance:
            weight = weight * F.col(balance)
        models.append(fit_binary(train.withColumn("_tw_weight", weight), columns, label, weight="_tw_weight"))
    return models


def ensemble_estimate(models: Sequence[PipelineModel], df: DataFrame) -> DataFrame:
    """Mean and sample deviation of the members' probabilities, per row."""
    out = df
    for i, model in enumerate(models):
        out = apply_binary(model, out).withColumnRenamed("score", f"_tw_p{i}").drop("prediction")
    members = F.array(*(F.col(f"_tw_p{i}") for i in range(len(models))))
    mean = F.aggregate(members, F.lit(0.0), lambda a, x: a + x) / len(models)
    spread = F.aggregate(members, F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
    return (
        out.withColumn("mean", mean)
        .withColumn("std", F.sqrt(spread / max(1, len(models) - 1)))
        .select(*df.columns, "mean", "std")
    )


@dataclass(frozen=True)
class Ensemble:
    """Logistic models of the same columns: weights (members, columns) and intercepts."""

    columns: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]

    def probabilities(self) -> Column:
        """An array with the probability that each member gives."""
        def margin(weights: Sequence[float], level: float) -> Column:
            return sum((F.col(c).cast("double") * w for c, w in zip(self.columns, weights)), F.lit(level))

        return F.array(*(1.0 / (1.0 + F.exp(-margin(w, b))) for w, b in zip(self.weights, self.intercepts)))


#: Rows that a task holds back to merge those alike.
HELD = 1 << 15


def _alike(drawn: DataFrame, size: int, members: int) -> DataFrame:
    """Rows (x, y, share, u) as (x, y, w, n): those of a task that are alike in x and y as one, with the sums of their weights and their number.

    A row with a missing value comes out with NaN for y.
    """
    levels = np.array(poisson_levels())

    def sums(z: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort(z.T)
        z, w = z[order], w[order]
        starts = np.flatnonzero(np.concatenate([[True], (z[1:] != z[:-1]).any(axis=1)]))
        return z[starts], np.add.reduceat(w, starts, axis=0)

    def batch(z: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(z), 8192):
            x, y, v, n = z[i : i + 8192, :-1], z[i : i + 8192, -1], w[i : i + 8192, :-1], w[i : i + 8192, -1]
            lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1]), pa.int32()), pa.array(a.ravel()))
            yield pa.RecordBatch.from_arrays([lists(x), pa.array(y), lists(v), pa.array(n)], names=["x", "y", "w", "n"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for frame in frames:
            if not frame.num_rows:
                continue
            z = np.empty((frame.num_rows, size + 1))
            z[:, :-1] = frame.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            z[:, -1] = frame.column(1).to_numpy(zero_copy_only=False)
            share = frame.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            missing = np.isnan(z).any(axis=1) | frame.column(2).is_null().to_numpy(zero_copy_only=False)
            z[missing], share[missing] = [*[0.0] * size, np.nan], 0.0
            u = frame.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, members)
            w = np.empty((len(z), members + 1))
            # a draw is how many of the cumulative probabilities it reaches
            w[:, :-1] = np.searchsorted(levels, u, side="right") * share[:, None]
            w[:, -1] = 1.0
            held.append(sums(z, w))
            if sum(len(h[0]) for h in held) > HELD:
                held = [sums(*map(np.concatenate, zip(*held)))]
                if len(held[0][0]) > HELD // 2:
                    yield from batch(*held.pop())
        if held:
            yield from batch(*sums(*map(np.concatenate, zip(*held))))

    return drawn.mapInArrow(run, "x array<double>, y double, w array<double>, n double")


#: Rounds of the ensemble's fit, and the step under which a member stands still.
MOST_ROUNDS, STILL = 50, 1e-10


def fit_ensemble(
    train: DataFrame, columns: Sequence[str], label: str, key: str, members: int = 30, balance: str | None = None
) -> Ensemble:
    """All members of ``bootstrap_models`` at once: Newton's method, one pass over the rows for each round of all members.

    Weights are drawn in the row as there and written once beside the features; rows alike in features and label are written as one with the sums of their
    weights as far as a task holds them together, which leaves every sum as it is. A member whose loss grew takes back half its step. Rows with a null or
    NaN feature or label are refused; a column without deviation gets weight 0.
    """
    # an array of seeds, not a column for each member: 73 core microseconds a row for thirty draws against 91
    seeds = F.array(*(F.lit(f"bootstrap{m}") for m in range(members)))
    drawn = train.select(
        F.array(*(F.col(c).cast("double") for c in columns)).alias("x"), F.col(label).cast("double").alias("y"),
        (F.col(balance).cast("double") if balance else F.lit(1.0)).alias("share"),
        F.transform(seeds, lambda seed: uniform(F.col(key), seed=seed)).alias("u"),
    )
    size = len(columns)
    rows = stage(_alike(drawn, size, members), "ensemble")
    if rows.where(F.isnan("y")).limit(1).count():
        raise ValueError("rows with a missing feature, label or weight")
    each = [F.get("x", F.lit(i)).alias(f"x{i}") for i in range(size)]
    summary = moments(rows.select(*each, "n"), [f"x{i}" for i in range(size)], count="n")
    if summary is None:
        raise ValueError("no rows to fit")
    live = summary.deviation > 0
    scale = np.where(live, summary.deviation, 1.0)
    beta, last, loss = np.zeros((members, size + 1)), np.zeros((members, size + 1)), np.full(members, np.inf)
    moving = np.ones(members, bool)
    kept = np.concatenate([[True], live])
    for _ in range(MOST_ROUNDS):
        now, gradient, hessian = newton_sums(rows, size, members, beta, summary.mean, scale)
        for m in np.flatnonzero(moving):
            if now[m] > loss[m] * (1 + 1e-12) + 1e-12:
                beta[m] = (beta[m] + last[m]) / 2
                continue
            step = np.zeros(size + 1)
            step[kept] = np.linalg.lstsq(hessian[m][np.ix_(kept, kept)], gradient[m][kept], rcond=None)[0]
            last[m], loss[m] = beta[m], now[m]
            beta[m] = beta[m] + step
            moving[m] = np.abs(step).max() > STILL * max(1.0, np.abs(beta[m]).max())
        if not moving.any():
            break
    weights = np.where(live, beta[:, 1:] / scale, 0.0)
    intercepts = beta[:, 0] - weights @ summary.mean
    return Ensemble(tuple(columns), tuple(tuple(w) for w in weights.tolist()), tuple(intercepts.tolist()))


def ensemble_scores(ensemble: Ensemble, df: DataFrame) -> DataFrame:
    """Mean and sample deviation of the members' probabilities, per row; null where a feature is null."""
    weights, levels = ensemble.weights, ensemble.intercepts

    @F.arrow_udf("mean double, std double")
    def scores(*x: pa.Array) -> pa.Array:
        z = [a.to_numpy(zero_copy_only=False).astype(np.float64) for a in x]
        with np.errstate(over="ignore", invalid="ignore"):
            p = [1.0 / (1.0 + np.exp(-sum((a * b for a, b in zip(z, w)), np.full(len(x[0]), level)))) for w, level in zip(weights, levels)]
            mean = sum(p) / len(p)
            spread = sum((a - mean) * (a - mean) for a in p)
        return pa.StructArray.from_arrays([pa.array(mean), pa.array(np.sqrt(spread / max(1, len(p) - 1)))], names=["mean", "std"])

    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in ensemble.columns), F.lit(True))
    given = df.withColumn("_tw_scores", scores(*(F.col(c).cast("double") for c in ensemble.columns)))
    return given.withColumns({c: F.when(known, F.col(f"_tw_scores.{c}")) for c in ("mean", "std")}).drop("_tw_scores")
