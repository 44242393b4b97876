"""Sums that merge against single fits."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tidewell.functions.columns import uniform
from tidewell.operators import forecast as G
from tidewell.operators import models as M
from tidewell.operators.moments import moments


def series(spark, n=300):
    rng = np.random.RandomState(3)
    rows = [(s, int(d), float(50 + 10 * np.sin(d / 9 + k) + rng.randn()), float(rng.randint(1, 9))) for k, s in enumerate("abc") for d in range(n)]
    return spark.createDataFrame(rows, "series string, day int, close double, volume double")


def test_moments_are_those_of_all_rows(spark):
    rng = np.random.RandomState(1)
    x = rng.randn(500, 3) * [1, 1e-3, 1e4] + [0, 5, 1e6]
    rows = [tuple(map(float, r)) for r in x] + [(None, 1.0, 2.0), (float("nan"), 1.0, 2.0)]
    found = moments(spark.createDataFrame(rows, "a double, b double, c double").repartition(40), ["a", "b", "c"])
    assert found.n == 500 and np.allclose(found.mean, x.mean(axis=0), rtol=1e-12)
    assert np.allclose(found.covariance, np.cov(x.T, bias=True), rtol=1e-9)
    assert moments(spark.createDataFrame([], "a double"), ["a"]) is None


@pytest.mark.parametrize("penalty", [0.0, 0.01, 0.5])
def test_all_steps_at_once_equal_single_fits(spark, penalty):
    bars = series(spark).withColumn("volume", F.when(F.col("series") == "z", 0).otherwise(F.col("volume")))
    model = G.fit_direct(bars, "series", "day", lags=4, horizon=3, ridge=penalty)
    table, features = G.training_table(bars, "series", "day", 4, 3)
    ready = VectorAssembler(inputCols=features, outputCol="features").transform(table)
    for j in range(3):
        single = LinearRegression(labelCol=f"close_lead{j + 1}", regParam=penalty, solver="normal").fit(ready)
        assert np.allclose(model.weights[j], single.coefficients, atol=1e-6)
        assert model.intercepts[j] == pytest.approx(single.intercept, abs=1e-5)


def test_column_without_deviation_has_no_weight(spark):
    bars = series(spark).withColumn("volume", F.lit(7.0))
    model = G.fit_direct(bars, "series", "day", lags=3, horizon=2)
    assert all(w == 0 for weights in model.weights for w in weights[1::2])


def test_one_job_for_the_fit(spark):
    bars = series(spark)
    bars = spark.createDataFrame(bars.collect(), bars.schema)
    spark.sparkContext.setJobGroup("fit", "fit")
    try:
        G.fit_direct(bars, "series", "day", lags=4, horizon=10)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("fit")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # adaptive execution runs each shuffle of the one query as a job of its own
    assert len(jobs) <= 4


def people(spark, n=3000):
    rng = np.random.RandomState(5)
    x = rng.randn(n, 3) * [1, 40, 0.01] + [0, 100, 3]
    y = (rng.rand(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.02 * (x[:, 1] - 100) + 0.3)))).astype(int)
    rows = [(i, *map(float, r), 1.0, int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, same double, y int").withColumn("weight", F.when(F.col("y") == 1, 1.5).otherwise(0.7))


def test_members_equal_single_fits(spark):
    train, columns = people(spark), ["a", "b", "c", "same"]
    found = M.fit_ensemble(train, columns, "y", "id", members=4, balance="weight")
    assert all(w[3] == 0 for w in found.weights)
    for m in range(4):
        weight = M.poisson_weight(uniform(F.col("id"), seed=f"bootstrap{m}")) * F.col("weight")
        ready = VectorAssembler(inputCols=columns, outputCol="features").transform(train.withColumn("w", weight))
        single = LogisticRegression(labelCol="y", weightCol="w", maxIter=500, tol=1e-14).fit(ready)
        assert np.allclose(found.weights[m], single.coefficients, atol=1e-5, rtol=1e-5)
        assert found.intercepts[m] == pytest.approx(single.intercept, abs=1e-4)


def test_jobs_do_not_grow_with_members(spark):
    train, counts = people(spark, 400), []
    for members in (2, 12):
        spark.sparkContext.setJobGroup(f"members{members}", "fit")
        M.fit_ensemble(train, ["a", "b"], "y", "id", members=members)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"members{members}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] <= 1.5 * counts[0]


def test_scores_are_mean_and_deviation_of_members(spark):
    found = M.Ensemble(("a", "b"), ((0.5, -0.1), (0.2, 0.3), (0.0, 0.0)), (0.1, -1.0, 0.4))
    row = M.ensemble_scores(found, spark.createDataFrame([(1.5, 2)], "a double, b int")).first()
    p = [1 / (1 + np.exp(-(w[0] * 1.5 + w[1] * 2 + b))) for w, b in zip(found.weights, found.intercepts)]
    assert row["mean"] == pytest.approx(np.mean(p)) and row["std"] == pytest.approx(np.std(p, ddof=1))


def test_separable_rows_end(spark):
    train = spark.range(60).select(F.col("id"), F.col("id").cast("double").alias("x"), (F.col("id") > 29).cast("int").alias("y"))
    row = M.ensemble_scores(M.fit_ensemble(train, ["x"], "y", "id", members=2), train.where("id = 59")).first()
    assert row["mean"] > 0.99
    with pytest.raises(ValueError):
        M.fit_ensemble(train.withColumn("x", F.lit(None).cast("double")), ["x"], "y", "id", members=2)


def test_rows_alike_are_written_as_one(spark, monkeypatch):
    """Draws stay those of each row: two features of few values, beside single fits; what is written does not grow with the rows."""
    rows = spark.range(0, 6000, 1, 3).select(
        "id", (F.col("id") % 3).cast("double").alias("a"), (F.col("id") % 5 > 2).cast("int").alias("b"), (F.col("id") * 7919 % 11 < 3 + F.col("id") % 3).cast("int").alias("y")
    )
    staged = []
    monkeypatch.setattr(M, "stage", lambda df, label, real=M.stage: staged.append(real(df, label)) or staged[-1])
    found = M.fit_ensemble(rows, ["a", "b"], "y", "id", members=3)
    assert staged[0].count() <= 3 * 12 and staged[0].agg(F.sum("n")).first()[0] == 6000
    for m in range(3):
        ready = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows.withColumn("w", M.poisson_weight(uniform(F.col("id"), seed=f"bootstrap{m}"))))
        single = LogisticRegression(labelCol="y", weightCol="w", maxIter=500, tol=1e-14).fit(ready)
        assert np.allclose(found.weights[m], single.coefficients, atol=1e-5, rtol=1e-5)
        assert found.intercepts[m] == pytest.approx(single.intercept, abs=1e-4)


def test_rows_that_differ_are_all_written(spark, monkeypatch):
    """More than a task holds back."""
    rows = spark.range(0, 80_000, 1, 1).select("id", (F.col("id") * 7919 % 80_000).cast("double").alias("a"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    staged = []
    monkeypatch.setattr(M, "stage", lambda df, label, real=M.stage: staged.append(real(df, label)) or staged[-1])
    M.fit_ensemble(rows, ["a"], "y", "id", members=2)
    want = rows.agg(*(F.sum(M.poisson_weight(uniform(F.col("id"), seed=f"bootstrap{m}"))) for m in range(2)), F.count("*")).first()
    facts = staged[0].agg(*(F.sum(F.get("w", F.lit(m))) for m in range(2)), F.sum("n"), F.count("*"), F.count_distinct("x"))
    assert tuple(facts.first()) == (*want, 80_000, 80_000)


def test_moments_of_counted_rows(spark):
    counted = spark.createDataFrame([(1.0, 2.0, 3.0), (4.0, -1.0, 2.0), (float("nan"), 1.0, 5.0)], "a double, b double, n double")
    x = np.array([(1.0, 2.0)] * 3 + [(4.0, -1.0)] * 2)
    found = moments(counted, ["a", "b"], count="n")
    assert found.n == 5 and np.allclose(found.mean, x.mean(axis=0)) and np.allclose(found.covariance, np.cov(x.T, bias=True))


def test_scores_of_rows_with_missing_features(spark):
    found = M.Ensemble(("a", "b"), ((0.5, -0.1), (0.2, 0.3)), (0.1, -1.0))
    rows = [(0, 1.0, 1.0), (1, None, 1.0), (2, float("nan"), 1.0), (3, 1e9, 0.0), (4, -1e9, 0.0)]
    got = {r.k: (r["mean"], r["std"]) for r in M.ensemble_scores(found, spark.createDataFrame(rows, "k int, a double, b double")).collect()}
    assert got[1] == (None, None) and np.isnan(got[2]).all() and got[3] == (1.0, 0.0) and got[4] == (0.0, 0.0) and 0 < got[0][0] < 1
