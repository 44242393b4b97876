"""The forest over cells: against MLlib's, against brute force, and on odd rows."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tidewell.operators import forest
from tidewell.operators import metrics as Q
from tidewell.operators import models as M


def noisy(spark, n=4000):
    rng = np.random.RandomState(2)
    x = rng.randn(n, 3) * [1, 20, 0.1] + [0, 100, 3]
    y = np.sin(2 * x[:, 0]) * 5 + (x[:, 1] > 110) * 8 + rng.randn(n)
    return spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id int, a double, b double, c double, y double")


def test_as_good_as_mllib(spark):
    rows, columns = noisy(spark), ["a", "b", "c"]
    ready = VectorAssembler(inputCols=columns, outputCol="features").transform(rows)
    single = RandomForestRegressor(featuresCol="features", labelCol="y", numTrees=20, maxDepth=5, seed=1).fit(ready.where("id % 4 > 0"))
    rmse = lambda df: Q.regression_errors(df, "prediction", "y").first()["rmse"]
    theirs = rmse(single.transform(ready.where("id % 4 = 0")))
    ours = rmse(M.fit_forest(rows.where("id % 4 > 0"), columns, "y").transform(rows.where("id % 4 = 0")))
    assert ours < 1.15 * theirs


def test_what_is_written_does_not_grow_with_the_rows(spark, monkeypatch):
    """Every row is drawn for every tree, and cells are the sums of their rows."""
    rows = spark.range(0, 60_000, 1, 4).select((F.col("id") % 6).cast("double").alias("x"), (F.col("id") % 4).alias("z"), (F.col("id") % 12).alias("y"))
    staged = []
    monkeypatch.setattr(forest, "stage", lambda df, label, real=forest.stage: staged.append(real(df, label)) or staged[-1])
    M.fit_forest(rows, ["x", "z"], "y", trees=7)
    found = staged[0].collect()
    assert len({r.cell for r in found}) == 12 and len(found) <= 12 * spark.sparkContext.defaultParallelism
    sums = np.array([r.sums for r in found]).reshape(-1, 7, 3)
    values = np.array([next(y for y in range(12) if y % 6 == r.cell[0] and y % 4 == r.cell[1]) for r in found])[:, None]
    assert np.allclose(sums[:, :, 1], sums[:, :, 0] * values) and np.allclose(sums[:, :, 2], sums[:, :, 0] * values**2)
    weights = sums[:, :, 0].sum(axis=0)
    assert (np.abs(weights - 60_000) < 5 * 60_000**0.5).all() and len(set(weights)) > 1


def test_more_cells_than_a_task_sums_at_a_time(spark):
    rows = spark.range(0, 150_000, 1, 1).select(*((F.col("id") * p % 150_001).cast("double").alias(c) for c, p in (("a", 7919), ("b", 104729), ("c", 1299709), ("d", 31))), F.lit(2.0).alias("y"))
    columns = ["a", "b", "c", "d"]
    cuts = forest.thresholds(rows, columns, "y")
    assert [len(c) for c in cuts] == [31] * 4
    want = {np.array([np.searchsorted(c, v) for c, v in zip(cuts, r[:4])], np.uint8).tobytes() for r in rows.collect()}
    found = forest.cells(rows.coalesce(1), columns, "y", cuts, 2, 1).select("cell", F.get("sums", F.lit(0)).alias("w")).toPandas()
    assert len(want) > forest.CELLS and {bytes(c) for c in found["cell"]} == want
    assert abs(found["w"].sum() - 150_000) < 5 * 150_000**0.5


def test_one_tree_splits_where_the_step_is(spark, tmp_path):
    rows = spark.range(900).select((F.col("id") % 30).alias("x"), (F.col("id") % 7).cast("float").alias("z")).withColumn("y", F.when(F.col("x") > 11, 5.0).otherwise(-1.0))
    model = M.fit_forest(rows, ["z", "x"], "y", trees=1, depth=3)
    assert model.feature == ((1, -1, -1, -1, -1, -1, -1, -1, -1, -1, -1, -1, -1, -1, -1),) and model.threshold[0][0] == 11.5
    M.save_model(model, f"{tmp_path}/forest")
    again = M.load_model(f"{tmp_path}/forest")
    assert again == model and again.transform(rows).where("abs(prediction - y) > 1e-9").count() == 0


def test_odd_rows(spark):
    rows = spark.range(50).select(F.col("id").cast("double").alias("x"), F.lit(3.0).alias("same"), F.lit(4.0).alias("y"))
    model = M.fit_forest(rows, ["x", "same"], "y", trees=3)
    assert {f for tree in model.feature for f in tree} == {-1} and {r.prediction for r in model.transform(rows).collect()} == {4.0}
    for column, value in (("x", None), ("same", float("nan")), ("y", None)):
        with pytest.raises(ValueError):
            M.fit_forest(rows.withColumn(column, F.when(F.col("x") == 7, F.lit(value).cast("double")).otherwise(F.col(column))), ["x", "same"], "y")
    with pytest.raises(ValueError):
        M.fit_forest(rows.where("x < 0"), ["x"], "y")
