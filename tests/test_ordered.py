"""Ordered work on large groups: against plain windows and numpy, under skew."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators.attach import attach
from tidewell.operators.ordered import RANGE, exact_quantiles, number_rows, running_sums, split_in_ranges
from tidewell.operators.windows import chronological_split, lag_matrix, lead_targets


@pytest.fixture(scope="module", autouse=True)
def many_ranges(spark):
    """Keep small inputs in several ranges, as large ones are."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds half of the rows; one key is null."""
    k = F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 101 == 0, None).otherwise(F.col("id") % 37)
    return spark.range(20000).select("id", k.alias("k"), (F.col("id") * 7919 % 1000).alias("v"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_hot_key_spans_even_ranges(skewed):
    ranged = split_in_ranges(skewed, ["k"], [F.col("id")])
    sizes = [r["count"] for r in ranged.groupBy(RANGE).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 2 * sum(sizes) / len(sizes)
    assert ranged.where("k = 0").select(RANGE).distinct().count() > 2


@pytest.mark.parametrize("parts", [1, 17])
def test_running_sums_equal_window(skewed, parts):
    got = running_sums(skewed.repartition(parts), ["k"], [F.desc("v"), F.col("id")], {"s": F.col("v")}, {"t": F.col("v")})
    ordered = Window.partitionBy("k").orderBy(F.desc("v"), "id").rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.withColumn("s", F.sum("v").over(ordered)).withColumn("t", F.sum("v").over(Window.partitionBy("k")))
    assert rows(got) == rows(want)


def test_number_rows_without_keys(skewed):
    got = number_rows(skewed, [], [F.col("v"), F.col("id")], total="n")
    assert got.agg(F.min("rn"), F.max("rn"), F.count_distinct("rn"), F.max("n")).first()[:] == (1, 20000, 20000, 20000)


@pytest.mark.parametrize("fraction", [0.0, 0.01, 0.25, 0.5, 0.99, 1.0])
def test_quantiles_equal_numpy(skewed, fraction):
    got = {r["k"]: r["q"] for r in exact_quantiles(skewed, ["k"], "v", {"q": fraction}).collect()}
    values = {}
    for r in skewed.collect():
        values.setdefault(r["k"], []).append(r["v"])
    assert got.keys() == values.keys()
    for key, vs in values.items():
        assert got[key] == pytest.approx(np.quantile(vs, fraction), abs=1e-9)


def test_quantile_ignores_nulls_and_empty(spark):
    frame = spark.createDataFrame([(1, 3.0), (1, None), (1, 5.0)], "k int, v double")
    assert exact_quantiles(frame, [], "v", {"q": 0.5}).first()["q"] == 4.0
    assert exact_quantiles(frame.where("v > 9"), [], "v", {"q": 0.5}).first()["q"] is None


def test_blocked_lags_equal_plain(skewed):
    series = skewed.where("k IS NOT NULL").select("k", "id", "v")
    plain = lag_matrix(series, "k", "id", ["v"], 3)
    assert rows(lag_matrix(series, "k", "id", ["v"], 3, block_rows=10)) == rows(plain)
    ahead = lead_targets(series, "k", "id", "v", 4)
    assert rows(lead_targets(series, "k", "id", "v", 4, block_rows=11)) == rows(ahead)


def test_block_shorter_than_lag_is_refused(skewed):
    with pytest.raises(ValueError):
        lag_matrix(skewed, "k", "id", ["v"], 20, block_rows=10)


def test_chronological_split_shares(skewed):
    parts = [("train", 0.8), ("test", 0.1), ("validation", 0.1)]
    counts = dict(chronological_split(skewed, [], ["id"], parts).groupBy("part").count().collect())
    assert counts == {"train": 16000, "test": 2000, "validation": 2000}


@pytest.mark.parametrize("weight", [None, "n"])
@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("hot_rows", [1, 1000, 10**9])
def test_attach_equals_join(spark, skewed, weight, how, hot_rows, monkeypatch):
    monkeypatch.setattr("tidewell.operators.attach.HOT_ROWS", hot_rows)
    per_key = skewed.where("k IS NULL OR k <> 5").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    got = attach(skewed, per_key, ["k"], weight=weight, how=how)
    want = skewed.join(per_key, "k", how).select(got.columns)
    assert rows(got) == rows(want)
    assert got.where("k IS NULL AND m IS NOT NULL").count() == 0


def test_attach_keeps_salt_as_join_key(skewed):
    per_key = skewed.groupBy("k").agg(F.count("*").alias("n"))
    plan = attach(skewed, per_key, ["k"], weight="n")._jdf.queryExecution().optimizedPlan().toString()
    assert "_tw_salt" in plan and "_tw_zero" in plan


@pytest.mark.parametrize("present", [True, False])
def test_attach_spreads_a_hot_key(spark, present):
    """Half of the rows share a key; also when that key has no partner they spread over the tasks."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(kept, ("false", "16", "-1")):
        spark.conf.set(k, v)
    try:
        big = spark.range(0, 400_000, numPartitions=32).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
        per_key = spark.range(0, 400_000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
        if present:
            per_key = per_key.union(spark.createDataFrame([(-1, 2)], "k bigint, v int"))
        joined = attach(big, per_key, ["k"])
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert max(sizes) < 3 * 400_000 / 16
        assert joined.agg(F.count("v"), F.count("*")).first() == (400_000 if present else 200_000, 400_000)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_attach_without_hot_keys_is_one_join(spark):
    big, per_key = spark.range(50_000).select(F.col("id").alias("k")), spark.range(50_000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    plan = attach(big, per_key, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
