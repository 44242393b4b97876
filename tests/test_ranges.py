"""Long series, deep pages, counted refits and merged logs: the same as the plain forms, spread over tasks."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import features as E
from tidewell.operators import joins as J
from tidewell.operators import relational as R
from tidewell.operators import windows as W
from tidewell.operators.ordered import RANGE, last_known, last_n, sorted_ranges
from tidewell.operators.quantiles import column_quantiles, quantiles_of
from tidewell.streaming import streams as X


@pytest.fixture(scope="module")
def many(spark):
    """Keeps all shuffle partitions, as a large input would."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.fixture(scope="module")
def ticks(many):
    """One series holds a third of all rows; some keys and many values are null."""
    rng = random.Random(4)
    rows = []
    for i in range(6000):
        s = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None, *map(str, range(30))])
        rows.append((i, s, rng.randrange(2000), None if rng.random() < 0.7 else rng.randrange(10_000) / 100))
    return many.createDataFrame(rows, "id int, s string, t int, v double").repartition(7).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_last_known_equals_plain_window(ticks):
    plain = Window.partitionBy("s").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = ticks.withColumn("k", F.last("v", ignorenulls=True).over(plain))
    got = last_known(ticks, ["s"], [F.col("t"), F.col("id")], {"k": "v"})
    assert got.columns == want.columns and rows(got) == rows(want)
    down = Window.partitionBy("s").orderBy(F.desc("t"), "id").rowsBetween(Window.unboundedPreceding, 0)
    want = ticks.withColumn("v", F.last("v", ignorenulls=True).over(down))
    assert rows(last_known(ticks, ["s"], [F.desc("t"), F.col("id")], {"v": "v"})) == rows(want)
    assert last_known(ticks.limit(0), ["s"], [F.col("t")], {"k": "v"}).collect() == []


def test_hot_series_spreads_over_tasks(ticks):
    held = sorted_ranges(ticks, ["s"], [F.col("t"), F.col("id")]).where("s = 'hot'").groupBy(RANGE).count().collect()
    assert len(held) >= 3 and max(r["count"] for r in held) < 1500


def test_running_mean_and_carried_values(ticks):
    plain = W.expanding_mean(ticks.withColumn("o", F.col("t") * 10_000 + F.col("id")), "s", "o", "v", "m", decimals=2).drop("o")
    assert rows(W.expanding_mean(ticks, "s", "t", "v", "m", decimals=2, ranges=True, tie="id")) == rows(plain)
    plain = W.carry_forward(ticks.withColumn("o", F.col("t") * 10_000 + F.col("id")), "s", "o", "v").drop("o")
    assert rows(W.carry_forward(ticks, "s", "t", "v", ranges=True, tie="id")) == rows(plain)


def test_look_back_of_long_series(ticks):
    known = ticks.where("s IS NOT NULL AND v IS NOT NULL")
    plain = W.look_back(known.withColumn("o", F.col("t") * 10_000 + F.col("id")), "s", "o", ["v"], 1500 * 10_000 + 9999, 7)
    got = W.look_back(known, "s", "t", ["v"], 1500, 7, ranges=True, tie="id")
    assert rows(got) == rows(plain)
    kept = last_n(known, ["s"], [F.col("t"), F.col("id")], 7)
    assert kept.where("s = 'hot'").count() <= 7 * 8


@pytest.mark.parametrize("offset", [0, 17, 4000, 5995, 6000, 9000])
def test_deep_page(ticks, offset, monkeypatch):
    monkeypatch.setattr(R, "SHALLOW", 20)
    monkeypatch.setattr(R, "MOST_SORTED", 200)
    want = [r["id"] for r in ticks.orderBy(F.desc("id")).offset(offset).limit(10).collect()]
    assert [r["id"] for r in R.newest(ticks, "id", 10, offset).collect()] == want
    part, rest = R._page_range(ticks, "id", 10, offset)
    assert part.count() <= 250 or offset >= 6000
    assert rest <= offset


def test_deep_page_of_equal_and_missing_keys(ticks, monkeypatch):
    monkeypatch.setattr(R, "SHALLOW", 20)
    monkeypatch.setattr(R, "MOST_SORTED", 200)
    same = ticks.withColumn("k", F.when(F.col("id") % 4 == 0, None).otherwise(F.lit(7)))
    assert [r["k"] for r in R.newest(same, "k", 3, 4498).collect()] == [7, 7, None]
    assert len(R.newest(ticks.withColumn("k", F.col("id").cast("string")), "k", 5, 100).collect()) == 5


def test_counted_refits_do_not_depend_on_batches(spark, tmp_path):
    log = spark.range(53).select("id", (F.col("id") % 3).alias("arm"))

    def fit(waiting):
        return waiting.groupBy("version").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.collect_set("arm").alias("arms"))

    def run(name, batches):
        sink = X.CountedRefit(str(tmp_path / name), fit, ["id"], every=10)
        at = 0
        for number, size in enumerate(batches):
            for _ in range(2 if number == 1 else 1):  # a replayed batch
                sink(log.where(f"id >= {at} AND id < {at + size}"), number)
            at += size
        return sorted((r["version"], r["n"], r["ids"], sorted(r["arms"])) for r in sink.models(spark).collect())

    once = run("once", [53])
    assert [v for v, *_ in once] == [1, 2, 3, 4, 5] and {n for _, n, *_ in once} == {10}
    assert run("some", [7, 25, 0, 21]) == once
    assert run("ones", [1] * 13 + [40]) == once


def next_by_force(events, outcomes, days):
    out = []
    for k, at, tag in events:
        late = [o for o in outcomes if k is not None and at is not None and o[0] == k and o[2] is not None and at <= o[2] <= at + datetime.timedelta(days=days)]
        best = min(late, key=lambda o: (o[2], o[1], o[3]), default=None)
        out.append((k, at, tag, best[1] if best else 0, best[2] if best else None, best[3] if best else None))
    return sorted(out, key=str)


def test_outcomes_within_a_horizon_for_a_hot_key(many):
    rng, start = random.Random(8), datetime.datetime(2024, 1, 1)
    when = lambda: start + datetime.timedelta(hours=rng.randrange(24 * 60))
    key = lambda: 1 if rng.random() < 0.6 else rng.randrange(2, 20)
    events = [(key(), when(), f"e{i}") for i in range(500)] + [(None, when(), "n"), (3, None, "m"), (99, when(), "lone")]
    outcomes = [(key(), rng.randrange(2), when(), rng.choice("xyz")) for _ in range(600)] + [(None, 1, when(), "x"), (1, 1, None, "x")]
    events += [(1, outcomes[0][2], "same")]
    outcomes += [(1, 1, outcomes[0][2], "a")]
    a = many.createDataFrame(events, "k int, decided timestamp, tag string").repartition(5)
    b = many.createDataFrame(outcomes, "k int, reward int, observed timestamp, note string").repartition(5)
    got = J.join_outcomes(a, b, "k", "observed", decided="decided", horizon_days=2)
    assert got.columns == ["k", "decided", "tag", "reward", "observed", "note"]
    want = next_by_force(events, outcomes, 2)
    assert rows(got) == want
    inner = J.join_outcomes(a, b, "k", "observed", how="inner", decided="decided", horizon_days=2)
    assert rows(inner) == [r for r in want if r[4] is not None]
    assert J.join_outcomes(a, b.limit(0), "k", "observed", decided="decided", horizon_days=2).count() == len(events)


def test_a_million_categories_stay_a_table(many, monkeypatch):
    wide = many.range(1_000_000).select("id", F.concat(F.lit("c"), "id").alias("c"))
    wide = wide.union(many.range(3).select("id", F.lit("c5")))
    found = E.one_hot_sparse(wide, "c", "hot").where("c = 'c5' OR id = 999999").collect()
    assert {(r["c"], r["hot"]["size"], *r["hot"]["indices"]) for r in found if r["c"] == "c5"} == {("c5", 999_999, 0)}
    with pytest.raises(ValueError):
        E.one_hot_columns(wide, "c")
    few = many.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, None)], "id int, c string")
    assert rows(E.one_hot_vector(few, "c", "hot").select("id", "hot")) == [(1, [1.0]), (2, [0.0]), (3, [1.0]), (4, [0.0])]
    sparse = {r["id"]: (r["hot"]["size"], r["hot"]["indices"], r["hot"]["values"]) for r in E.one_hot_sparse(few, "c", "hot").collect()}
    assert sparse == {1: (1, [0], [1.0]), 2: (1, [], []), 3: (1, [0], [1.0]), 4: (1, [], [])}
    monkeypatch.setattr(E, "MOST_COLUMNS", 1)
    with pytest.raises(Exception, match="categories"):
        E.one_hot_vector(few, "c", "hot").collect()


def test_quantiles_of_many_columns(many):
    rng = np.random.RandomState(2)
    columns = {"even": rng.randn(30_000), "ties": rng.randint(0, 4, 30_000).astype(float), "flat": np.full(30_000, 2.5), "long": rng.pareto(1, 30_000)}
    table = many.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values())] + [(None, None, None, None)], ", ".join(f"{c} double" for c in columns)).repartition(9)
    fractions = [0.0, 0.001, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    found = quantiles_of(table, list(columns), fractions)
    for name, values in columns.items():
        assert found[name].n == 30_000
        assert found[name].levels == pytest.approx(list(np.quantile(values, fractions)), abs=1e-12)
        for level, below in zip(found[name].levels, found[name].below):
            assert below == -1 or below == int((values < level).sum())
    few = quantiles_of(table.limit(5), ["even"], [0.3])["even"]
    assert few.n <= 5 and few.levels[0] is not None
    assert quantiles_of(table.limit(0), ["even", "ties"], [0.0, 0.5])["even"].levels == [None, None]
    broken = table.limit(3).withColumn("even", F.lit(float("nan")))
    assert quantiles_of(broken, ["even"], [0.5]) is None
    assert np.isnan(column_quantiles(broken, "even", {"q": 0.5}).first()["q"])


def test_quantiles_scan_the_table_twice(many, tmp_path):
    from tidewell.operators import monitor as D

    many.range(50_000).select(F.rand(1).alias("a"), F.rand(2).alias("b")).write.parquet(str(tmp_path / "t"))
    table = many.read.parquet(str(tmp_path / "t"))
    plans = []
    quantiles_of(table, ["a", "b"], [0.5])
    got = D.feature_psi(table, table, ["a", "b"])
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert "FileScan" not in plans[0] and {r["psi"] for r in got.collect()} == {0.0}
