"""Filters, paging, picks, joins, profiles: edge rows."""

import pytest
from pyspark.sql import functions as F

from tidewell.operators import aggregates as A
from tidewell.operators import joins as J
from tidewell.operators import relational as R
from tidewell.operators import windows as W


@pytest.fixture(scope="module")
def books(spark):
    rows = [
        (1, "100% Wool", "Craft", 5.0), (2, "100 Days", "Fiction", None), (3, "a_b", "Craft", 7.5),
        (4, "axb", "Poetry", 0.0), (5, "1984", "fiction", 9.0),
    ]
    return spark.createDataFrame(rows, "id int, title string, category string, price double")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_search_wildcards_are_literal(books):
    assert ids(R.search(books, title="100%")) == [1]
    assert ids(R.search(books, title="A_B")) == [3]
    assert ids(R.search(books, title=None, category="FICTION")) == [2, 5]
    assert ids(R.search(books)) == [1, 2, 3, 4, 5]
    assert ids(R.search(books, title="", category="poetry")) == [4]
    assert ids(R.search(books, title="nothing")) == []


def test_optional_bounds(books):
    assert ids(R.where_between(books, "price", low=5)) == [1, 3, 5]
    assert ids(R.where_between(books, "price", high=5)) == [1, 4]
    assert ids(R.where_between(books, "price")) == [1, 2, 3, 4, 5]
    assert ids(R.where_ends_with(books, "title", "DAYS")) == [2]
    assert ids(R.where_ends_with(books, "title", "b", "price", 7)) == [4]


def test_sort_by_unknown_column_is_refused(books):
    with pytest.raises(ValueError, match="unknown column"):
        R.sort_by_choice(books, "nope", True, "id")
    assert [r["id"] for r in R.sort_by_choice(books, "category", False, "id").collect()] == [5, 4, 2, 1, 3]


def test_last_page_is_reachable(books):
    pages = {r["id"]: (r["page"], r["page_count"]) for r in R.number_pages(books, [F.col("id")], 2).collect()}
    assert pages == {1: (1, 3), 2: (1, 3), 3: (2, 3), 4: (2, 3), 5: (3, 3)}
    with pytest.raises(ValueError):
        R.number_pages(books, [F.col("id")], 0)


def test_lookup_reports_missing(spark, books):
    wanted = spark.createDataFrame([(1,), (9,), (9,)], "id int")
    got = {r["id"]: r["found"] for r in R.lookup(books, wanted, "id").collect()}
    assert got == {1: True, 9: False}


def test_pick_is_repeatable(books):
    picks = {tuple(sorted(ids(R.pick_one(books.repartition(n), "category", "id", 7)))) for n in (1, 5)}
    assert len(picks) == 1


def test_last_rows_are_ascending(books):
    assert [r["id"] for r in R.last_rows(books, ["id"], 2).collect()] == [4, 5]


def test_trim_exact_and_approximate(spark):
    frame = spark.range(-10, 101).select("id", F.col("id").cast("double").alias("v"))
    exact = R.trim_outliers(frame, "v", 0.99)
    assert exact.agg(F.min("v"), F.max("v")).first()[:] == (1.0, 98.0)
    assert R.trim_outliers(frame, "v", 0.99, accuracy=1000).count() in (98, 99)


def test_same_set(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "v string"), spark.createDataFrame([("y",), ("y",), ("z",)], "v string")
    assert R.same_set(a, b).first()[:] == (1, 1, False)
    assert R.same_set(a, a).first()[:] == (0, 0, True)


def test_parents_without_children_and_pages(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "u int, name string")
    children = spark.createDataFrame([(i, 1) for i in range(7)] + [(9, 2)], "r int, u int")
    got = J.parents_with_children(parents, "u", children, "u", "r", page_size=3)
    found = {(r["u"], r["page"]): r["children"] for r in got.collect()}
    assert found == {(1, 0): [0, 1, 2], (1, 1): [3, 4, 5], (1, 2): [6], (2, 0): [9], (3, 0): []}


def test_outcomes_horizon_and_duplicates(spark):
    events = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ '2024-01-01'), (2, TIMESTAMP_NTZ '2024-01-01'), (3, TIMESTAMP_NTZ '2024-01-01') t(e, at)")
    late = spark.sql(
        "SELECT * FROM VALUES (1, 1, TIMESTAMP_NTZ '2024-01-31'), (1, 0, TIMESTAMP_NTZ '2024-02-01'),"
        " (2, 1, TIMESTAMP_NTZ '2024-02-01'), (7, 1, TIMESTAMP_NTZ '2024-01-02') t(e, reward, seen)"
    )
    got = J.join_outcomes(events, late, "e", "seen", decided="at", horizon_days=30)
    assert {r["e"]: r["reward"] for r in got.collect()} == {1: 1, 2: 0, 3: 0}
    known, unknown = J.recover_context(late, events, "e")
    assert (known.count(), [r["e"] for r in unknown.collect()]) == (3, [7])


def test_score_distinct_with_null_feature(spark):
    frame = spark.createDataFrame([(1, None), (2, None), (3, 4.0)], "i int, f double")
    scored = J.score_distinct(frame, ["f"], lambda t: t.withColumn("s", F.coalesce(F.col("f"), F.lit(-1.0)) * 2), "s")
    assert {r["i"]: r["s"] for r in scored.collect()} == {1: -2.0, 2: -2.0, 3: 8.0}


def test_profiles(spark):
    frame = spark.createDataFrame([("unknown", None, float("nan")), ("x", "unknown", 1.0), ("unknown", "y", None)], "a string, b string, v double")
    assert {r[0]: r[1] for r in A.null_profile(frame).collect()} == {"a": 0, "b": 1, "v": 1}
    assert {r[0]: r[1] for r in A.literal_profile(frame).collect()} == {"a": 2, "b": 1}
    with pytest.raises(ValueError, match="v"):
        A.require_complete(frame)
    assert A.require_complete(frame.select("a")).count() == 3
    assert A.duplicate_rows(frame.unionByName(frame), frame.columns).first()[0] == 3


def test_overview_and_categories_with_missing_values(spark):
    frame = spark.createDataFrame([("Five", 10.0), ("Five", 11.2), (None, 30.0), ("One", None)], "r string, p double")
    assert A.overview(frame, "p", "r").first()[:] == (4, "R$ 17.07", '{"Five":2,"One":1,"null":0}')
    assert A.overview(frame.where("p = 10"), "p", "r").first()["mean_price"] == "R$ 10.0"
    assert {r["r"]: (r["n"], r["mean_price"]) for r in A.category_stats(frame, "r", "p").collect()} == {
        "Five": (2, 10.6), None: (0, 30.0), "One": (1, None)
    }


def test_histogram_edges(spark):
    frame = spark.createDataFrame([(float(v),) for v in (-61, -60, 0, 180, 181)], "v double")
    assert dict(A.histogram(frame, "v", 50, -60, 180).collect()) == {0: 1, 12: 1, 49: 1}
    same = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert dict(A.histogram(same, "v", 20).collect()) == {10: 2}


def test_relative_error_leaves_out_zero(spark):
    frame = spark.createDataFrame([(11.0, 10.0), (9.0, 10.0), (1.0, 0.0)], "p double, y double")
    assert A.relative_error(frame, F.col("p"), F.col("y")).first()[:] == (-10.0, 10.0, 0.0, 10.0)


def test_fills(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("b", None), (None, None)], "k string, v double")
    mean = {(r["k"], r["v"]) for r in W.fill_with_group_mean(frame, "k", "v").collect()}
    assert mean == {("a", 1.0), ("a", 2.0), ("a", 1.5), ("b", None), (None, None)}
    assert sorted(r["v"] for r in W.fill_with_group_floor(frame.where("k = 'a'"), "k", "v").collect()) == [1.0, 1.0, 2.0]
    negative = spark.createDataFrame([("a", -1.0), ("a", -2.0), ("a", None)], "k string, v double")
    assert sorted(r["v"] for r in W.fill_with_group_int(negative, "k", "v").collect()) == [-2, -1, -1]


def test_short_history_repeats_last_row(spark):
    bars = spark.sql("SELECT 's' AS s, DATE '2024-01-01' + CAST(id AS INT) AS d, id * 1.0D AS c FROM range(3)")
    import datetime

    got = W.look_back(bars, "s", "d", ["c"], datetime.date(2024, 1, 9), 5).first()["c"]
    assert got == [0.0, 1.0, 2.0, 2.0, 2.0]
    with pytest.raises(ValueError):
        W.look_back(bars, "s", "d", ["c"], datetime.date(2024, 1, 9), 0)


def test_rows_stay_where_they_lie_when_the_groups_are_few(spark):
    """The size of the groups is measured, not guessed from that of the rows."""
    from tidewell.operators.windows import fill_with_group_floor

    rows = spark.range(2_000_000).select((F.col("id") % 10).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).cast("double").alias("v"))
    keys = F.when(F.col("k") > 0, F.col("k"))
    filled = fill_with_group_floor(rows.withColumn("k", keys), "k", "v")
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert {r["k"] for r in filled.where("v IS NULL").select("k").distinct().collect()} == {None} and filled.count() == 2_000_000
