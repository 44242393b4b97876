"""Shape of the physical plans."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewell.operators.windows import lag_matrix
from tidewell.plans.common import bars



def physical(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def queries():
    return entry.queries()


def test_lags_share_one_window(spark, folder):
    narrow = bars(spark, folder).select("series", "day", "close", "volume")
    plan = lag_matrix(narrow, "series", "day", ["close", "volume"], 30)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bWindow \[", plan)) == 1


@pytest.mark.parametrize("name, pushed", [
    ("filter_equals", "EqualTo(o_orderstatus,F)"), ("filter_range", "LessThanOrEqual(p_retailprice,1100.0)"),
    ("filter_range_open", "GreaterThanOrEqual(o_totalprice,250000.0)"), ("join_outcomes_left", "event_type"),
    ("search_contains", "IsNotNull(p_name)"),
])
def test_filters_reach_the_scan(spark, folder, queries, name, pushed):
    assert pushed in re.findall(r"PushedFilters: \[[^\]]*\]", physical(queries[name](spark, folder)))[0]


@pytest.mark.parametrize("name, columns", [
    ("group_stats", {"l_partkey", "l_suppkey", "l_extendedprice"}), ("running_sum", None), ("date_key", {"o_orderkey", "o_orderdate"}),
    ("distinct_count", {"l_partkey"}), ("value_counts", {"event_type"}), ("histogram", {"l_extendedprice"}),
])
def test_scans_read_only_what_is_used(spark, folder, queries, name, columns):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", physical(queries[name](spark, folder)))
    assert schemas
    if columns:
        assert {part.split(":")[0] for s in schemas for part in s.split(",")} == columns


@pytest.mark.parametrize("name", ["candle_features", "group_stats", "daily_ohlcv", "reward_drift", "segment_fairness", "policy_metrics"])
def test_aggregates_combine_before_the_shuffle(spark, folder, queries, name):
    plan = physical(queries[name](spark, folder))
    assert "partial_" in plan


def test_no_sampled_cross_products(spark, folder, queries):
    """A nested-loop join is only ever against one broadcast row or a fixed list."""
    for name in ("thompson_choose", "offer_propensity", "cross_client_offer", "scale_minmax", "trim_outliers"):
        plan = physical(queries[name](spark, folder))
        assert "CartesianProduct" not in plan
        for line in plan.splitlines():
            if "BroadcastNestedLoopJoin" in line:
                assert "BuildRight" in line or "BuildLeft" in line


def test_choice_needs_no_shuffle_of_clients(spark, folder, queries):
    plan = queries["thompson_choose"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan.split("estimates")[0]


@pytest.mark.parametrize("name", ["running_sum", "running_count", "chrono_split", "roc_points"])
def test_row_windows_are_split_by_range(spark, folder, queries, name):
    windows = re.findall(r"windowspecdefinition\(([^)]*)\)", queries[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString())
    assert windows and all("_tw_range" in w for w in windows if "specifiedwindowframe(RowFrame, unboundedpreceding$(), currentrow$()" in w)
    assert any("_tw_range" in w for w in windows)


def test_keyless_numbers_need_one_shuffle(spark):
    from tidewell.operators.ordered import number_rows

    seen = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("tidewell.operators.ordered.stage", lambda df, label: seen.append(physical(df)) or df)
        plan = physical(number_rows(spark.range(1000).select("id"), [], [F.col("id").desc()], total="n"))
    assert seen[0].count("Exchange") == 1 and "rangepartitioning" in seen[0]
    # on top of the ranges: their sizes only
    assert "hashpartitioning(id" not in plan and plan.count("rangepartitioning") <= 2


def test_released_scratch_is_gone(spark):
    import os

    from tidewell import session

    path = session.stage(spark.range(3), "gone").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    kept, session._staged[:] = session._staged[:-1], session._staged[-1:]
    assert session.release_staged(spark) == 1 and not os.path.exists(path)
    session._staged[:] = kept


def test_repartitioning_does_not_change_results(spark, folder, queries, tmp_path):
    """Same hashes from inputs in one file and in many."""

    target = tmp_path / "many"
    target.mkdir()
    for name in ("events", "customer", "orders", "lineitem", "part"):
        source = spark.read.parquet(f"{folder}/{name}.parquet")
        source.repartition(17).write.parquet(f"{target}/{name}.parquet")
    for name in ("candle_features", "running_sum", "paginate", "pick_one_per_group", "hash_split", "golden_select", "thompson_choose", "apply_changes", "chrono_split", "join_agg_back"):
        digest = [
            frame.agg(F.sum(F.xxhash64(*sorted(frame.columns)).cast("decimal(38,0)"))).first()[0]
            for frame in (queries[name](spark, folder), queries[name](spark, str(target)))
        ]
        assert digest[0] == digest[1], name


def executed(plan):
    """All nodes of a plan that has run, through adaptive stages."""
    kind = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
    inner = [plan.child()] if kind == "ReusedExchangeExec" else inner
    children = plan.children()
    found = [plan]
    for child in inner or [children.apply(i) for i in range(children.size())]:
        found += executed(child)
    return found


@pytest.mark.parametrize("name", ["thompson_choose", "offer_propensity", "cross_client_offer", "scale_minmax", "trim_outliers", "bootstrap_estimates"])
def test_broadcast_sides_are_small(spark, folder, queries, name):
    """What is sent to every executor is a row or a short list, by the rows that Spark counted."""
    df = queries[name](spark, folder)
    df.collect()
    nodes = executed(df._jdf.queryExecution().executedPlan())
    joins = [n for n in nodes if n.getClass().getSimpleName() == "BroadcastNestedLoopJoinExec"]
    assert not any(n.getClass().getSimpleName() == "CartesianProductExec" for n in nodes)

    def sent(plan):
        return [n.metrics().apply("numOutputRows").value() for n in executed(plan) if n.getClass().getSimpleName() == "BroadcastExchangeExec"]

    for join in joins:
        side = join.right() if "Right" in join.buildSide().toString() else join.left()
        assert sent(side)[0] <= 25
    # what Spark itself found small enough to send
    assert all(rows < 1000 for rows in sent(df._jdf.queryExecution().executedPlan()))


def test_clients_are_not_shuffled_for_a_choice(spark, folder, queries):
    plan = physical(queries["thompson_choose"](spark, folder))
    moved = re.findall(r"Exchange ([^\n]*)", plan)
    assert moved and not any(m.startswith("hashpartitioning") and "client" in m for m in moved) and "rangepartitioning" not in plan


def test_a_large_table_is_no_fixed_dimension(spark):
    from tidewell.operators.joins import pair_with_all

    with pytest.raises(ValueError):
        pair_with_all(spark.range(3), spark.range(20_000).withColumnRenamed("id", "other"))


def test_narrow_inputs_are_spread(spark, tmp_path):
    from tidewell.session import spread

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    held = spread(one).groupBy(F.spark_partition_id()).count().collect()
    assert len(held) == 8 and max(r["count"] for r in held) < 200 and sum(r["count"] for r in held) == 1000
    many = spark.range(1000).repartition(8)
    assert spread(many) is many and spread(one.limit(0)).count() == 0
