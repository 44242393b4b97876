"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck
from tidewell.session import RUNTIME_SETTINGS

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db(folder):
    return duck(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, folder, db, name):
    got = QUERIES[name](spark, folder).toArrow()
    assert compare(got, db.sql(SQL[name]).to_arrow_table()) is None


@pytest.mark.parametrize("name", [
    "running_sum", "running_count", "chrono_split", "paginate", "auc_rank", "roc_points", "average_precision", "group_avg_median",
    "trim_outliers", "feature_psi", "hash_split_stratified", "lag_of_ticks", "parent_children", "index_by_frequency", "apply_inserts",
    "replace_table_with_id", "cumulative_regret",
])
def test_many_ranges_give_the_same(spark, folder, db, name, monkeypatch):
    """Small inputs normally end in one range; here every shuffle keeps all of its partitions."""
    monkeypatch.setitem(RUNTIME_SETTINGS, "spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = QUERIES[name](spark, folder).toArrow()
    monkeypatch.undo()
    assert compare(got, db.sql(SQL[name]).to_arrow_table()) is None


@pytest.mark.parametrize("name", ["join_agg_back", "join_multikey", "target_encode", "score_distinct", "join_order_lines", "tfidf_weights", "apply_changes", "unique_key_guard"])
def test_hot_keys_give_the_same(spark, folder, db, name, monkeypatch):
    """Small inputs have no hot keys; here every key with a thousandth of the rows is one."""
    monkeypatch.setattr("tidewell.operators.attach.HOT_ROWS", 1)
    got = QUERIES[name](spark, folder).toArrow()
    assert compare(got, db.sql(SQL[name]).to_arrow_table()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_gives_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0 and "moving_mean" in frame.columns


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
