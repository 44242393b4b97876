"""Metrics, features, models, offers and monitoring."""

import datetime
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions.columns import uniform
from tidewell.operators import features as E
from tidewell.operators import forecast as G
from tidewell.operators import metrics as Q
from tidewell.operators import models as M
from tidewell.operators import monitor as D
from tidewell.operators import offers as B

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    rows = [(i, round(rng.random(), 2), int(rng.random() < 0.3)) for i in range(300)]
    return rows, spark.createDataFrame(rows, "i int, score double, y int")


def test_auc_counts_pairs(scored):
    rows, frame = scored
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    won = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg))
    for parts in (1, 13):
        got = Q.area_under_roc(frame.repartition(parts), "score", "y").first()["auc"]
        assert got == pytest.approx(won / len(pos) / len(neg), abs=1e-12)


def test_average_precision_steps(scored):
    rows, frame = scored
    total, got, tp, n = sum(y for *_, y in rows), 0.0, 0, 0
    for _, level in itertools.groupby(sorted(rows, key=lambda r: -r[1]), key=lambda r: r[1]):
        ys = [y for *_, y in level]
        tp, n = tp + sum(ys), n + len(ys)
        got += tp / n * sum(ys) / total
    assert Q.average_precision(frame, "score", "y").first()[0] == pytest.approx(got, abs=1e-12)


def test_one_class_has_no_auc(spark):
    assert Q.area_under_roc(spark.createDataFrame([(0.1, 1)], "s double, y int"), "s", "y").first()[0] is None


def test_scaling_there_and_back(spark):
    frame = spark.createDataFrame([(i, float(v), 4.0) for i, v in enumerate((3, 9, 27))], "i int, v double, c double")
    fitted = E.fit_range(frame, ["v", "c"])
    scaled = E.scale_minmax(frame, fitted, ["v", "c"], 0.0, 1.0)
    assert sorted((r["v"], r["c"]) for r in scaled.collect()) == [(0.0, 0.0), (0.25, 0.0), (1.0, 0.0)]
    back = E.scale_minmax(scaled, fitted, ["v", "c"], 0.0, 1.0, inverse=True)
    assert sorted(r["v"] for r in back.collect()) == [3.0, 9.0, 27.0]
    z = E.scale_population(frame, ["v", "c"]).agg(F.avg("v"), F.stddev_pop("v"), F.max("c")).first()
    assert z[:] == pytest.approx((0, 1, 0), abs=1e-12)


def test_codes_and_unknown(spark):
    frame = spark.createDataFrame([("b",), ("b",), ("a",), ("c",), (None,)], "k string")
    codes = E.category_codes(frame, "k")
    assert {r["k"]: r["code"] for r in codes.collect()} == {"b": 0, "a": 1, "c": 2}
    new = spark.createDataFrame([("zz",), ("c",)], "k string")
    assert {r["k"]: r["code"] for r in E.encode(new, codes, "k", "code").collect()} == {"zz": 0, "c": 2}


def test_stratified_split_is_exact_and_stable(spark):
    frame = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    parts = {
        n: sorted(r["id"] for r in E.hash_split(frame.repartition(n), ["id"], 0.2, strata="y").where("part = 'test'").collect())
        for n in (1, 9)
    }
    assert parts[1] == parts[9] and len(parts[1]) == 200 and sum(i % 10 == 0 for i in parts[1]) == 20


def test_model_floors(spark, folder):
    from tidewell.plans import models as plans

    rows = plans._quality_rows(spark, "/root/testdata/sf0.01")
    fitted = M.apply_binary(M.fit_binary(rows, plans.FEATURES, "quality"), rows)
    crude = Q.area_under_roc(rows, "distinct_share", "quality").first()["auc"]
    assert max(0.5, crude) < Q.area_under_roc(fitted, "score", "quality").first()["auc"] <= 1


def test_poisson_weights(spark):
    draws = spark.range(200_000).select(M.poisson_weight(uniform(F.col("id"))).alias("w")).agg(F.avg("w"), F.var_pop("w"), F.max("w")).first()
    assert draws[0] == pytest.approx(1, abs=0.01) and draws[1] == pytest.approx(1, abs=0.02) and draws[2] > 5
    assert spark.range(1).select(M.poisson_weight(F.lit(1 - 2.0**-32))).first()[0] > 9


def test_ensemble_has_the_sample_deviation(spark):
    train = spark.range(400).select(F.col("id"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    models = M.bootstrap_models(train, ["x"], "y", "id", members=4)
    row = M.ensemble_estimate(models, train.limit(1)).first()
    scores = [M.apply_binary(m, train.limit(1)).first()["score"] for m in models]
    assert row["mean"] == pytest.approx(np.mean(scores)) and row["std"] == pytest.approx(np.std(scores, ddof=1))


def test_earliest_outcome_within_the_horizon(spark):
    """One before the decision and one after the horizon do not hide the one between."""
    from tidewell.operators.joins import join_outcomes

    day = lambda n: datetime.datetime(2024, 1, n)
    events = spark.createDataFrame([(1, day(10)), (1, day(20)), (2, day(10)), (3, None)], "k int, decided timestamp")
    outcomes = spark.createDataFrame(
        [(1, 0, day(9)), (1, 1, day(12)), (1, 1, day(11)), (1, 0, day(30)), (2, 1, day(13)), (3, 1, day(1))], "k int, reward int, observed timestamp"
    )
    got = join_outcomes(events, outcomes, "k", "observed", decided="decided", horizon_days=2).collect()
    assert {(r.k, r.decided, r.reward, r.observed) for r in got} == {
        (1, day(10), 1, day(11)), (1, day(20), 0, None), (2, day(10), 0, None), (3, None, 0, None)
    }


def test_unknown_segments_have_equal_shares(spark):
    people = spark.createDataFrame([(1, "A_reativacao_positiva"), (2, None), (3, "?")], "client int, segment string")
    got = B.offer_propensity(people, "segment", B.offer_table(spark)).collect()
    assert len(got) == 15 and {r.propensity for r in got if r.client > 1} == {0.2}


def test_one_decision_for_a_golden_case(spark):
    cases = spark.createDataFrame([(1, "a"), (2, "a")], "event_id int, arm_expected string")
    made = spark.createDataFrame([(1, "b", 1.0), (1, "a", 7.0), (9, "a", 1.0)], "event_id int, arm_chosen string, estimated_conversion double")
    got = {r.event_id: (r.passed, r.error) for r in B.golden_evaluate(cases, made, "event_id").collect()}
    assert got == {1: (True, None), 2: (False, "no decision")}


def test_forest_learns(spark):
    rows = spark.range(2000).select((F.col("id") % 50).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("noise"))
    rows = rows.withColumn("y", F.col("x") * 3 + F.col("noise"))
    model = M.fit_forest(rows, ["x", "noise"], "y", trees=5)
    errors = Q.regression_errors(model.transform(rows), "prediction", "y").first()
    assert errors["rmse"] < 0.5 * rows.agg(F.stddev_pop("y")).first()[0]


def test_pca_directions(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    matrix = np.array([r["embedding"] for r in rows], dtype=float)
    _, vectors = np.linalg.eigh(np.cov(matrix.T))
    want = np.abs(matrix @ vectors[:, ::-1][:, :2])
    projected = M.project(M.with_vector(spark.read.parquet(f"{folder}/embeddings.parquet"), "embedding"), "features")
    got = {r["vec_id"]: r["pca"].toArray() for r in projected.collect()}
    assert np.abs(np.array([got[r["vec_id"]] for r in rows])) == pytest.approx(want, abs=1e-6)


def test_missing_model_is_refused():
    with pytest.raises(FileNotFoundError):
        M.load_model("/tmp/tidewell-no-such-model")


def linear_bars(spark):
    rows = [(s, datetime.date(2024, 1, 1) + datetime.timedelta(days=i), 10.0 * k + 2.0 * i, 5) for k, s in enumerate("ab") for i in range(40)]
    return spark.createDataFrame(rows, "series string, day date, close double, volume bigint")


def test_forecast_follows_a_line(spark):
    bars = linear_bars(spark)
    model = G.fit_direct(bars, "series", "day", lags=4, horizon=3, ridge=0.0)
    ref = datetime.date(2024, 1, 1) + datetime.timedelta(days=39)
    ahead = G.forecast_recursive(bars, "series", "day", model, ref, days=8)
    # lags are t-4..t-1 for targets t+1.., so the look-back's last row stands for t-1
    got = {(r["series"], (r["day"] - ref).days): r["predicted_close"] for r in ahead.collect()}
    assert len(got) == 16
    assert [got["a", d] for d in (1, 2, 3)] == pytest.approx([82.0, 84.0, 86.0], abs=0.5)
    direct = {r["day"]: r for r in G.predict_direct(bars, "series", "day", model).where("series = 'a'").collect()}
    assert direct[ref]["forecast1"] == pytest.approx(80.0, abs=0.5)
    both = G.history_and_forecast(bars, "series", "day", ahead, ref, 4)
    assert both.count() == 2 * (5 + 8)
    with pytest.raises(ValueError):
        G.forecast_recursive(bars, "series", "day", model, ref, days=0)


def test_trend(spark):
    assert {r["slope"] for r in G.series_trend(linear_bars(spark), "series", "day", "close").collect()} == {2.0}
    one = linear_bars(spark).where("day = DATE '2024-01-01'")
    assert {r["slope"] for r in G.series_trend(one, "series", "day", "close").collect()} == {None}


def test_thompson_prefers_the_better_offer(spark):
    log = spark.createDataFrame(
        [("A_reativacao_positiva", "cashback", int(i % 10 != 0)) for i in range(500)]
        + [("A_reativacao_positiva", a, int(i % 50 == 0)) for a in B.ARMS if a != "cashback" for i in range(500)],
        "segment string, arm string, reward int",
    )
    estimates = B.posterior_estimates(log, "segment", "arm", "reward")
    assert estimates.count() == 25
    clients = spark.range(200).select(F.col("id").alias("client"), F.lit("A_reativacao_positiva").alias("segment"))
    chosen = B.thompson_choose(clients, "client", "segment", estimates)
    assert chosen.where("arm_chosen = 'cashback'").count() == 200
    assert chosen.where("ts_sample NOT BETWEEN 0 AND 1 OR estimated_conversion NOT BETWEEN 0 AND 100").count() == 0
    again = B.thompson_choose(clients.repartition(7), "client", "segment", estimates)
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, again.collect()))


def test_propensities_sum_to_one(spark, folder):
    sums = entry.queries()["offer_propensity"](spark, folder).groupBy("client").agg(F.sum("propensity").alias("s"))
    assert sums.where("abs(s - 1) > 1e-6").count() == 0


def test_golden_without_decision_fails(spark):
    cases = spark.createDataFrame([(1, "edge", "cashback"), (2, "edge", "cashback"), (3, "random", "x")], "id int, case_type string, arm_expected string")
    made = spark.createDataFrame([(1, "cashback", 1.0), (2, "previdencia", 5.01)], "id int, arm_chosen string, estimated_conversion double")
    judged = B.golden_evaluate(cases, made, "id")
    assert {r["id"]: (r["passed"], r["error"]) for r in judged.collect()} == {1: (True, None), 2: (True, None), 3: (False, "no decision")}
    assert {r["kind"]: r["pass_rate"] for r in B.pass_rates(judged, "case_type").collect()} == {"edge": 1.0, "random": 0.0, "all": 0.667}


def test_outcome_delays(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES (1, TIMESTAMP_NTZ '2024-01-01', TIMESTAMP_NTZ '2024-01-01 05:00:00', 1),"
        " (2, TIMESTAMP_NTZ '2024-01-01', TIMESTAMP_NTZ '2024-01-31', 1), (3, TIMESTAMP_NTZ '2024-01-01', NULL, 0) t(i, d, o, reward)"
    )
    got = {r["i"]: (r["delay_days"], r["reward_observed_at"].day) for r in B.outcome_times(rows, "d", "o").collect()}
    assert got == {1: (1, 2), 2: (31, 1), 3: (30, 31)}


def psi_direct(expected, actual, bins=10):
    edges = np.unique(np.percentile(expected, np.linspace(0, 100, bins + 1)))
    if len(edges) < 2:
        return 0.0
    e, a = (np.histogram(v, bins=edges)[0] / len(v) for v in (expected, actual))
    e, a = np.where(e == 0, 1e-4, e), np.where(a == 0, 1e-4, a)
    return float(np.sum((a - e) * np.log(a / e)))


def test_psi_equals_numpy(spark):
    rng = np.random.default_rng(5)
    old = {"age": rng.integers(18, 80, 500).astype(float), "few": rng.integers(0, 3, 500).astype(float), "flat": np.full(500, 7.0), "wide": rng.normal(0, 1, 500)}
    new = {"age": rng.integers(30, 95, 300).astype(float), "few": np.zeros(300), "flat": rng.normal(0, 1, 300), "wide": rng.normal(0.1, 1, 300)}
    frame = lambda side: spark.createDataFrame([tuple(map(float, r)) for r in zip(*side.values())], ", ".join(f"{c} double" for c in side))
    got = {r["column_name"]: r["psi"] for r in D.feature_psi(frame(old), frame(new), list(old)).collect()}
    assert got == pytest.approx({c: round(psi_direct(old[c], new[c]), 4) for c in old}, abs=1e-4)
    same = D.feature_psi(frame(old), frame(old), list(old)).collect()
    assert {r["psi"] for r in same} == {0.0} and {r["status"] for r in same} == {"stable"}


def test_drift_uses_previous_existing_window(spark):
    rows = [(datetime.datetime(2024, 1, 1 + d), r) for d, r in ((0, 1), (1, 0), (20, 1), (21, 1), (25, 0))]
    got = D.outcome_drift(spark.createDataFrame(rows, "at timestamp, reward int"), "at", "reward").orderBy("window").collect()
    assert [(r["window"], r["n_obs"], r["previous_rate"], r["drift"]) for r in got] == [(0, 2, None, False), (2, 1, 0.5, True), (3, 2, 1.0, True)]


def test_gate_and_versions(spark):
    new = spark.createDataFrame([("a", 0.70), ("b", 0.59), ("c", 0.64)], "version string, auc double")
    now = spark.createDataFrame([(0.67,)], "auc double")
    assert {r["version"]: r["status"] for r in D.approval_gate(new, now).collect()} == {
        "a": "approved", "b": "pending_human_approval", "c": "pending_human_approval"
    }
    first = D.approval_gate(new, now.where("auc > 1"))
    assert {r["version"]: (r["delta"], r["approved_by"]) for r in first.collect()} == {"a": (0.0, "auto_gate"), "b": (0.0, None), "c": (0.0, "auto_gate")}
    strict = D.approval_gate(new, now, golden_rate=F.lit(0.9))
    assert strict.where("status = 'approved'").count() == 0
    log = spark.createDataFrame(
        [(1, "v1", "candidate"), (2, "v1", "production"), (3, "v2", "approved"), (4, "v2", "production"), (5, "v3", "candidate")],
        "seq bigint, version string, status string",
    )
    states = lambda frame: {r["version"]: (r["state"], r["can_roll_back"]) for r in D.version_states(frame).collect()}
    assert states(log) == {"v1": ("retired", True), "v2": ("production", False), "v3": ("candidate", False)}
    assert states(D.roll_back(log, "v1"))["v1"] == ("production", False)
    assert D.roll_back(log, "v3").count() == 5 and D.roll_back(log, "v9").count() == 5
