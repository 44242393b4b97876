"""Queries of the feature, model, evaluation and forecast operators."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import features as E
from tidewell.operators import forecast as G
from tidewell.operators import metrics as Q
from tidewell.operators import models as M
from tidewell.operators.aggregates import mean_of, nan_profile
from tidewell.operators.joins import score_distinct, with_group_stats
from tidewell.operators.relational import trim_outliers
from tidewell.operators.windows import daily_bars, look_back
from tidewell.plans.aggregates import mean_sql
from tidewell.plans.common import PLACES, SCORED, scored_labels
from tidewell.plans.registry import query
from tidewell.plans.relational import LINE_KEY, LINE_KEY_SQL
from tidewell.session import scratch_path, stage
from tidewell.tables import load


@query("index_by_frequency", """
WITH c AS (SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS code FROM orders GROUP BY 1)
SELECT o_orderkey, o_orderpriority, CAST(code AS INTEGER) AS code FROM orders JOIN c USING (o_orderpriority)""")
def index_by_frequency(spark, d):
    rows = load(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return E.encode(rows, E.category_codes(rows, "o_orderpriority"), "o_orderpriority", "code")


@query("index_alphabetical", """
SELECT p_partkey, p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS code FROM part""")
def index_alphabetical(spark, d):
    rows = load(spark, d, "part").select("p_partkey", "p_brand")
    return E.encode(rows, E.category_codes(rows, "p_brand", by="alphabet"), "p_brand", "code")


@query("onehot_vector", """
WITH c AS (SELECT p_type, row_number() OVER (ORDER BY count(*) DESC, p_type) - 1 AS code FROM part GROUP BY 1),
n AS (SELECT count(*) AS n FROM c)
SELECT p_partkey, list_transform(range(n - 1), lambda i: CASE WHEN i = code THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS type_vector
FROM part JOIN c USING (p_type), n""")
def onehot_vector(spark, d):
    return E.one_hot_vector(load(spark, d, "part").select("p_partkey", "p_type"), "p_type", "type_vector").drop("p_type")


@query("onehot_sparse", """
WITH c AS (SELECT o_custkey, row_number() OVER (ORDER BY count(*) DESC, o_custkey) - 1 AS code FROM orders GROUP BY 1), n AS (SELECT count(*) - 1 AS n FROM c)
SELECT o_orderkey, {'size': CAST(n AS INTEGER), 'indices': CASE WHEN code < n THEN [CAST(code AS INTEGER)] ELSE []::INTEGER[] END,
  'values': CASE WHEN code < n THEN [1.0::DOUBLE] ELSE []::DOUBLE[] END} AS customer FROM orders JOIN c USING (o_custkey), n""")
def onehot_sparse(spark, d):
    """One-hot over as many categories as there are customers, as size, index and value."""
    return E.one_hot_sparse(load(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "customer").drop("o_custkey")


@query("onehot_columns", """
SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS "o_orderstatus_F", CAST(o_orderstatus = 'O' AS INTEGER) AS "o_orderstatus_O",
  CAST(o_orderstatus = 'P' AS INTEGER) AS "o_orderstatus_P" FROM orders""")
def onehot_columns(spark, d):
    return E.one_hot_columns(load(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@query("onehot_pairs", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code, 1 AS value FROM orders""")
def onehot_pairs(spark, d):
    return E.one_hot_pairs(load(spark, d, "orders"), ["o_orderkey"], "o_orderpriority")


@query("target_encode", f"""
SELECT {LINE_KEY_SQL}, CAST(sum(CAST(l_tax AS DECIMAL(24,4))) OVER r AS DOUBLE) / count(l_tax) OVER r AS route_rate, count(*) OVER r AS route_count,
  CAST(sum(CAST(l_tax AS DECIMAL(24,4))) OVER t AS DOUBLE) / count(l_tax) OVER t AS tail_rate, count(*) OVER t AS tail_count
FROM lineitem WINDOW r AS (PARTITION BY l_partkey, l_suppkey), t AS (PARTITION BY l_suppkey)""")
def target_encode(spark, d):
    rows = load(spark, d, "lineitem").select(*LINE_KEY, "l_tax")
    routed = E.target_statistics(rows, ["l_partkey", "l_suppkey"], "l_tax", "route", decimals=PLACES)
    return E.target_statistics(routed, ["l_suppkey"], "l_tax", "tail", decimals=PLACES).drop("l_tax")


@query("target_encode_train", f"""
WITH s AS (SELECT l_suppkey, {mean_sql('l_tax')} AS tail_rate, count(*) AS tail_count FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1)
SELECT {LINE_KEY_SQL}, tail_rate, tail_count FROM lineitem LEFT JOIN s USING (l_suppkey)""")
def target_encode_train(spark, d):
    rows = load(spark, d, "lineitem").select(*LINE_KEY, "l_tax")
    train = F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    return E.target_statistics(rows, ["l_suppkey"], "l_tax", "tail", train=train, decimals=PLACES).drop("l_tax")


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount"]


@query("assemble_features", f"SELECT {LINE_KEY_SQL}, [l_quantity, l_extendedprice, l_discount] AS features FROM lineitem")
def assemble_features(spark, d):
    vectors = E.assemble(load(spark, d, "lineitem"), NUMERIC)
    return vectors.select(*LINE_KEY, vector_to_array("features").alias("features"))


@query("scale_standard", f"""
SELECT {LINE_KEY_SQL}, round(l_quantity / stddev_samp(l_quantity) OVER (), 6) AS quantity, round(l_tax / stddev_samp(l_tax) OVER (), 6) AS tax FROM lineitem""")
def scale_standard(spark, d):
    scaled = E.scale_standard(load(spark, d, "lineitem"), ["l_quantity", "l_tax"])
    values = vector_to_array("scaled")
    return scaled.select(*LINE_KEY, F.round(values[0], 6).alias("quantity"), F.round(values[1], 6).alias("tax"))


@query("scale_population", f"""
SELECT {LINE_KEY_SQL}, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity,
  round((l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER (), 6) AS l_tax FROM lineitem""")
def scale_population(spark, d):
    rows = load(spark, d, "lineitem").select(*LINE_KEY, "l_quantity", "l_tax")
    scaled = E.scale_population(rows, ["l_quantity", "l_tax"])
    return scaled.withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_tax")})


@query("scale_minmax", f"""
WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, round((l_extendedprice - lo) / (hi - lo) * 2 - 1, 6) AS scaled, round(l_extendedprice, 2) AS restored FROM lineitem, r""")
def scale_minmax(spark, d):
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    fitted = E.fit_range(rows, ["l_extendedprice"])
    scaled = E.scale_minmax(rows, fitted, ["l_extendedprice"])
    back = E.scale_minmax(scaled.withColumn("scaled", F.col("l_extendedprice")), fitted, ["l_extendedprice"], inverse=True)
    return back.withColumn("scaled", F.round("scaled", 6)).withColumn("restored", F.round("l_extendedprice", 2)).drop("l_extendedprice")


@query("nan_guard", """
SELECT 'l_quantity' AS column_name, count(*) FILTER (l_orderkey % 8 = 0) AS missing FROM lineitem
UNION ALL SELECT 'l_tax', count(*) FILTER (l_partkey % 9 = 0) FROM lineitem
UNION ALL SELECT 'l_discount', 0 FROM lineitem GROUP BY 1""")
def nan_guard(spark, d):
    rows = load(spark, d, "lineitem").select(
        F.when(F.col("l_orderkey") % 8 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_partkey") % 9 != 0, F.col("l_tax")).alias("l_tax"),
        "l_discount",
    )
    return nan_profile(rows)


UNIFORM = "CAST('0x' || substr(md5({} || '|{}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query("hash_split", f"""
SELECT o_orderkey, CASE WHEN {UNIFORM.format('o_orderkey', 42)} < 0.2 THEN 'test' ELSE 'train' END AS part FROM orders""")
def hash_split(spark, d):
    return E.hash_split(load(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], test=0.2)


@query("hash_split_stratified", f"""
WITH u AS (SELECT o_orderkey, o_orderstatus, {UNIFORM.format('o_orderkey', 42)} AS u FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY u, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM u)
SELECT o_orderkey, o_orderstatus, CASE WHEN rn <= round(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM p""")
def hash_split_stratified(spark, d):
    return E.hash_split(load(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], test=0.2, strata="o_orderstatus")


@query("hash_sample", f"SELECT o_orderkey, o_totalprice FROM orders WHERE {UNIFORM.format('o_orderkey', 42)} < 0.01")
def hash_sample(spark, d):
    return E.hash_sample(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 0.01)


@query("class_weights", """
SELECT doc_id, quality, CASE WHEN quality = 1 THEN (count(*) FILTER (quality = 0) OVER ()) / (count(*) FILTER (quality = 1) OVER ()) ELSE 1.0::DOUBLE END AS weight FROM labels""")
def class_weights(spark, d):
    return E.class_weights(load(spark, d, "labels").select("doc_id", "quality"), "quality")


@query("auc_rank", f"""
WITH {SCORED}, r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM scored)
SELECT round((sum(rk) FILTER (quality = 1) - (count(*) FILTER (quality = 1)) * (count(*) FILTER (quality = 1) + 1) / 2)
  / ((count(*) FILTER (quality = 1)) * (count(*) FILTER (quality = 0))), 9) AS auc FROM r""")
def auc_rank(spark, d):
    return Q.area_under_roc(scored_labels(spark, d), "score", "quality").select(F.round("auc", 9).alias("auc"))


@query("average_precision", f"""
WITH {SCORED}, g AS (SELECT score, sum(quality) AS pos, count(*) AS n FROM scored GROUP BY 1),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM g WINDOW w AS (ORDER BY score DESC))
SELECT round(sum(tp / seen * pos / (SELECT sum(quality) FROM scored)), 9) AS average_precision FROM c""")
def average_precision(spark, d):
    scored = Q.average_precision(scored_labels(spark, d), "score", "quality")
    return scored.select(F.round("average_precision", 9).alias("average_precision"))


@query("roc_points", f"""
WITH {SCORED}, g AS (SELECT score, sum(quality) AS pos, count(*) - sum(quality) AS neg FROM scored GROUP BY 1)
SELECT score AS threshold, sum(neg) OVER w / (SELECT sum(1 - quality) FROM scored) AS fpr, sum(pos) OVER w / (SELECT sum(quality) FROM scored) AS tpr
FROM g WINDOW w AS (ORDER BY score DESC)""")
def roc_points(spark, d):
    return Q.roc_points(scored_labels(spark, d), "score", "quality")


@query("regression_errors", """
WITH m AS (SELECT l_extendedprice AS y, CAST(sum(CAST(l_extendedprice AS DECIMAL(24,4))) OVER w AS DOUBLE) / count(*) OVER w AS p
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey))
SELECT round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(avg(abs(p - y)), 4) AS mae, round(avg((p - y) * (p - y)), 1) AS mse FROM m""")
def regression_errors(spark, d):
    rows = load(spark, d, "lineitem").select("l_suppkey", "l_extendedprice")
    predicted = with_group_stats(rows, ["l_suppkey"], {"p": mean_of(F.col("l_extendedprice"), PLACES)})
    errors = Q.regression_errors(predicted, "p", "l_extendedprice")
    return errors.select(F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("mse", 1).alias("mse"))


# --- fitted models: a fit has no SQL, what must hold for it has ---


def _quality_rows(spark, d):
    rows = scored_labels(spark, d).withColumnRenamed("score", "distinct_share")
    return stage(E.hash_split(rows, ["doc_id"]), "quality")


FEATURES = ["distinct_share", "n_words", "n_chars"]


@query("fit_logistic", f"""
WITH {SCORED} SELECT doc_id, CASE WHEN {UNIFORM.format('doc_id', 42)} < 0.2 THEN 'test' ELSE 'train' END AS part, true AS in_range, true AS decided FROM scored""")
def fit_logistic(spark, d):
    """Per row: the score is a probability, and the prediction is the side of one half it lies on."""
    rows = _quality_rows(spark, d)
    scored = M.apply_binary(M.fit_binary(rows.where("part = 'train'"), FEATURES, "quality"), rows)
    return scored.select(
        "doc_id", "part", F.col("score").between(0, 1).alias("in_range"), (F.col("prediction") == (F.col("score") > 0.5).cast("int")).alias("decided")
    )


@query("fit_logistic_gradient", f"""
WITH {SCORED} SELECT count(*) AS n_train, true AS level_fits, true AS features_fit FROM scored WHERE {UNIFORM.format('doc_id', 42)} >= 0.2""")
def fit_logistic_gradient(spark, d):
    """At the optimum the errors of the training rows are uncorrelated with every feature and with a constant."""
    train = _quality_rows(spark, d).where("part = 'train'")
    scored = M.apply_binary(M.fit_binary(train, FEATURES, "quality"), train)
    miss = F.col("score") - F.col("quality")
    slopes = [F.abs(F.avg(miss * F.col(c)) / F.greatest(F.stddev(F.col(c).cast("double")), F.lit(1e-9))) for c in FEATURES]
    return scored.agg(
        F.count("*").alias("n_train"), (F.abs(F.avg(miss)) < 1e-3).alias("level_fits"), (F.greatest(*slopes) < 1e-2).alias("features_fit")
    )


def _vectors(spark, d):
    rows = load(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("double").alias("label"))
    return stage(rows, "embeddings")


@query("fit_multiclass", f"""
WITH t AS (SELECT label, count(*) AS n FROM embeddings WHERE {UNIFORM.format('vec_id', 42)} < 0.2 GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_test, true AS learns, true AS holds FROM t""")
def fit_multiclass(spark, d):
    """On its own rows the model beats always naming the most frequent label; on rows held out it finds a planted label, which of
    three components is largest, far more often than that."""
    rows = E.hash_split(M.with_vector(_vectors(spark, d), "embedding"), ["vec_id"])
    first = F.transform(F.slice("embedding", 1, 3), lambda x: x)
    rows = rows.withColumn("planted", (F.array_position(first, F.array_max(first)) - 1).cast("double"))

    def accuracy(label, part):
        model = M.fit_multiclass(rows.where("part = 'train'"), "features", label)
        return Q.accuracy(model.transform(rows.where(F.col("part") == part)), "prediction", label).first()["accuracy"]

    def most(label, part):
        counts = rows.where(F.col("part") == part).groupBy(label).count().agg(F.max("count"), F.sum("count")).first()
        return counts[0] / counts[1]

    learns = accuracy("label", "train") > most("label", "train")
    holds = accuracy("planted", "test") > most("planted", "test") + 0.15
    facts = rows.where("part = 'test'").agg(F.count("*").alias("n_test"))
    return facts.select("n_test", F.lit(learns).alias("learns"), F.lit(holds).alias("holds"))


FOREST = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query("fit_forest", f"""
WITH limits AS (SELECT quantile_cont(l_extendedprice, 0.99) AS q FROM lineitem),
kept AS (SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, 174)) AS h FROM lineitem, limits WHERE l_extendedprice > 0 AND l_extendedprice <= q)
SELECT count(*) AS n_test, true AS near_deviation, true AS gains FROM kept WHERE CAST('0x' || substr(h, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.2""")
def fit_forest(spark, d):
    """A regression on the trimmed positive targets; its error on held-out rows against their deviation.

    The columns of this table say nothing about the price, so the error cannot be far below it. A planted target that follows two of the
    columns must be met with less than half of its deviation.
    """
    rows = trim_outliers(load(spark, d, "lineitem"), "l_extendedprice", 0.99)
    split = E.hash_split(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], seed=174)
    rows = stage(split.select(*FOREST, "l_extendedprice", "part"), "forest")
    test = rows.where("part = 'test'")
    model = M.fit_forest(rows.where("part = 'train'"), FOREST, "l_extendedprice")
    errors = Q.regression_errors(model.transform(test), "prediction", "l_extendedprice")
    spread = test.agg(F.count("*").alias("n_test"), F.stddev("l_extendedprice").alias("deviation"))
    plain = errors.crossJoin(F.broadcast(spread)).select("n_test", (F.col("rmse") < 1.1 * F.col("deviation")).alias("near_deviation"))
    planted = rows.withColumn("target", F.col("l_quantity") * 10 + F.when(F.col("l_discount") > 0.05, 200.0).otherwise(0.0))
    held = M.fit_forest(planted.where("part = 'train'"), FOREST, "target").transform(planted.where("part = 'test'"))
    gain = Q.regression_errors(held, "prediction", "target").crossJoin(held.agg(F.stddev("target").alias("deviation")))
    return plain.crossJoin(F.broadcast(gain.select((F.col("rmse") < 0.5 * F.col("deviation")).alias("gains"))))


def _plane(spark, d):
    """Two principal components of the scaled vectors."""
    scaled = M.standardised(M.with_vector(_vectors(spark, d), "embedding"), "features", "even")
    return M.project(scaled, "even")


@query("pca_project", "SELECT count(*) AS n, true AS uncorrelated, true AS falling, true AS centred FROM embeddings")
def pca_project(spark, d):
    """Projections are uncorrelated, centred, and the first varies most."""
    pca = vector_to_array("pca")
    plane = _plane(spark, d).select("vec_id", pca[0].alias("x"), pca[1].alias("y"))
    return plane.agg(
        F.count("*").alias("n"), (F.abs(F.corr("x", "y")) < 1e-6).alias("uncorrelated"),
        (F.variance("x") >= F.variance("y")).alias("falling"), ((F.abs(F.avg("x")) < 1e-6) & (F.abs(F.avg("y")) < 1e-6)).alias("centred"),
    )


def _clusters(spark, d):
    plane = stage(_plane(spark, d).select("vec_id", "pca"), "plane")
    return plane, M.fit_clusters(plane, "pca", k=3)


@query("kmeans_assign", "SELECT vec_id, true AS nearest, true AS centred FROM embeddings")
def kmeans_assign(spark, d):
    """Per row: no published centre is nearer than that of its cluster, and that centre is close to the mean of the cluster's rows."""
    plane, model = _clusters(spark, d)
    xy = vector_to_array("pca")
    away = F.array(*(sum(((xy[i] - F.lit(float(c[i]))) * (xy[i] - F.lit(float(c[i]))) for i in range(2)), F.lit(0.0)) for c in model.clusterCenters()))
    rows = model.transform(plane).select("vec_id", "cluster", away.alias("away"))
    means = model.transform(plane).groupBy("cluster").agg(F.avg(xy[0]).alias("x"), F.avg(xy[1]).alias("y"), F.stddev(xy[0]).alias("wide"))
    centres = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(model.clusterCenters())], "cluster int, cx double, cy double")
    # one row for each of the three clusters
    off = F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")))
    even = means.join(centres, "cluster").select("cluster", (off < 0.05 * F.col("wide") + 1e-6).alias("centred"))
    return rows.join(F.broadcast(even), "cluster").select("vec_id", (F.get("away", "cluster") <= F.array_min("away") + 1e-9).alias("nearest"), "centred")


@query("silhouette", "SELECT 3 AS clusters, true AS in_range, true AS positive")
def silhouette(spark, d):
    plane, model = _clusters(spark, d)
    clustered = model.transform(plane)
    score = F.lit(M.silhouette(clustered, "pca", "cluster"))
    used = clustered.agg(F.count_distinct("cluster").cast("int").alias("clusters"))
    return used.select("clusters", score.between(-1, 1).alias("in_range"), (score > 0).alias("positive"))


@query("silhouette_by_label", """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(64)) AS i FROM e),
y AS (SELECT label, list(s ORDER BY i) AS y FROM (SELECT label, i, sum(x) AS s FROM u GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT label, y, count(*) AS n, sum(list_dot_product(v, v)) AS psi FROM e JOIN y USING (label) GROUP BY 1, 2),
d AS (SELECT e.vec_id, e.label, c.label AS other, n, list_dot_product(v, v) + psi / n - 2 * list_dot_product(v, y) / n AS dist FROM e CROSS JOIN c),
s AS (SELECT vec_id, max(CASE WHEN other = label THEN CASE WHEN n = 1 THEN NULL ELSE dist * n / (n - 1) END END) AS a,
  min(CASE WHEN other <> label THEN dist END) AS b FROM d GROUP BY 1)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END), 6) AS silhouette FROM s""")
def silhouette_by_label(spark, d):
    rows = M.with_vector(_vectors(spark, d), "embedding")
    return spark.createDataFrame([(round(M.silhouette(rows, "features", "label"), 6),)], "silhouette double")


@query("model_round_trip", "SELECT vec_id, true AS same FROM embeddings")
def model_round_trip(spark, d):
    """Whether a stored and reloaded model predicts as the original did, per row."""
    rows = M.with_vector(_vectors(spark, d), "embedding")
    model = M.fit_multiclass(rows, "features", "label")
    path = scratch_path(spark, "model")
    M.save_model(model, path)
    first = model.transform(rows).select("vec_id", F.col("prediction").alias("before"))
    again = M.load_model(path).transform(rows).select("vec_id", F.col("prediction").alias("after"))
    return first.join(again, "vec_id").select("vec_id", (F.col("before") == F.col("after")).alias("same"))


@query("predict_log", "SELECT vec_id, true AS same, true AS logged FROM embeddings")
def predict_log(spark, d):
    """Per row: the logged class is the one with the highest score of the published weights."""
    rows = M.with_vector(_vectors(spark, d), "embedding")
    model = M.fit_multiclass(rows, "features", "label")
    log = M.prediction_log(model, rows, "vec_id", ["embedding"])
    fitted = model.stages[-1]
    scores = F.array(*(
        F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), F.array(*(F.lit(float(w)) for w in weights)), lambda x, w: x * w), F.lit(float(b)), lambda s, x: s + x)
        for weights, b in zip(fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray())
    ))
    best = F.array_position(scores, F.array_max(scores)) - 1
    return log.select("vec_id", (F.col("predicted_class") == best).alias("same"), F.col("created_at").isNotNull().alias("logged"))


@query("predict_distinct", f"SELECT {LINE_KEY_SQL}, true AS same FROM lineitem")
def predict_distinct(spark, d):
    """A model applied once per distinct feature tuple, against the sign of its published weights for every row."""
    columns = ["l_quantity", "l_discount", "l_tax"]
    rows = stage(load(spark, d, "lineitem").select(*LINE_KEY, *columns), "distinct")
    label = (F.col("l_quantity") > 25).cast("int")
    model = M.fit_binary(rows.withColumn("label", label), columns, "label")
    scored = score_distinct(rows, columns, lambda t: M.apply_binary(model, t), "prediction")
    scaler, fitted = model.stages[1], model.stages[2]
    margin = F.lit(float(fitted.intercept))
    for c, w, spread in zip(columns, fitted.coefficients, scaler.std):
        margin = margin + F.col(c) * float(w / spread if spread else 0.0)
    side = (margin > 0).cast("int")
    return scored.select(*LINE_KEY, ((F.col("prediction") == side) | (F.abs(margin) < 1e-6)).alias("same"))


LAGS, HORIZON, REFERENCE = 30, 10, date(2000, 6, 30)


def _order_bars(spark, d):
    """Daily bars of the orders, one series per status: years of days."""
    return daily_bars(load(spark, d, "orders"), "o_orderstatus", "o_orderdate", "o_totalprice", "o_orderkey")


ORDER_BARS = """
bars AS (SELECT o_orderstatus AS series, CAST(o_orderdate AS DATE) AS day, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close, count(o_totalprice) AS volume
  FROM orders GROUP BY 1, 2)"""


def _step_model(spark, d):
    """Scaled bars, the range they were scaled by, and a model; range and model know nothing after the reference date."""
    rows = stage(_order_bars(spark, d).select("series", "day", F.col("close").cast("double"), F.col("volume").cast("double")), "bars")
    known = rows.where(F.col("day") <= F.lit(REFERENCE))
    fitted = stage(E.fit_range(known, ["close", "volume"]), "range")
    scaled = stage(E.scale_minmax(rows, fitted, ["close", "volume"], low=0.0, high=1.0), "scaled")
    return scaled, fitted, G.fit_direct(scaled.where(F.col("day") <= F.lit(REFERENCE)), "series", "day", LAGS, HORIZON)


def _weighted_lags(model, step):
    """The step's forecast from an array of closes and volumes, latest last, and the published weights."""
    weights = [float(w) for w in model.weights[step]]
    total = F.lit(model.intercepts[step])
    for lag in range(model.lags):
        total = total + F.get("closes", F.lit(lag)) * weights[2 * lag] + F.get("volumes", F.lit(lag)) * weights[2 * lag + 1]
    return total


@query("forecast_direct", f"""
WITH {ORDER_BARS}, n AS (SELECT series, day, row_number() OVER (PARTITION BY series ORDER BY day) AS rn FROM bars)
SELECT series, day, true AS first_step, true AS last_step FROM n WHERE rn > {LAGS}""")
def forecast_direct(spark, d):
    """Ten steps from thirty lags; the first and the last are worked out again from the lag arrays and the published weights."""
    rows, _, model = _step_model(spark, d)
    ahead = G.predict_direct(rows, "series", "day", model)
    before = Window.partitionBy("series").orderBy("day").rowsBetween(-LAGS, -1)  # one row per day of a series
    lags = rows.select("series", "day", F.collect_list("close").over(before).alias("closes"), F.collect_list("volume").over(before).alias("volumes"))
    both = ahead.join(lags, ["series", "day"]).where(F.size("closes") == LAGS)

    def close_to(step):
        return F.abs(F.col(f"forecast{step}") - _weighted_lags(model, step - 1)) < 1e-6

    return both.select("series", "day", close_to(1).alias("first_step"), close_to(HORIZON).alias("last_step"))


def _recursive(spark, d):
    rows, fitted, model = _step_model(spark, d)
    ahead = G.forecast_recursive(rows, "series", "day", model, REFERENCE, days=25)
    prices = E.scale_minmax(ahead.withColumnRenamed("predicted_close", "close"), fitted, ["close"], low=0.0, high=1.0, inverse=True)
    return rows, fitted, model, prices.withColumnRenamed("close", "predicted_close")


@query("forecast_recursive", f"""
WITH {ORDER_BARS} SELECT DISTINCT series, CAST(unnest(generate_series(DATE '{REFERENCE}' + 1, DATE '{REFERENCE}' + 25, INTERVAL 1 DAY)) AS DATE) AS day, true AS follows
FROM bars WHERE day <= DATE '{REFERENCE}'""")
def forecast_recursive(spark, d):
    """Beyond the horizon predictions are inputs: each block of ten days is worked out again from the days before it."""
    rows, fitted, model, prices = _recursive(spark, d)
    scaled = E.scale_minmax(prices.withColumnRenamed("predicted_close", "close"), fitted, ["close"], low=0.0, high=1.0)
    past = look_back(rows, "series", "day", ["close", "volume"], REFERENCE, LAGS).select("series", F.col("close").alias("past"), F.col("volume").alias("held"))
    # 25 values for each series
    made = scaled.groupBy("series").agg(F.transform(F.sort_array(F.collect_list(F.struct("day", "close"))), lambda s: s["close"]).alias("made"))
    both = past.join(made, "series")
    checks = []
    for step in (0, HORIZON - 1, HORIZON, 2 * HORIZON, 24):
        block = step // HORIZON * HORIZON
        known = F.slice(F.concat("past", F.slice("made", 1, block)), block + 1, LAGS)
        volumes = F.slice(F.concat("held", F.array_repeat(F.element_at("held", -1), block)), block + 1, LAGS)
        at = both.select("series", "made", known.alias("closes"), volumes.alias("volumes"))
        checks.append(at.select("series", (F.abs(F.get("made", F.lit(step)) - _weighted_lags(model, step - block)) < 1e-6).alias("ok")))
    every = reduce(lambda x, y: x.unionByName(y), checks).groupBy("series").agg(F.bool_and("ok").alias("follows"))
    return prices.select("series", "day").join(every, "series")


@query("forecast_dates", f"""
WITH {ORDER_BARS}, past AS (SELECT series, day, round(close, 2) AS historical_close FROM bars WHERE day BETWEEN DATE '{REFERENCE}' - {LAGS} AND DATE '{REFERENCE}'),
ahead AS (SELECT DISTINCT series, CAST(unnest(generate_series(DATE '{REFERENCE}' + 1, DATE '{REFERENCE}' + 25, INTERVAL 1 DAY)) AS DATE) AS day FROM bars WHERE day <= DATE '{REFERENCE}')
SELECT series, day, historical_close, historical_close IS NULL AS forecast FROM past FULL JOIN ahead USING (series, day)""")
def forecast_dates(spark, d):
    """The look-back period beside the recursive forecast, aligned by date."""
    bars_of, prices = _order_bars(spark, d), _recursive(spark, d)[3]
    out = G.history_and_forecast(bars_of, "series", "day", prices, REFERENCE, LAGS)
    return out.select("series", "day", F.round("historical_close", 2).alias("historical_close"), F.col("predicted_close").isNotNull().alias("forecast"))
