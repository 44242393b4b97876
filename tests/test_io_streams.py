"""Files, catalog, hand-over markers and streams."""

import datetime
import json

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell import session
from tidewell.operators.offers import posterior_estimates
from tidewell.sources import files as S
from tidewell.streaming import streams as X


def test_bad_lines_are_kept_apart(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"id": 1, "ctx": {"a": "x"}}\nnot json\n\n{"id": 2}\n{"id": "word"}\n')
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("ctx", T.StructType([T.StructField("a", T.StringType())]))])
    good, bad = S.read_json_lines(spark, str(path), schema)
    assert sorted(r["id"] for r in good.collect()) == [1, 2]
    assert sorted(r["value"] for r in bad.collect()) == ["not json", '{"id": "word"}']


def test_report_is_one_document(spark, tmp_path):
    document = spark.range(3).agg(F.sum("id").alias("total")).select(F.to_json(F.struct("total")).alias("report"))
    S.write_report(document, str(tmp_path / "report"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert [json.loads(line) for line in lines] == [{"total": 3}]


def test_next_stage_waits_for_the_marker(spark, tmp_path):
    folder, frame = str(tmp_path / "stage"), spark.range(5)
    frame.write.parquet(folder)
    assert S.read_when_complete(spark, folder, "_DONE", frame.schema).count() == 0
    S.mark_complete(spark, folder, "_DONE")
    assert S.read_when_complete(spark, folder, "_DONE", frame.schema).count() == 5


def test_two_level_names(spark):
    frame = spark.createDataFrame([(1.0, 2, "k")], "`('Close', '^X')` double, `('Volume', '^X')` int, plain string")
    assert S.flatten_quote_columns(frame).columns == ["Close", "Volume", "plain"]


def test_partition_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "parts")
    S.write_partitioned(spark.range(100).withColumn("dataproc", (F.col("id") % 4).cast("int")), path, "dataproc")
    plan = spark.read.parquet(path).where("dataproc = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataproc" in plan


def test_broadcast_only_when_small(spark):
    small, big = spark.range(10), spark.range(10**9)
    assert S.broadcast_if_small(small) is not small
    assert S.broadcast_if_small(big) is big


def test_scratch_needs_a_shared_folder(spark, monkeypatch, tmp_path):
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext = Context()

    cluster = Session()
    cluster.conf = Conf(None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_path(cluster, "x")
    cluster.conf = Conf("hdfs://shared/dir/")
    assert session.scratch_path(cluster, "x").startswith("hdfs://shared/dir/tidewell/x-")


def test_local_session_falls_back_to_a_temporary_folder(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "local[2]", "app-without-folder"
        chosen = []

        def setCheckpointDir(self, path):
            self.chosen.append(path)

    class Session:
        conf, sparkContext = Conf(), Context()

    first, second = session.scratch_path(Session(), "x"), session.scratch_path(Session(), "x")
    assert first != second and first.startswith(Context.chosen[0]) and len(Context.chosen) == 1


def folders(tmp_path, *names):
    return [str(tmp_path / n) for n in names]


def test_second_run_adds_nothing(spark, tmp_path):
    source, out, checkpoint = folders(tmp_path, "in", "out", "cp")
    for low in (0, 10):
        spark.range(low, low + 10).write.mode("append").parquet(source)
        for _ in range(2):
            X.drain_to_files(X.log_stream(spark, source, spark.range(1).schema), out, checkpoint)
    assert spark.read.parquet(out).count() == 20


def test_refit_counts_and_replay(spark, tmp_path):
    root, = folders(tmp_path, "refit")
    fitted = []
    sink = X.RefitSink(root, lambda rows, target: fitted.append((rows.count(), target.rsplit("=", 1)[1])))
    rows = lambda n: spark.range(n).withColumn("reward", F.lit(1))
    for number, n in enumerate((60, 30, 20, 99, 1, 150)):
        sink(rows(n), number)
    assert fitted == [(110, "2"), (100, "4"), (150, "5")]
    sink(rows(150), 5)
    assert fitted[-1] == (150, "5")
    assert sorted((r["batch"], r["n_rows"]) for r in sink.versions(spark).collect()) == [(2, 110), (4, 100), (5, 150)]


def test_replayed_change_batch_is_idempotent(spark, tmp_path):
    out, = folders(tmp_path, "changes")
    write = X.batch_writer(out)
    base = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    log = "k int, seq int, op string, a string"
    batches = [[(1, 1, "update", "z"), (3, 2, "insert", "n")], [(1, 3, "delete", None), (3, 4, "update", "m")]]
    for number in (0, 1, 1, 0):
        write(spark.createDataFrame(batches[number], log), number)
    got = X.current_table(spark, base, out, "k", "seq", "op")
    assert sorted(map(tuple, got.collect())) == [(2, "y"), (3, "m")]


def test_late_rows_are_dropped_from_windows(spark, tmp_path):
    source, out, checkpoint = folders(tmp_path, "in", "out", "cp")
    day = lambda d: datetime.datetime(2024, 1, d)
    schema = "ts timestamp, reward int"
    # one drop per batch: the second moves the watermark to the 19th, the third is late
    drops = [[(day(1), 1), (day(2), 0)], [(day(20), 1)], [(day(3), 1), (day(29), 0)]]
    for rows in drops:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = X.log_stream(spark, source, T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("reward", T.IntegerType())]))
        X.drain_to_files(X.windowed_rate(stream, "ts", "reward", datetime.date(2024, 1, 1)), out, checkpoint)
    got = sorted((r["window_start"].day, r["n_obs"], r["n_conv"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, 2, 1), (15, 1, 1)]


def test_totals_match_batch(spark, tmp_path):
    log = spark.range(90).select((F.col("id") % 3).cast("string").alias("arm"), (F.col("id") % 2).cast("int").alias("reward"))
    source, out, checkpoint = folders(tmp_path, "in", "out", "cp")
    log.repartition(3).write.parquet(source)
    totals = X.arm_totals(X.log_stream(spark, source, log.schema, files_per_batch=1), "arm", "reward")
    X.drain_batches(totals, X.totals_writer(out, "arm"), checkpoint, mode="update")
    assert sum(p.name.startswith("batch=") for p in Path(out).iterdir()) <= 2
    got = {r["arm"]: (r["rounds"], r["total_reward"]) for r in X.latest_totals(spark, out, "arm").collect()}
    assert got == {"0": (30, 15), "1": (30, 15), "2": (30, 15)}


def test_refit_fits_estimates(spark, tmp_path):
    rows = spark.createDataFrame([("A_reativacao_positiva", "cashback", 1)] * 120, "segment string, arm string, reward int")
    sink = X.RefitSink(str(tmp_path / "r"), lambda waiting, target: posterior_estimates(waiting, "segment", "arm", "reward").write.parquet(target))
    sink(rows, 0)
    best = spark.read.parquet(str(tmp_path / "r" / "models")).orderBy(F.desc("mean")).first()
    assert (best["arm"], best["hits"]) == ("cashback", 120)
