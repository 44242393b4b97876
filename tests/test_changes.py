"""Change sets against a replay, one change after the other."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewell.operators import changes as C
from tidewell.streaming.keyed import KeyedTable

SCHEMA = "k int, a string, b int"
LOG = "k int, seq int, op string, a string, b int"


def replay(base, log):
    table = {k: [a, b] for k, a, b in base}
    for k, _, op, a, b in sorted(log, key=lambda r: r[1]):
        if op == "delete":
            table.pop(k, None)
        elif k in table or op == "insert":
            row = table.setdefault(k, [None, None])
            row[0] = a if a is not None else row[0]
            row[1] = b if b is not None else row[1]
    return sorted((k, *v) for k, v in table.items())


@pytest.mark.parametrize("seed", range(4))
def test_log_equals_replay(spark, seed):
    rng = random.Random(seed)
    base = [(k, f"a{k}", k) for k in range(0, 40, 2)]
    log = []
    for seq in range(400):
        op = rng.choice(["insert", "update", "update", "delete"])
        gone = op == "delete"
        # key 1 is changed far more often than the others
        key = 1 if rng.random() < 0.4 else rng.randrange(45)
        log.append((
            key, seq, op,
            None if gone or rng.random() < 0.4 else f"n{seq}", None if gone or rng.random() < 0.4 else 1000 + seq,
        ))
    got = C.apply_changes(spark.createDataFrame(base, SCHEMA), spark.createDataFrame(log, LOG).repartition(5), "k", "seq", "op")
    assert sorted(map(tuple, got.collect())) == replay(base, log)


def test_applying_twice_changes_nothing(spark):
    base = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], SCHEMA)
    log = spark.createDataFrame([(1, 1, "update", "z", None), (2, 2, "delete", None, None), (3, 3, "insert", "w", 3)], LOG)
    once = C.apply_changes(base, log, "k", "seq", "op")
    again = C.apply_changes(once, log, "k", "seq", "op")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect())) == [(1, "z", 1), (3, "w", 3)]


def test_ids_continue(spark):
    base = spark.createDataFrame([(4, "x", 1)], SCHEMA)
    new = spark.createDataFrame([("p", 1), ("q", 2)], "a string, b int")
    assert sorted(map(tuple, C.append_with_ids(base, new, "k", ["a"]).collect())) == [(4, "x", 1), (5, "p", 1), (6, "q", 2)]
    empty = C.append_with_ids(base.where("k > 9"), new, "k", ["a"])
    assert sorted(r["k"] for r in empty.collect()) == [0, 1]
    assert [r["id"] for r in C.replace_ids(new, [F.desc("a")]).orderBy("id").collect()] == [0, 1]


def test_unique_guard(spark):
    base = spark.createDataFrame([("ana",)], "name string")
    new = spark.createDataFrame([("ana", 1), ("bia", 2), ("bia", 3)], "name string, seq int")
    accepted, refused = C.guard_unique(base, new, "name", "seq")
    assert [tuple(r) for r in accepted.collect()] == [("bia", 2)]
    assert sorted(map(tuple, refused.collect())) == [("ana", 1, "key taken"), ("bia", 3, "repeated in batch")]


def test_delete_reports_unknown(spark):
    base = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], SCHEMA)
    left, unknown = C.apply_deletes(base, spark.createDataFrame([(2,), (9,)], "k int"), "k")
    assert [r["k"] for r in left.collect()] == [1] and [r["k"] for r in unknown.collect()] == [9]


def random_log(rng, n, first=0):
    log = []
    for seq in range(first, first + n):
        op = rng.choice(["insert", "update", "update", "delete"])
        gone = op == "delete"
        key = 1 if rng.random() < 0.3 else rng.randrange(60)
        log.append((key, seq, op, None if gone or rng.random() < 0.4 else f"n{seq}", None if gone or rng.random() < 0.4 else 1000 + seq))
    return log


@pytest.mark.parametrize("bits", [64, 256, 1 << 14])
def test_sifting_changes_no_result(spark, bits):
    """Also with a filter so small that nearly every key seems changed."""
    rng = random.Random(bits)
    base = [(k, f"a{k}", k) for k in range(0, 400, 3)] + [(None, "n", 0)]
    log = random_log(rng, 80)
    table, changes = spark.createDataFrame(base, SCHEMA), spark.createDataFrame(log, LOG).repartition(3)
    plain = Counter(map(tuple, C.apply_changes(table, changes, "k", "seq", "op").collect()))
    assert Counter(map(tuple, C.apply_changes(table, changes, "k", "seq", "op", bits=bits).collect())) == plain
    updates = changes.where("op = 'update'")
    plain = Counter(map(tuple, C.apply_updates(table, updates, "k", "seq", ["a"]).collect()))
    assert Counter(map(tuple, C.apply_updates(table, updates, "k", "seq", ["a"], bits=bits).collect())) == plain
    gone = changes.where("op = 'delete'")
    for got, want in zip(C.apply_deletes(table, gone, "k", bits=bits), C.apply_deletes(table, gone, "k")):
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    for got, want in zip(C.guard_unique(table, changes, "k", "seq", bits=bits), C.guard_unique(table, changes, "k", "seq")):
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_only_touched_rows_are_shuffled(spark, tmp_path):
    spark.range(200_000).select(F.col("id").alias("k"), F.lit("a").alias("a"), F.lit(1).alias("b")).write.parquet(str(tmp_path / "base"))
    spark.range(50).select((F.col("id") * 3001).alias("k"), F.col("id").alias("seq"), F.lit("update").alias("op"), F.lit("z").alias("a"), F.lit(None).cast("int").alias("b")).write.parquet(str(tmp_path / "log"))
    base, log = spark.read.parquet(str(tmp_path / "base")), spark.read.parquet(str(tmp_path / "log"))
    hit, rest = C.touched(base, log, "k")
    assert rest is not None and 50 <= hit.count() <= 1000 and hit.count() + rest.count() == 200_000
    changed = C.apply_changes(base, log, "k", "seq", "op")
    assert changed.where("a = 'z'").count() == 50 and changed.count() == 200_000
    assert "Exchange hashpartitioning" not in rest._jdf.queryExecution().executedPlan().toString()


def keyed(spark, tmp_path, base, **options):
    table = KeyedTable(spark, str(tmp_path / "keyed"), spark.createDataFrame([], SCHEMA).schema, "k", n_slots=4, **options)
    table.create(spark.createDataFrame(base, SCHEMA))
    return table


@pytest.mark.parametrize("share", [0.5, 1e9])
def test_keyed_table_equals_replay(spark, tmp_path, share):
    rng, base = random.Random(7), [(k, f"a{k}", k) for k in range(0, 60, 2)]
    table = keyed(spark, tmp_path, base, fold_share=share, fold_batches=5)
    log, files = [], []
    for batch in range(8):
        part = random_log(rng, 15, first=15 * batch)
        rng.shuffle(part)
        log += part
        version = table.append(spark.createDataFrame(part, LOG), batch)
        again = table.append(spark.createDataFrame(part, LOG), batch)  # a replayed batch
        assert again.last_batch == batch and again.number == version.number
        assert sorted(map(tuple, table.read().collect())) == replay(base, log)
        files.append(len(table.read().inputFiles()))
    # what a read opens does not grow with the number of batches
    assert max(files[5:]) <= max(files[:5])
    assert len(list((tmp_path / "keyed" / "versions").glob("*.json"))) <= 4


def test_reader_sees_one_version(spark, tmp_path):
    base = [(k, "a", 0) for k in range(8)]
    table = keyed(spark, tmp_path, base, fold_share=0.0)
    before, old = table.version(), table.read()
    table.append(spark.createDataFrame([(1, 1, "delete", None, None), (9, 2, "insert", "n", 5)], LOG), 0)
    assert sorted(map(tuple, old.collect())) == sorted(base) == sorted(map(tuple, table.read(before).collect()))
    assert sorted(r["k"] for r in table.read().collect()) == [0, 2, 3, 4, 5, 6, 7, 9]
    # a writer that stops before the version is written leaves the table as it is
    table._write_slots(table.read(), [0, 1, 2, 3], ["k", "a", "b"])
    (tmp_path / "keyed" / "versions" / "99.json.x.draft").write_text("half")
    assert table.version().number == 2 and table.read().count() == 8


def test_late_changes_are_refused(spark, tmp_path):
    table = keyed(spark, tmp_path, [(1, "a", 0)], fold_share=0.0)
    table.append(spark.createDataFrame([(1, 10, "update", "b", None)], LOG), 0)
    with pytest.raises(ValueError):
        table.append(spark.createDataFrame([(1, 9, "update", "c", None)], LOG), 1)
    table.append(spark.createDataFrame([], LOG), 1)
    table.append(spark.createDataFrame([(1, 11, "delete", None, None)], LOG), 2)
    assert table.read().collect() == []
    table.append(spark.createDataFrame([(2, 12, "insert", "z", 1)], LOG), 3)
    assert [tuple(r) for r in table.read().collect()] == [(2, "z", 1)]


def test_a_drop_of_several_files_is_one_batch(spark, tmp_path):
    """A drop that many tasks write lies in files whose changes overlap, and the log is folded between drops."""
    from tidewell.plans.changes import apply_changes as whole
    from tidewell.plans.streams import stream_apply_changes

    folder, kinds = str(tmp_path), ["view", "signup", "error", "purchase", "click"]
    spark.createDataFrame([(9 * i, i, "O", 1.0 * i) for i in range(40)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{folder}/orders.parquet")
    events = [(i, i % 7, kinds[i * 3 % 5], float(i)) for i in range(240)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").repartition(4).write.parquet(f"{folder}/events.parquet")
    got, want = (sorted(tuple(r) for r in q(spark, folder).collect()) for q in (stream_apply_changes, whole))
    assert got == want and len(got) > 10
