"""Hand-written edge rows of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from tidewell.functions import columns as C


def values(spark, rows, schema, *exprs):
    frame = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in frame.select(*exprs).collect()]


def test_candles_zero_and_falling_body(spark):
    got = values(
        spark, [(10.0, 12.0, 9.0, 10.0), (10.0, 12.0, 7.0, 8.0), (8.0, 12.0, 7.0, 10.0)],
        "open double, high double, low double, close double",
        *C.candle_columns("open", "high", "low", "close").values(),
    )
    assert got == [(0.0, 2.0, -1.0), (-2.0, 2.0, -1.0), (2.0, 2.0, -1.0)]


def test_departure_and_wheels_off(spark):
    rows = [(None, None, 10), (None, 930, 10), (900, None, 10), (2355, None, 10), (900, 2365, 10)]
    schema = "d int, w int, t int"
    departure = C.departure_time(F.col("d"), F.col("w"), F.col("t"))
    assert [r[0] for r in values(spark, rows, schema, departure)] == [0, 920, 900, 2355, 900]
    filled = [(920 if d is None and w else d or 0, w, t) for d, w, t in rows]
    off = C.wheels_off_time(F.col("w"), F.col("d"), F.col("t"))
    assert [r[0] for r in values(spark, filled, schema, off)] == [10, 930, 910, 2360 - 2365, 2360 - 910]


def test_arrival_and_wheels_on(spark):
    rows = [(None, None, 5), (None, 1200, 5), (3, None, 5), (100, None, 5)]
    schema = "a int, w int, t int"
    arrival = C.arrival_time(F.col("a"), F.col("w"), F.col("t"))
    assert [r[0] for r in values(spark, rows, schema, arrival)] == [0, 1205, 3, 100]
    wheels = C.wheels_on_time(F.col("w"), F.col("a"), F.col("t"))
    assert [r[0] for r in values(spark, rows[2:], schema, wheels)] == [2, 95]


def test_overnight(spark):
    got = values(
        spark, [(2330, 45), (900, 1015)], "s int, e int",
        C.overnight_difference(F.col("s"), F.col("e")), C.overnight_difference(F.col("s"), F.col("e"), minutes=True),
    )
    assert got == [(115, 75), (115, 75)]


def test_text_rules(spark):
    got = values(
        spark, [("star-rating Two", "icon-ok", "51.77"), ("none", "out", "x"), ("Three One", None, None)],
        "r string, a string, p string",
        C.rating_from_words(F.col("r")), C.contains_flag(F.col("a"), "ok"), C.number_or_null(F.col("p")),
    )
    assert got == [(2, 1, 51.77), (None, 0, None), (1, 0, None)]


def test_bins_and_status(spark):
    got = values(
        spark, [(17,), (18,), (25,), (26,), (90,), (91,)], "v int", C.right_closed_bins(F.col("v"), C.AGE_BINS)
    )
    assert [g[0] for g in got] == [None, "18-25", "18-25", "26-35", "66+", None]
    got = values(spark, [(0.0999,), (0.1,), (0.2,)], "v double", C.drift_status(F.col("v")))
    assert [g[0] for g in got] == ["stable", "monitor", "retrain"]


def test_segments_first_rule_wins(spark):
    rows = [
        ("success", -1, "student", "yes", "yes"), ("failure", 3, "student", "no", "no"),
        ("failure", -1, "retired", "no", "no"), ("unknown", -1, "admin.", "yes", "yes"), ("unknown", 5, "admin.", "yes", "no"),
    ]
    got = values(
        spark, rows, "p string, d int, j string, h string, l string",
        C.client_segment(F.col("p"), F.col("d"), F.col("j"), F.col("h"), F.col("l")),
    )
    assert [g[0][0] for g in got] == list("ABCDE")


def test_links(spark):
    from urllib.parse import urljoin

    deep = "https://h.example/" + "/".join("abcdefghijkl") + "/p.html"
    bases = ["https://h.example/a/b/c.html", "http://h.example", "https://h.example/a/?q=1#z", "https://h.example/x/y/", deep]
    hrefs = [
        "/r", "p.html", "../p.html", "../../p", "../../../p", "./p", "//o.example/q", "https://o.example/", "#f", "?n=2", "d/../e", "",
        "..", ".", "a/.", "a/..", "/a/../b", "/a/./b/..", "../" * 9 + "x.html", "../" * 30 + "x", "a/b/c/../../../d?x=../y", "g;x=1/../y", "./../g", "a//b", ".../x", "/..",
    ]
    rows = [(b, h) for b in bases for h in hrefs]
    got = values(spark, rows, "b string, h string", C.resolve_link(F.col("b"), F.col("h")))
    assert [(b, h, g[0], urljoin(b, h)) for (b, h), g in zip(rows, got) if g[0] != urljoin(b, h)] == []


def test_uniform_does_not_depend_on_layout(spark):
    frame = spark.range(1000)
    sums = {
        frame.repartition(n).agg(F.sum(F.round(C.uniform(F.col("id")), 9).cast("decimal(20,9)"))).first()[0] for n in (1, 17)
    }
    assert len(sums) == 1


def test_normal_moments(spark):
    mean, std = spark.range(20000).agg(
        F.avg(C.standard_normal(F.col("id"))), F.stddev_pop(C.standard_normal(F.col("id")))
    ).first()
    assert mean == pytest.approx(0, abs=0.03) and std == pytest.approx(1, abs=0.03)


def test_random_record_id(spark):
    assert spark.range(50).select(C.record_id().alias("u")).distinct().count() == 50
