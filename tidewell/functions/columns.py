"""Column expressions: dates, numbers, text pieces, clocks, segments, hashes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
RATING_WORDS = {"One": 1, "Two": 2, "Three": 3, "Four": 4, "Five": 5}
AGE_BINS = [
    (17, 25, "18-25"), (25, 35, "26-35"), (35, 45, "36-45"),
    (45, 55, "46-55"), (55, 65, "56-65"), (65, 90, "66+"),
]
SEGMENTS = [
    "A_reativacao_positiva",
    "B_reativacao_negativa",
    "C_alta_propensao",
    "D_comprometido_financeiramente",
    "E_cold_start_generico",
]
CLOCK_WRAP = 2360
FULL_DAY = 2400


def date_key(day: Column) -> Column:
    """Date as a yyyymmdd integer, the partition key of stored tables."""
    return F.date_format(day, "yyyyMMdd").cast("int")


def plain_date(moment: Column) -> Column:
    return F.to_date(moment)


def candle_columns(open_: str, high: str, low: str, close: str) -> dict[str, Column]:
    """Body and shadows. The lower shadow is low minus the body's lower end, so never positive."""
    body = F.col(close) - F.col(open_)
    rising = body >= 0
    return {
        "candle_body": body,
        "upper_shadow": F.col(high) - F.when(rising, F.col(close)).otherwise(F.col(open_)),
        "lower_shadow": F.col(low) - F.when(rising, F.col(open_)).otherwise(F.col(close)),
    }


# --- HHMM clocks. Values are subtracted as plain integers unless stated otherwise. ---


def hhmm_to_minutes(clock: Column) -> Column:
    return F.floor(clock / 100).cast("int") * 60 + F.pmod(clock, F.lit(100))


def departure_time(departure: Column, wheels_off: Column, taxi_out: Column) -> Column:
    """Both clocks missing -> 0; only the departure missing -> wheels-off less taxi."""
    return (
        F.when(departure.isNull() & wheels_off.isNull(), F.lit(0))
        .when(departure.isNull(), wheels_off - taxi_out)
        .otherwise(departure)
    )


def wheels_off_time(wheels_off: Column, departure: Column, taxi_out: Column) -> Column:
    """Missing -> departure plus taxi; beyond the wrap -> wrap less that sum (negative, kept)."""
    filled = F.coalesce(wheels_off, departure + taxi_out)
    return F.when(filled > CLOCK_WRAP, CLOCK_WRAP - (departure + taxi_out)).otherwise(filled)


def arrival_time(arrival: Column, wheels_on: Column, taxi_in: Column) -> Column:
    return (
        F.when(arrival.isNull() & wheels_on.isNull(), F.lit(0))
        .when(arrival.isNull(), wheels_on + taxi_in)
        .otherwise(arrival)
    )


def wheels_on_time(wheels_on: Column, arrival: Column, taxi_in: Column) -> Column:
    """Missing -> arrival less taxi; below zero -> the negated difference."""
    filled = F.coalesce(wheels_on, arrival - taxi_in)
    return F.when(filled < 0, F.lit(0) - (arrival - taxi_in)).otherwise(filled)


def overnight_difference(start: Column, end: Column, minutes: bool = False) -> Column:
    """end - start, plus one day when negative. ``minutes`` compares true minutes instead."""
    day = 24 * 60 if minutes else FULL_DAY
    gap = hhmm_to_minutes(end) - hhmm_to_minutes(start) if minutes else end - start
    return F.when(gap >= 0, gap).otherwise(gap + day)


# --- text pieces ---


def rating_from_words(text: Column) -> Column:
    """First of One..Five contained in the text, as a number; otherwise null."""
    expr = F.lit(None).cast("int")
    for word, number in reversed(RATING_WORDS.items()):
        expr = F.when(text.contains(word), F.lit(number)).otherwise(expr)
    return expr


def contains_flag(text: Column, piece: str) -> Column:
    return F.coalesce(text.contains(piece), F.lit(False)).cast("int")


def number_or_null(text: Column) -> Column:
    return text.try_cast("double")


def after_prefix(text: Column, length: int) -> Column:
    return F.substr(text, F.lit(length + 1))


def last_piece(text: Column, separator: str = "-") -> Column:
    return F.substring_index(text, separator, -1)


def last_word_int(text: Column) -> Column:
    return F.element_at(F.split(F.trim(text), r"\s+"), -1).try_cast("int")


def resolve_link(base: Column, href: Column) -> Column:
    """A link as seen from ``base``: absolute, host-relative or folder-relative, with any number of ``.`` and ``..``."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^(https?:)", 1)
    base_path = F.regexp_extract(base, r"^https?://[^/?#]*([^?#]*)", 1)
    base_steps = F.split(base_path, "/")
    path = F.regexp_extract(href, r"^[^?#]*", 0)
    rest = F.substr(href, F.length(path) + 1)
    steps = F.split(path, "/")

    # below a folder empty steps vanish, but for the first and the last
    below = F.concat(F.slice(base_steps, F.lit(1), F.greatest(F.size(base_steps) - 1, F.lit(1))), steps)
    inner = F.filter(F.slice(below, F.lit(2), F.size(below) - 2), lambda step: step != "")
    below = F.concat(F.slice(below, 1, 1), inner, F.slice(below, -1, 1))
    given = F.when(path.startswith("/"), steps).otherwise(below)

    def follow(done: Column, step: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(step == "..", up).when(step == ".", done).otherwise(F.concat(done, F.array(step)))

    walked = F.aggregate(given, F.array().cast("array<string>"), follow)
    last = F.element_at(given, -1)
    walked = F.when(last.isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    joined = F.array_join(walked, "/")
    joined = F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
    return (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .when(href.startswith("?"), F.concat(root, base_path, href))
        .otherwise(F.concat(root, joined, rest))
    )


# --- numbers ---


def right_closed_bins(value: Column, bins: Sequence[tuple[float, float, str]]) -> Column:
    """Label of the bin (low, high] that holds the value; outside -> null."""
    expr = F.lit(None).cast("string")
    for low, high, label in reversed(bins):
        expr = F.when((value > low) & (value <= high), F.lit(label)).otherwise(expr)
    return expr


def contacted_flag(days: Column, sentinel: int = -1) -> Column:
    return (days != sentinel).cast("int")


def cleaned_days(days: Column) -> Column:
    return F.greatest(days, F.lit(0))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def drift_status(score: Column, watch: float = 0.1, act: float = 0.2) -> Column:
    return (
        F.when(score < watch, F.lit("stable")).when(score < act, F.lit("monitor")).otherwise(F.lit("retrain"))
    )


def reais(value: Column) -> Column:
    """Currency text: the value rounded to cents, as the number prints."""
    return F.concat(F.lit("R$ "), F.round(value, 2).cast("string"))


# --- segments and hashes ---


def client_segment(poutcome: Column, pdays: Column, job: Column, housing: Column, loan: Column) -> Column:
    """First rule that holds gives the segment."""
    prior_failure = (pdays != -1) & (poutcome == "failure")
    both_loans = (housing == "yes") & (loan == "yes")
    return (
        F.when(poutcome == "success", SEGMENTS[0])
        .when(prior_failure, SEGMENTS[1])
        .when(job.isin("student", "retired"), SEGMENTS[2])
        .when(both_loans, SEGMENTS[3])
        .otherwise(SEGMENTS[4])
    )


def keyed_hash(*parts: Column, seed: int | str | Column = 42) -> Column:
    """md5 of the key parts and a seed: repeatable for any partitioning."""
    end = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", *(p.cast("string") for p in parts), end))


def uniform(*parts: Column, seed: int | str | Column = 42) -> Column:
    """A number in [0, 1) decided by the key parts and the seed alone."""
    head = F.substring(keyed_hash(*parts, seed=seed), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)


def standard_normal(*parts: Column, seed: int | str = 42) -> Column:
    """Box-Muller on two keyed uniforms."""
    first = uniform(*parts, seed=f"{seed}a")
    second = uniform(*parts, seed=f"{seed}b")
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - first)) * F.cos(F.lit(6.283185307179586) * second)


def record_id(*parts: Column) -> Column:
    """Deterministic record id; without key parts a random one."""
    return keyed_hash(*parts, seed="record") if parts else F.uuid()


def known_code(value: Column, codes: Mapping[str, int]) -> Column:
    """Code of a category; an unknown one gets 0."""
    pairs = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, value), F.lit(0))


def window_number(moment: Column, first: Column, days: int) -> Column:
    """0-based index of the ``days``-long window, counted in whole days from ``first``."""
    elapsed = F.timestamp_diff("DAY", first, moment)
    return F.floor(elapsed / days).cast("bigint")


def plus_days(moment: Column, days: Column) -> Column:
    return moment + F.make_dt_interval(days.cast("int"))


def json_fields(text: Column, fields: Mapping[str, T.DataType]) -> Column:
    """Struct of the named JSON fields; a bad document gives nulls."""
    schema = T.StructType([T.StructField(n, t) for n, t in fields.items()])
    return F.from_json(text, schema)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
