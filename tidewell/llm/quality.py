"""Quality rules with thresholds that follow the data.

Each language and source gets its own fences, taken from quantile sketches. A sketch is
a histogram whose bucket widths grow with the value (exact below 128, then within 1/64),
so partial sketches merge by adding counts, whatever the order, and equal inputs always
give equal thresholds. Documents are then joined with the fences of their group.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import SPACE, strings, write_and_read
from tidewell.operators.attach import attach

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Metric -> (smallest spread taken for a fence, whether low values are rejected too); all in parts per thousand.
METRICS = {
    "word_length": (500, True),
    "symbols": (25, False),
    "dup_lines": (150, False),
    "repeats": (100, False),
    "stutter": (25, False),
}
#: Upper quantile, in parts per thousand, from which a fence is measured, and the lower one it is compared with. Most texts repeat nothing, so
#: the quartiles of repetition are 0 whatever the group is like; there the fence starts at the tail.
UPPER, LOWER = {"dup_lines": 990, "repeats": 990}, 250
QUARTILE = 750
#: A fence lies this many spreads beyond its quantile.
FENCE = 3
#: Groups with fewer passing documents take the fences of their language, then of all.
MIN_GROUP = 50
#: So many groups at most are broadcast; a group is about 100 bytes.
MAX_BROADCAST_GROUPS = 20_000

_FEATURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter"]


def text_features(text: str) -> tuple[int, ...]:
    """Word, symbol, line and repetition counts of one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[bytes] = set()
    lines = dup_lines = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            dup_lines += line in seen
            seen.add(line)
    if n < 2:
        return n, chars, symbols, lines, dup_lines, 0, 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    stutter = int((ids[1:] == ids[:-1]).sum())
    repeat = 0
    if n >= WINDOW and len(known) < n:
        # number the windows of 2, 4 and 8 words by the pair of halves: exact, no hashing
        level, width = ids, 1
        while width < WINDOW:
            pairs = level[:-width] * (int(level.max()) + 1) + level[width:]
            level = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
            width *= 2
        often = np.bincount(level) > 1
        starts = np.flatnonzero(often[level])
        if len(starts):
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + WINDOW, -1)
            repeat = int((np.cumsum(edge) > 0).sum())
    return n, chars, symbols, lines, dup_lines, repeat, stutter


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_tw_f`` of the counts; nothing is shuffled."""
    schema = "struct<" + ",".join(f"{name}:bigint" for name in _FEATURES) + ">"

    def features(column: pa.Array) -> pa.Array:
        rows = [text_features(t) for t in strings(column)]
        columns = list(zip(*rows)) if rows else [[] for _ in _FEATURES]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_FEATURES)

    # once per text: else a filter on the counts would count anew
    counted = F.arrow_udf(features, schema).asNondeterministic()
    return docs.withColumn("_tw_f", counted(F.col(text)))


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 20) | (f["n_repeat_words"] * 100 > f["n_words"] * 30)


def _ratio(part: Column, whole: Column) -> Column:
    return F.floor(part * 1000 / F.greatest(whole, F.lit(1)))


def metric_columns(f: Column) -> dict[str, Column]:
    return {
        "word_length": _ratio(f["word_chars"], f["n_words"]),
        "symbols": _ratio(f["n_symbols"], f["n_words"]),
        "dup_lines": _ratio(f["n_dup_lines"], f["n_lines"]),
        "repeats": _ratio(f["n_repeat_words"], f["n_words"]),
        "stutter": _ratio(f["n_stutter"], f["n_words"]),
    }


def bucket(value: Column) -> Column:
    """Lower end of the sketch bucket of a whole number: its seven leading bits."""
    drop = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    unit = F.pow(F.lit(2.0), drop).cast("bigint")
    return (value - value % unit).cast("bigint")


def sketches(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """Rows (lang, source, metric, bucket, n) of the passing documents: partial counts add up, so sketches merge."""
    f = F.col("_tw_f")
    metrics = F.array(*(
        F.struct(F.lit(name).alias("metric"), bucket(value).alias("bucket")) for name, value in metric_columns(f).items()
    ))
    return (
        rows.where(~base_failed(f))
        .select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.inline(metrics))
        .groupBy("lang", "source", "metric", "bucket")
        .agg(F.count("*").alias("n"))
    )


def fences(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source): ``n_rows`` and the lowest and highest value kept of every metric.

    Sketches of a language and of everything are merged from those of the groups. A window over one
    sketch orders its buckets, of which there are at most 64 for each doubling of the value.
    """
    per_lang = sketch.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    overall = per_lang.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))

    def bounds(counts: DataFrame, keys: list[str], label: str) -> DataFrame:
        upto = Window.partitionBy(*keys, "metric").orderBy("bucket")
        whole = Window.partitionBy(*keys, "metric")
        placed = counts.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(whole)})
        upper = F.lit(QUARTILE)
        for name, level in UPPER.items():
            upper = F.when(F.col("metric") == name, level).otherwise(upper)
        quartiles = placed.groupBy(*keys, "metric").agg(
            F.max("total").alias("total"),
            F.min(F.when(F.col("upto") * 1000 >= F.col("total") * LOWER, F.col("bucket"))).alias("q1"),
            F.min(F.when(F.col("upto") * 1000 >= F.col("total") * upper, F.col("bucket"))).alias("q3"),
        )
        columns = [F.max("total").alias(f"{label}_n")]
        for name, (least, low) in METRICS.items():
            mine = F.col("metric") == name
            spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(least)) * FENCE
            columns.append(F.max(F.when(mine, F.col("q3") + spread)).alias(f"{label}_hi_{name}"))
            if low:
                columns.append(F.max(F.when(mine, F.col("q1") - spread)).alias(f"{label}_lo_{name}"))
        return quartiles.groupBy(*keys).agg(*columns)

    own = bounds(sketch, ["lang", "source"], "own")
    lang = bounds(per_lang, ["lang"], "lang").withColumnRenamed("lang", "_tw_lang")
    everything = bounds(overall, [], "all")
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("_tw_lang")), "left").join(F.broadcast(everything), how="left")
    limits = [("hi", n) for n in METRICS] + [("lo", n) for n, (_, low) in METRICS.items() if low]

    def chosen(which: str, name: str) -> Column:
        return (
            F.when(F.col("own_n") >= MIN_GROUP, F.col(f"own_{which}_{name}"))
            .when(F.col("lang_n") >= MIN_GROUP, F.col(f"lang_{which}_{name}"))
            .otherwise(F.col(f"all_{which}_{name}"))
        )

    return joined.select(
        "lang", "source", F.col("own_n").alias("n_rows"), *(chosen(w, n).alias(f"{w}_{n}") for w, n in limits)
    )


def with_verdict(rows: DataFrame, limits: DataFrame, lang: str, source: str) -> DataFrame:
    """Join the fences of (lang, source) and add ``_tw_failed`` and ``_tw_kept``.

    A checked, small number of groups is broadcast, so texts stay where they are. More groups
    go through ``attach``, which spreads the rows of the heaviest ones.
    """
    keyed = limits.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("_tw_l"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("_tw_s"),
        F.col("n_rows").alias("_tw_n"),
        F.struct(*(c for c in limits.columns if c[:3] in ("hi_", "lo_"))).alias("_tw_t"),
    )
    rows = rows.withColumns({
        "_tw_l": F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit("-")),
        "_tw_s": F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("-")),
    })
    if keyed.count() <= MAX_BROADCAST_GROUPS:
        joined = rows.join(F.broadcast(keyed), ["_tw_l", "_tw_s"], "left")
    else:
        joined = attach(rows, keyed, ["_tw_l", "_tw_s"], weight="_tw_n")
    f, t = F.col("_tw_f"), F.col("_tw_t")
    inside = F.lit(True)
    for name, value in metric_columns(f).items():
        inside = inside & (value <= t[f"hi_{name}"])
        if METRICS[name][1]:
            inside = inside & (value >= t[f"lo_{name}"])
    return joined.withColumn("_tw_failed", base_failed(f)).withColumn(
        "_tw_kept", ~F.col("_tw_failed") & F.coalesce(inside, F.lit(False))
    )


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` with the verdict: columns ``_tw_f`` (counts), ``_tw_failed`` and ``_tw_kept``.

    A null text counts as empty and fails the base rules; null languages and sources are groups of
    their own; repeated rows are judged each; an empty table gives an empty table; other columns pass
    through. The texts are read twice, once for the sketches and once for the verdict, and not shuffled.
    """
    narrow = measured(docs.select(text, lang, source), text)
    limits = write_and_read(fences(write_and_read(sketches(narrow, lang, source), "sketch")), "fences")
    return with_verdict(measured(docs, text), limits, lang, source)


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: counts, ``base_failed`` and ``kept``. The texts are read once; see ``quality_rules``."""
    key = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = write_and_read(measured(key).drop("text"), "quality")
    limits = write_and_read(fences(sketches(rows, "lang", "source")), "fences")
    judged = with_verdict(rows, limits, "lang", "source")
    f = F.col("_tw_f")
    return judged.select(
        "doc_id", *(f[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        F.col("_tw_failed").alias("base_failed"), F.col("_tw_kept").alias("kept"),
        *(v.alias(f"{n}_permille") for n, v in metric_columns(f).items()),
    )


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass, with their columns unchanged."""
    judged = quality_rules(docs, text, lang, source)
    return judged.where("_tw_kept").select(*(F.col(c) for c in docs.columns))


