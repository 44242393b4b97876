"""Feature preparation: category codes, scaling, target statistics, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import uniform
from tidewell.operators.aggregates import mean_of
from tidewell.operators.attach import attach
from tidewell.operators.ordered import number_rows
from tidewell.session import stage


def category_codes(df: DataFrame, column: str, by: str = "frequency") -> DataFrame:
    """Fitted map (category, code, row count); by descending frequency or alphabetical.

    Kept as a table, so a column with very many categories never visits the driver.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.asc(column)] if by == "frequency" else [F.asc(column)]
    return number_rows(counted, [], order, "_tw_rn").select(
        column, (F.col("_tw_rn") - 1).cast("int").alias("code"), "n"
    )


def encode(df: DataFrame, codes: DataFrame, column: str, name: str, unknown: int | None = 0) -> DataFrame:
    """Code of each row's category; a category outside the map gets ``unknown``."""
    coded = attach(df, codes.withColumnRenamed("code", name), [column], weight="n", keep_weight=False)
    if unknown is None:
        return coded
    return coded.withColumn(name, F.coalesce(F.col(name), F.lit(unknown)))


def _frequency_coded(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``_tw_code``, null for a missing category, and ``_tw_size``, the number of categories. Codes stay a table."""
    codes = stage(category_codes(df, column), "codes")
    coded = encode(df, codes, column, "_tw_code", unknown=None)
    return coded.crossJoin(F.broadcast(codes.agg(F.count("*").cast("int").alias("_tw_size"))))


def one_hot_vector(df: DataFrame, column: str, name: str) -> DataFrame:
    """One-hot over frequency codes, last category dropped, as an array of 0 and 1; all 0 for a missing category.

    More than ``MOST_COLUMNS`` categories are refused: use ``one_hot_sparse``.
    """
    coded = _frequency_coded(df, column)
    wide = F.assert_true(F.col("_tw_size") <= MOST_COLUMNS, F.lit(f"more than {MOST_COLUMNS} categories in {column}"))
    slots = F.when(F.col("_tw_size") > 1, F.sequence(F.lit(0), F.col("_tw_size") - 2)).otherwise(F.array().cast("array<int>"))
    hot = F.transform(slots, lambda i: F.coalesce((i == F.col("_tw_code")).cast("double"), F.lit(0.0)))
    return coded.withColumn(name, F.when(wide.isNull(), hot)).select(*df.columns, name)


def one_hot_sparse(df: DataFrame, column: str, name: str) -> DataFrame:
    """The same as a struct (size, indices, values) with at most one entry, for any number of categories."""
    coded = _frequency_coded(df, column)
    size = F.greatest(F.col("_tw_size") - 1, F.lit(0))
    kept = F.col("_tw_code") < size
    indices = F.when(kept, F.array("_tw_code")).otherwise(F.array().cast("array<int>"))
    values = F.when(kept, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>"))
    return coded.withColumn(name, F.struct(size.alias("size"), indices.alias("indices"), values.alias("values"))).select(*df.columns, name)


#: Columns or entries that one row may get for its categories.
MOST_COLUMNS = 10_000


def one_hot_columns(df: DataFrame, column: str, values: Sequence[str] | None = None) -> DataFrame:
    """One 0/1 column ``column_value`` per category, none dropped; the category goes.

    The categories become column names, so without ``values`` all of them are looked up; more than
    ``MOST_COLUMNS`` are refused. For a column with very many categories use ``one_hot_pairs``.
    """
    if values is None:
        found = df.where(F.col(column).isNotNull()).select(column).distinct().limit(MOST_COLUMNS + 1).collect()
        if len(found) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} categories in {column}; name the values or use one_hot_pairs")
        values = sorted(r[0] for r in found)
    flags = [F.coalesce(F.col(column) == v, F.lit(False)).cast("int").alias(f"{column}_{v}") for v in values]
    return df.select(*(c for c in df.columns if c != column), *flags)


def one_hot_pairs(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The same in sparse form: (keys, code, value 1) of every row with a category, for any number of categories."""
    coded = encode(df.select(*keys, column), category_codes(df, column, by="alphabet"), column, "code", unknown=None)
    return coded.where(F.col(column).isNotNull()).select(*keys, "code", F.lit(1).alias("value"))


def target_statistics(
    df: DataFrame, keys: Sequence[str], target: str, prefix: str, train: Column | None = None,
    decimals: int | None = None,
) -> DataFrame:
    """Mean target and row count per key, joined back on to every row.

    ``train`` limits the rows the statistics are learned from.
    """
    learn = df if train is None else df.where(train)
    stats = learn.groupBy(*keys).agg(
        mean_of(F.col(target), decimals).alias(f"{prefix}_rate"), F.count("*").alias(f"{prefix}_count")
    )
    return attach(df, stats, keys, weight=f"{prefix}_count")


def assemble(df: DataFrame, columns: Sequence[str], name: str = "features", invalid: str = "error") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name, handleInvalid=invalid).transform(df)


def scale_standard(
    df: DataFrame, columns: Sequence[str], with_mean: bool = False, with_std: bool = True, name: str = "scaled"
) -> DataFrame:
    """MLlib scaling: sample deviation, mean kept by default."""
    assembled = assemble(df, columns, "_tw_raw")
    scaler = StandardScaler(inputCol="_tw_raw", outputCol=name, withMean=with_mean, withStd=with_std)
    return scaler.fit(assembled).transform(assembled).drop("_tw_raw")


def fit_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of means and population deviations."""
    return df.agg(
        *(F.avg(c).alias(f"_tw_mean_{c}") for c in columns),
        *(F.stddev_pop(c).alias(f"_tw_std_{c}") for c in columns),
    )


def scale_population(df: DataFrame, columns: Sequence[str], moments: DataFrame | None = None) -> DataFrame:
    """z-scores with population deviation; a constant column is only centred."""
    moments = moments if moments is not None else fit_moments(df, columns)
    out = df.crossJoin(F.broadcast(moments))
    z = {}
    for c in columns:
        std = F.when(F.col(f"_tw_std_{c}") == 0, 1.0).otherwise(F.col(f"_tw_std_{c}"))
        z[c] = (F.col(c) - F.col(f"_tw_mean_{c}")) / std
    return out.withColumns(z).select(*df.columns)


def fit_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of minima and maxima."""
    return df.agg(
        *(F.min(c).cast("double").alias(f"_tw_min_{c}") for c in columns),
        *(F.max(c).cast("double").alias(f"_tw_max_{c}") for c in columns),
    )


def scale_minmax(
    df: DataFrame, fitted: DataFrame, columns: Sequence[str], low: float = -1.0, high: float = 1.0, inverse: bool = False
) -> DataFrame:
    """Map [min, max] to [low, high], or back. A constant column maps to ``low``."""
    out = df.crossJoin(F.broadcast(fitted))
    mapped = {}
    for c in columns:
        smallest, span = F.col(f"_tw_min_{c}"), F.col(f"_tw_max_{c}") - F.col(f"_tw_min_{c}")
        span = F.when(span == 0, 1.0).otherwise(span)
        if inverse:
            mapped[c] = (F.col(c) - low) / (high - low) * span + smallest
        else:
            mapped[c] = (F.col(c) - smallest) / span * (high - low) + low
    return out.withColumns(mapped).select(*df.columns)


def hash_split(
    df: DataFrame, keys: Sequence[str], test: float = 0.2, seed: int = 42, strata: str | None = None
) -> DataFrame:
    """Label rows 'train' or 'test' by a keyed hash: the same whatever the layout.

    With ``strata`` exactly the rounded share of each stratum is held out.
    """
    lot = uniform(*(F.col(k) for k in keys), seed=seed)
    if strata is None:
        return df.withColumn("part", F.when(lot < test, "test").otherwise("train"))
    placed = number_rows(
        df.withColumn("_tw_lot", lot),
        [strata],
        [F.col("_tw_lot"), *(F.col(k) for k in keys)],
        "_tw_rn",
        total="_tw_n",
    )
    held = F.col("_tw_rn") <= F.round(F.col("_tw_n") * test)
    return placed.withColumn("part", F.when(held, "test").otherwise("train")).drop("_tw_lot", "_tw_rn", "_tw_n")


def hash_sample(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """Repeatable random sample of about ``fraction`` of the rows."""
    return df.where(uniform(*(F.col(k) for k in keys), seed=seed) < fraction)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Rows with ``weight``: negatives over positives for positives, 1 for the rest."""
    ratio = df.agg(
        (
            F.greatest(F.count_if(F.col(label) == 0), F.lit(1))
            / F.greatest(F.count_if(F.col(label) == 1), F.lit(1))
        ).alias("_tw_ratio")
    )
    weighted = df.crossJoin(F.broadcast(ratio))
    return weighted.withColumn(
        "weight", F.when(F.col(label) == 1, F.col("_tw_ratio")).otherwise(F.lit(1.0))
    ).drop("_tw_ratio")


