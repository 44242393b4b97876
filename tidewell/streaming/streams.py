"""Structured Streaming forms of the log operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators.changes import apply_changes
from tidewell.operators.ordered import number_rows
from tidewell.sources.files import folder_exists, remove_folder


def log_stream(
    spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet",
    name_filter: str | None = None, files_per_batch: int | None = None,
) -> DataFrame:
    """An append-only folder of log files as an unbounded table."""
    reader = spark.readStream.schema(schema).format(kind)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def drain_to_files(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append everything available to Parquet files; a second run adds only what is new."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def drain_batches(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    """Hand every micro-batch to ``handle``, which must be repeatable per batch number."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def batch_writer(out: str) -> Callable[[DataFrame, int], None]:
    """Write each batch to its own folder; a replayed batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return write


def join_late_outcomes(
    decisions: DataFrame, outcomes: DataFrame, key: str, decided: str, outcome_key: str, observed: str,
    horizon_days: int = 30, lateness: str = "1 hour",
) -> DataFrame:
    """Each decision once, with its earliest outcome within the horizon, or reward 0; emitted once the horizon is over.

    Both watermarks and the time bound let the state of expired decisions be dropped. Re-sent outcomes
    meet in an aggregate per decision, whose state goes with the same watermark. What is not emitted yet
    is the difference to the decision log, see ``pending_decisions``.
    """
    left = decisions.withWatermark(decided, lateness)
    right = outcomes.withWatermark(observed, lateness)
    in_time = F.col(observed).between(
        F.col(decided), F.col(decided) + F.expr(f"interval {int(horizon_days)} days")
    )
    joined = left.join(right, (F.col(key) == F.col(outcome_key)) & in_time, "leftOuter")
    rest = [c for c in outcomes.columns if c != outcome_key]
    lot = F.struct(observed, *(c for c in rest if c != observed))
    first = joined.groupBy(*decisions.columns).agg(F.min_by(F.struct(*rest), lot).alias("_tw"))
    out = first.select(*decisions.columns, "_tw.*")
    return out.withColumn("reward", F.coalesce(F.col("reward"), F.lit(0)))


def pending_decisions(decisions: DataFrame, emitted: DataFrame, key: str) -> DataFrame:
    """Logged decisions that the stream has not given out yet, because their horizon is still open."""
    return decisions.join(emitted.select(key).distinct(), key, "left_anti")


def windowed_rate(stream: DataFrame, moment: str, reward: str, first_day, days: int = 7, lateness: str = "1 day") -> DataFrame:
    """Conversion rate per tumbling window aligned to ``first_day``; too late rows are dropped."""
    # windows start at multiples of their length since 1970-01-01
    offset = (first_day - type(first_day)(1970, 1, 1)).days % days
    window = F.window(moment, f"{days} days", f"{days} days", f"{offset} days")
    return (
        stream.withWatermark(moment, lateness).groupBy(window)
        .agg(F.count(reward).alias("n_obs"), F.sum(F.col(reward).cast("bigint")).alias("n_conv"))
        .select(F.col("window.start").alias("window_start"), "n_obs", "n_conv", (F.col("n_conv") / F.col("n_obs")).alias("rate"))
    )


def first_delivery(stream: DataFrame, key: str, moment: str, lateness: str = "2 days") -> DataFrame:
    """One record per key under re-delivery within the watermark."""
    return stream.withWatermark(moment, lateness).dropDuplicatesWithinWatermark([key])


def arm_totals(stream: DataFrame, arm: str, reward: str) -> DataFrame:
    """Running rounds and reward per offer, for update or complete mode."""
    return stream.groupBy(arm).agg(
        F.count("*").alias("rounds"), F.sum(F.col(reward).cast("bigint")).alias("total_reward")
    )


def totals_writer(out: str, arm: str) -> Callable[[DataFrame, int], None]:
    """Keep the newest totals of every offer: each batch writes those of the batch before, renewed where it has newer ones.

    Only the last two states are kept, the older one for a batch that is replayed.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{out}/batch={number - 1}"
        if folder_exists(spark, before):
            kept = spark.read.schema(batch.schema).parquet(before)
            batch = kept.join(batch.select(arm), arm, "left_anti").select(*batch.columns).unionByName(batch)
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        remove_folder(spark, f"{out}/batch={number - 2}")

    return write


def latest_totals(spark: SparkSession, out: str, arm: str) -> DataFrame:
    """The newest totals per offer, with the rate."""
    rows = spark.read.parquet(out)
    last = rows.agg(F.max("batch")).first()[0]
    newest = rows.where(F.col("batch") == last)
    return newest.select(arm, "rounds", "total_reward").withColumn("rate", F.col("total_reward") / F.col("rounds"))


def current_table(spark: SparkSession, base: DataFrame, out: str, key: str, seq: str, op: str) -> DataFrame:
    """The keyed table as of the change batches written so far (merged when read).

    A batch costs its own size; the table is not rewritten for it.
    """
    return apply_changes(base, spark.read.parquet(out).drop("batch"), key, seq, op)


class RefitSink:
    """Refit once enough new observations are pending, then start counting anew.

    Rows, the running count and versions live in folders per batch number, so a replayed batch
    replaces its own files and a lost driver finds its state again. A batch reads the one-row
    state of the batch before it, however many batches there were.
    """

    STATE = "since bigint, pending bigint"

    def __init__(
        self, root: str, fit: Callable[[DataFrame, str], None], every: int = 100, at_least: int = 50
    ):
        self.root, self.fit, self.every, self.at_least = root, fit, every, at_least

    def _state(self, spark: SparkSession, number: int) -> tuple[int, int]:
        """Last batch that was fitted, and the rows since, after batch ``number``."""
        path = f"{self.root}/state/batch={number}"
        if number < 0 or not folder_exists(spark, path):
            return -1, 0
        return tuple(spark.read.schema(self.STATE).parquet(path).first())

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{self.root}/rows/batch={number}")
        since, pending = self._state(spark, number - 1)
        pending += spark.read.parquet(f"{self.root}/rows/batch={number}").count()
        if pending >= max(self.every, self.at_least):
            waiting = spark.read.parquet(f"{self.root}/rows").where((F.col("batch") > since) & (F.col("batch") <= number))
            self.fit(waiting.drop("batch"), f"{self.root}/models/batch={number}")
            spark.createDataFrame([(pending,)], "n_rows bigint").coalesce(1).write.mode("overwrite").parquet(
                f"{self.root}/versions/batch={number}"
            )
            since, pending = number, 0
        spark.createDataFrame([(since, pending)], self.STATE).coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/state/batch={number}"
        )

    def versions(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("n_rows bigint, batch bigint").parquet(f"{self.root}/versions")


class CountedRefit:
    """Refit at every so many observations, wherever the micro-batches begin and end.

    Observations are numbered in the order of ``order`` within a batch and on from the batch before; each full ``every`` of
    them makes a version, so one batch of 250 rows gives the same versions as 250 batches of one. ``fit`` gets rows with a column ``version``
    and returns rows with it, for all the versions that a batch completes at once. Folders per batch number make a replayed batch replace its own
    files, and a one-row state says where the numbering stands and from which batch on rows still wait.
    """

    STATE = "total bigint, since bigint"

    def __init__(self, root: str, fit: Callable[[DataFrame], DataFrame], order: list[str], every: int = 100):
        self.root, self.fit, self.order, self.every = root, fit, order, every

    def _state(self, spark: SparkSession, number: int) -> tuple[int, int]:
        """Rows numbered so far, and the first batch with rows of an open version, after batch ``number``."""
        path = f"{self.root}/state/batch={number}"
        if number < 0 or not folder_exists(spark, path):
            return 0, 0
        return tuple(spark.read.schema(self.STATE).parquet(path).first())

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        total, since = self._state(spark, number - 1)
        numbered = number_rows(batch, [], [F.col(c) for c in self.order], "_tw_n")
        version = F.floor((F.col("_tw_n") + F.lit(total - 1)) / self.every) + 1
        placed = numbered.withColumn("version", version).drop("_tw_n")
        placed.write.mode("overwrite").parquet(f"{self.root}/rows/batch={number}")
        own = spark.read.schema(placed.schema).parquet(f"{self.root}/rows/batch={number}")
        before, total = total // self.every, total + own.count()
        complete = total // self.every
        if complete > before:
            folders = [f"{self.root}/rows/batch={b}" for b in range(since, number + 1) if folder_exists(spark, f"{self.root}/rows/batch={b}")]
            waiting = spark.read.schema(placed.schema).parquet(*folders).where((F.col("version") > before) & (F.col("version") <= complete))
            self.fit(waiting).write.mode("overwrite").parquet(f"{self.root}/models/batch={number}")
            since = number
        spark.createDataFrame([(total, since)], self.STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/state/batch={number}")

    def models(self, spark: SparkSession) -> DataFrame:
        """What was fitted, all versions."""
        return spark.read.parquet(f"{self.root}/models").drop("batch")
