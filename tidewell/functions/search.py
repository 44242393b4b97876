"""A stored inverted index of texts: fitted once, then asked many times.

The folder holds ``postings`` (key, term, df, tf), in directories by bucket of the term's hash and sorted by term, ``keys`` (key, norm), ``first``
(the first keys in order, for questions without a known term) and, written last, ``facts``. The weights are those of
``tfidf_weights``: tf times the smooth idf of df, over the norm of the text. So the score of a text is a sum over the terms of a query,
and a query reads only the buckets of its own terms and the norms.

Building keeps disk in bounds: postings travel in compressed blocks (``postings.py``) that are written beside the index, and a round of parts after the other is
turned into buckets and deleted; the files of a shuffle go with the job that made them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.functions.postings import BLOCK_DDL, packed, term_hash, unpacked
from tidewell.functions.text import smooth_idf, term_counts, text_lines, text_size
from tidewell.session import held, spread, stage
from tidewell.sources.files import broadcast_if_small, folder_exists, remove_folder

#: Postings in one bucket, about; where there are most buckets already, in one unit of a bucket; and in one part of the building.
BUCKET_ROWS, UNIT_ROWS, PART_ROWS = 250_000, 1_500_000, 1_500_000
#: Bytes of text to a posting, about.
TERM_BYTES = 5
MIN_BUCKETS, MAX_BUCKETS = 16, 4096
#: The index is built in so many rounds at most, one for each so many bytes of text.
ROUNDS, ROUND_BYTES = 4, 64 * 1024 * 1024
#: Tasks that sum the norms, at most: each hands on a row for every text it meets.
NORM_TASKS = 48
#: Products of a question's term and a text's that one task sums, about.
PRODUCTS = 2_000_000
#: Marks an index of this form.
FORM = 2
#: Shuffles are deleted when their job ends; a task writes all buckets of its parts at once, so rows stay as they come, sorted.
BUILDING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": "256"}
#: Keys kept for texts that share nothing with a query; larger k read all keys.
FIRST_KEYS = 2_000
#: Places that scores are rounded to.
DIGITS = 6


@dataclass(frozen=True)
class TextIndex:
    """A complete index in a folder. ``n`` texts, so many buckets, and the name and type of the key column."""

    folder: str
    n: int
    buckets: int
    key: str
    kind: str
    fingerprint: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """``postings``, ``keys`` or ``first``; ``terms`` (term, df, bucket) is taken from the postings."""
        if name == "terms":
            return self.table(spark, "postings").groupBy("term", "bucket").agg(F.max("df").alias("df"))
        columns = {"postings": f"key {self.kind}, term string, df bigint, tf int, bucket int", "keys": f"key {self.kind}, norm double"}
        return spark.read.schema(columns.get(name, f"key {self.kind}")).parquet(f"{self.folder}/{name}")

    def bucket(self, term: str = "term"):
        return F.pmod(term_hash(term), F.lit(self.buckets)).cast("int")


def fingerprint(df: DataFrame) -> str:
    """Changes when a file of the scanned table changes, comes or goes; reads no column of it. Empty for tables without files."""
    if not df.inputFiles():
        return ""
    file = F.struct("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    files = df.select(file.alias("f")).distinct()
    n, mark = files.agg(F.count("*"), F.sum(F.xxhash64("f").cast("decimal(38,0)"))).first()
    return f"{n}/{mark}"


def build_index(df: DataFrame, key: str, text: str, folder: str) -> TextIndex:
    """Write the index of a table whose ``key`` is unique. Texts without terms, null or empty, are found only with score 0."""
    spark = df.sparkSession
    n, size = text_size(df, text)
    expected = size // TERM_BYTES
    buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, expected // BUCKET_ROWS))
    units = buckets * (expected // buckets // UNIT_ROWS + 1)
    parts = min(units, max(spark.sparkContext.defaultParallelism, expected // PART_ROWS + 1))
    rounds = min(ROUNDS, size // ROUND_BYTES + 1)
    kind = df.schema[key].dataType
    ddl = f"key {kind.simpleString()}, term string, df bigint, tf int, bucket int"
    for name in ("blocks", "postings"):
        remove_folder(spark, f"{folder}/{name}")
    with held(spark, BUILDING):
        lines = text_lines(spread(df.select(key, text)), key, text)
        blocks = lines.mapInArrow(packed(units, parts, rounds), BLOCK_DDL)
        blocks.write.partitionBy("round").option("compression", "none").parquet(f"{folder}/blocks")
        written = spark.read.schema(BLOCK_DDL).parquet(f"{folder}/blocks")
        for i in range(rounds):
            some = written.where(F.col("round") == i).select("part", "size", "block")
            # the parts of a round are i, i + rounds and so on
            own = some.repartitionById(len(range(i, parts, rounds)), F.floor(F.col("part") / rounds).cast("int"))
            done = own.mapInArrow(unpacked(units, parts, buckets, to_arrow_type(kind)), ddl)
            done.write.mode("append").partitionBy("bucket").option("compression", "zstd").option("parquet.writer.version", "v2").parquet(f"{folder}/postings")
            remove_folder(spark, f"{folder}/blocks/round={i}")
        postings = spark.read.schema(ddl).parquet(f"{folder}/postings")
        raw = F.col("tf") * smooth_idf(F.lit(n), F.col("df"))
        squares = postings.select("key", (raw * raw).alias("square")).coalesce(NORM_TASKS)
        # every key has a row, also that of a text without terms
        sums = squares.unionByName(df.select(F.col(key).alias("key"), F.lit(0.0).alias("square"))).groupBy("key")
        sums.agg(F.sqrt(F.sum("square")).alias("norm")).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/keys")
        kept = spark.read.schema(f"key {kind.simpleString()}, norm double").parquet(f"{folder}/keys")
        kept.select("key").orderBy("key").limit(FIRST_KEYS).write.mode("overwrite").parquet(f"{folder}/first")
        remove_folder(spark, f"{folder}/blocks")
        facts = (n, buckets, key, kind.simpleString(), fingerprint(df))
        row = spark.createDataFrame([(*facts, FORM)], "n bigint, buckets int, key string, kind string, fingerprint string, form int")
        row.coalesce(1).write.mode("overwrite").parquet(f"{folder}/facts")
    return TextIndex(folder, *facts)


def open_index(spark: SparkSession, folder: str) -> TextIndex | None:
    """The index in a folder, or None if none was written there to its end."""
    if not folder_exists(spark, f"{folder}/facts/_SUCCESS"):
        return None
    facts = spark.read.parquet(f"{folder}/facts")
    names = ["n", "buckets", "key", "kind", "fingerprint"]
    # one written by another version of this module counts as none
    if set(facts.columns) != {*names, "form"}:
        return None
    *found, form = facts.select(*names, "form").first()
    return TextIndex(folder, *found) if form == FORM else None


def index_of(df: DataFrame, key: str, text: str, folder: str) -> TextIndex:
    """The index in the folder if it is that of the files of ``df``, or else a new one."""
    spark = df.sparkSession
    found = open_index(spark, folder)
    if found is not None and found.key == key and found.fingerprint and found.fingerprint == fingerprint(df):
        return found
    remove_folder(spark, f"{folder}/facts")
    return build_index(df, key, text, folder)


def _idf(n: int, df: int) -> float:
    return math.log((1 + n) / (1 + df)) + 1


def most_similar(spark: SparkSession, index: TextIndex, query: str, k: int = 3) -> DataFrame:
    """The k texts closest to the query by cosine of TF-IDF weights.

    Query terms unknown to the index are dropped; a text without a shared term scores 0, so there are k rows whenever there are k
    texts. The terms of the query are looked up first, which tells the buckets to read and the weights of the query.
    """
    asked = term_counts(spark.createDataFrame([(0, query)], "q int, text string"), "q", "text")
    # as many rows as the query has terms
    counts = {r["term"]: (r["tf"], r["bucket"]) for r in asked.select("term", "tf", index.bucket().alias("bucket")).collect()}
    postings = index.table(spark, "postings")

    def of(terms):
        return postings.where(F.col("bucket").isin(sorted({counts[t][1] for t in terms})) & F.col("term").isin(sorted(terms)))

    known = {r["term"]: r["df"] for r in of(counts).groupBy("term").agg(F.max("df").alias("df")).collect()} if counts else {}
    idf = {t: _idf(index.n, df) for t, df in known.items()}
    raw = {t: counts[t][0] * idf[t] for t in known}
    length = math.sqrt(sum(w * w for w in raw.values()))
    if raw:
        weights = spark.createDataFrame([(t, w / length * idf[t]) for t, w in sorted(raw.items())], "term string, asked double")
        dots = of(raw).join(F.broadcast(weights), "term").groupBy("key").agg(F.sum(F.col("tf") * F.col("asked")).alias("_tw_dot"))
        found = dots.select(F.col("key").alias("_tw_key"), "_tw_dot")
        every = index.table(spark, "keys").join(found, F.col("key").eqNullSafe(F.col("_tw_key")), "left")
        scored = every.select("key", F.coalesce(F.round(F.col("_tw_dot") / F.col("norm"), DIGITS), F.lit(0.0)).alias("score"))
    else:
        scored = index.table(spark, "first" if k <= FIRST_KEYS else "keys").select("key", F.lit(0.0).alias("score"))
    return scored.orderBy(F.desc("score"), "key").limit(k).withColumnRenamed("key", index.key)


def most_similar_each(index: TextIndex, queries: DataFrame, query_key: str, text: str, k: int = 3) -> DataFrame:
    """For every row of ``queries`` its k closest texts that share a term with it: (query key, key, score, rank).

    One pass over the postings of the buckets that any query needs, for any number of queries. The postings of asked terms meet per text, once
    for all queries; scores are summed there, and each task keeps the k best of a query before they are ranked.
    """
    spark = queries.sparkSession
    asked = term_counts(queries.where(F.col(query_key).isNotNull()), query_key, text).withColumn("bucket", index.bucket())
    asked = stage(asked, "asked")
    terms = broadcast_if_small(asked.select("bucket", "term").distinct())
    postings = index.table(spark, "postings")
    known = postings.join(terms, ["bucket", "term"], "left_semi").groupBy("bucket", "term").agg(F.max("df").alias("df"))
    known = stage(known.withColumn("at", F.monotonically_increasing_id()), "known")
    idf = smooth_idf(F.lit(index.n), F.col("df"))
    raw = F.col("tf") * idf
    length = F.sqrt(F.sum(raw * raw).over(Window.partitionBy(query_key)))
    weighed = stage(asked.join(known, ["bucket", "term"]).select(query_key, "at", "df", (raw / length * idf).alias("asked")), "weighed")
    # as many products as the asked terms have postings
    products = weighed.agg(F.sum("df")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), products // PRODUCTS + 1)
    met = postings.drop("df").join(broadcast_if_small(known.select("bucket", "term", "at")), ["bucket", "term"])
    none = F.lit(None)
    rows = met.select("key", "at", "tf", none.cast("double").alias("norm")).unionByName(
        index.table(spark, "keys").select("key", none.cast("bigint").alias("at"), none.cast("int").alias("tf"), "norm")
    )
    hits = F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "tf")))
    texts = rows.repartition(tasks, "key").groupBy("key").agg(F.max("norm").alias("norm"), hits.alias("hits"))
    each = texts.select("key", "norm", F.inline("hits")).join(broadcast_if_small(weighed.select(query_key, "at", "asked")), "at")
    dots = each.groupBy("key", "norm", query_key).agg(F.sum(F.col("tf") * F.col("asked")).alias("_tw_dot"))
    scores = dots.select(query_key, F.col("key").alias(index.key), F.round(F.col("_tw_dot") / F.col("norm"), DIGITS).alias("score"))
    best = Window.partitionBy(query_key).orderBy(F.desc("score"), index.key)
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
