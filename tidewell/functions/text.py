"""Title and text cleaning, word pairs, TF-IDF weights and similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.attach import attach
from tidewell.session import spread, stage

# English stop words, without those that hold an apostrophe
# (the cleaning removes apostrophes first, so they could never match).
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his
himself she her hers herself it its itself they them their theirs themselves what
which who whom this that these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for
with about against between into through during before after above below to from up
down in out on off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so than too
very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn
hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn
""".split()
# Words the tokeniser separates in two.
SPLIT_WORDS = [("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na")]


def clean_tokens(text: Column) -> Column:
    """Lower case, only a-z and blanks, split into words, stop words removed."""
    kept = F.regexp_replace(F.lower(text), r"(?U)[^a-z\s]", "")
    halves = "|".join(f"{a}(?={b}\\b)" for a, b in SPLIT_WORDS)
    apart = F.regexp_replace(kept, rf"\b({halves})", "$1 ")
    words = F.split(apart, r"(?U)\s+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def clean_text(text: Column) -> Column:
    return F.array_join(clean_tokens(text), " ")


def long_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: F.length(w) >= 2)


def with_neighbours(words: Column) -> Column:
    """The words and the pairs of neighbours among them."""
    pair_count = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(words, F.lit(1), pair_count),
        F.slice(words, F.lit(2), pair_count),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(words, pairs)


def exploded_terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term): every word of two letters or more and every pair of neighbours.

    The words get a projection of their own, so the cleaning runs once per text and not
    once per use.
    """
    words = df.select(key, long_words(clean_tokens(F.col(text))).alias("_tw_words"))
    return words.select(key, F.explode(with_neighbours(F.col("_tw_words"))).alias("term"))


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): occurrences of every term in every text, counted inside the row.

    The sorted terms of a text hold equal ones next to each other: where a run starts
    and how long it is gives the count, without moving texts or terms.
    """
    return _counted(_worded(df, key, text), key)


def _worded(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, long_words(clean_tokens(F.col(text))).alias("_tw_words"))


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line): the words that terms are made of, joined by blanks."""
    return _worded(df, key, text).select(key, F.array_join("_tw_words", " ").alias("line"))


def _counted(words: DataFrame, *keys: str) -> DataFrame:
    """The term counts of the words of every row, with its ``keys``."""
    ordered = words.select(*keys, F.sort_array(with_neighbours(F.col("_tw_words"))).alias("_tw_s"))
    terms = F.col("_tw_s")
    first = F.filter(
        F.sequence(F.lit(0), F.size(terms) - 1), lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1))
    )
    none = F.array().cast("array<int>")
    starts = ordered.select(*keys, "_tw_s", F.when(F.size(terms) > 0, first).otherwise(none).alias("_tw_at"))
    at = F.col("_tw_at")
    ends = F.slice(F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(terms))), F.lit(1), F.size(at))
    runs = F.zip_with(at, ends, lambda i, j: F.struct(F.get(terms, i).alias("term"), (j - i).cast("bigint").alias("tf")))
    return starts.select(*keys, F.inline(runs))


def smooth_idf(n: Column, document_count: Column) -> Column:
    return F.log((1 + n) / (1 + document_count)) + 1


def _term_tables(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Term counts, document counts per term, and the number of texts.

    The term counts feed both the document counts and the weights, so they are written
    once instead of tokenising the texts for each.
    """
    counts = stage(term_counts(spread(df.select(key, text)), key, text), "terms")
    frequency = counts.groupBy("term").agg(F.count("*").alias("df"))
    return counts, frequency, df.agg(F.count("*").alias("n"))


def _weighted(counts: DataFrame, frequency: DataFrame, total: DataFrame) -> DataFrame:
    """Adds df, n and the raw weight: tf times smooth idf.

    A frequent term is answered by the broadcast part of ``attach``; only rarer terms
    meet their document count in a shuffle.
    """
    return (
        attach(counts, frequency, ["term"], weight="df")
        .crossJoin(F.broadcast(total))
        .withColumn("raw", F.col("tf") * smooth_idf(F.col("n"), F.col("df")))
    )


#: Bytes of text in one block, about.
BLOCK_BYTES = 32 * 1024 * 1024


def text_size(df: DataFrame, text: str) -> tuple[int, int]:
    """Number of rows, and of bytes in their texts."""
    return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text).cast("bigint")), F.lit(0))).first())


def tfidf_weights(df: DataFrame, key: str, text: str) -> DataFrame:
    """Long sparse weights (key, term, df, weight), the weights of a text of unit length.

    The words of the texts are dealt out in blocks by key, once. Only a block's distinct terms travel, with the number of its texts that hold
    them, to be summed by term, and back with the sum; the terms of the texts meet it where they lie, in their block, and so does the norm, a window per text.
    """
    count, size = text_size(df, text)
    blocks = max(df.sparkSession.sparkContext.defaultParallelism, size // BLOCK_BYTES + 1)
    block = F.coalesce(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), F.lit(0))
    # the words travel as one string
    told = _worded(spread(df.select(key, text)), key, text).select(key, F.array_join("_tw_words", " ").alias("_tw_line"), block.alias("_tw_block"))
    line = F.col("_tw_line")
    parted = F.when(line != "", F.split(line, " ")).otherwise(F.array().cast("array<string>"))
    words = told.repartitionById(blocks, "_tw_block").select("_tw_block", key, parted.alias("_tw_words"))
    # every row counts; said with the key, so both uses of the words need the same columns and share one exchange
    rows = F.count(key) + F.count_if(F.col(key).isNull())
    distinct = words.select("_tw_block", key, F.explode(F.array_distinct(with_neighbours(F.col("_tw_words")))).alias("term"))
    held = distinct.groupBy("_tw_block", "term").agg(rows.alias("_tw_n")).repartition(blocks, "term")
    summed = held.select("_tw_block", "term", F.sum("_tw_n").over(Window.partitionBy("term")).alias("df")).repartitionById(blocks, "_tw_block")
    known = summed.select(F.col("_tw_block").alias("_tw_at"), F.col("term").alias("_tw_term"), "df").hint("shuffle_hash")
    met = _counted(words, "_tw_block", key).join(known, (F.col("_tw_block") == F.col("_tw_at")) & (F.col("term") == F.col("_tw_term")))
    raw = met.select("_tw_block", key, "term", "df", (F.col("tf") * smooth_idf(F.lit(count), F.col("df"))).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("_tw_block", key)))
    return raw.select(key, "term", "df", (F.col("raw") / norm).alias("weight"))


def most_similar(df: DataFrame, key: str, text: str, query: str, k: int = 3) -> DataFrame:
    """The k texts closest to the query by cosine of TF-IDF weights, for a single question; ``search`` keeps an index for many.

    Query terms unknown to the table are dropped; a text without a shared term scores 0, so there
    are k rows whenever there are k texts. One aggregate per text gives both the product with the query
    and the text's length; the query's own weights come from the document counts that travel with the rows.
    """
    spark = df.sparkSession
    # as many rows as the query text has terms
    asked = term_counts(spark.createDataFrame([(0, query)], "q int, text string"), "q", "text").select(
        F.col("term").alias("_tw_term"), F.col("tf").alias("_tw_qtf")
    )
    counts, frequency, total = _term_tables(df, key, text)
    is_asked = F.col("term") == F.col("_tw_term")
    query_weight = F.col("_tw_qtf") * smooth_idf(F.col("n"), F.col("df"))
    raw = F.col("raw")
    rows = _weighted(counts, frequency, total).join(F.broadcast(asked), is_asked, "left")
    per_text = rows.groupBy(key).agg(
        F.sum(raw * query_weight).alias("_tw_dot"), F.sqrt(F.sum(raw * raw)).alias("_tw_norm")
    )
    known = frequency.join(F.broadcast(asked), is_asked).crossJoin(F.broadcast(total))
    query_norm = known.agg(F.sqrt(F.sum(query_weight * query_weight)).alias("_tw_qn"))
    score = F.col("_tw_dot") / F.col("_tw_norm") / F.col("_tw_qn")
    scored = (
        per_text.where(F.col("_tw_dot").isNotNull()).crossJoin(F.broadcast(query_norm))
        .select(key, F.round(score, 6).alias("score"))
        .orderBy(F.desc("score"), key)
        .limit(k)
    )
    # the k first texts with score 0, of which only those without a score of their own fill up
    others = df.select(key, F.lit(0.0).alias("score")).orderBy(key).limit(2 * k)
    best = scored.unionByName(others).groupBy(key).agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), key).limit(k)
