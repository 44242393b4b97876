"""Credentials in documents, and weak candidates that gain weight from the parts next to them.

Three kinds are reported wherever they match. Account names, long random-looking keys and endpoints alone mean
little: they are reported only with a complementary part within the same scope, found by an interval join of
all parts of a text over position buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import write_and_read

#: Code points between two parts that may belong to one credential.
SCOPE = 300
#: Kinds in the order of a report; the first three are always reported.
KINDS = ("assign", "access", "hex", "account", "key", "endpoint")
#: What a kind is a part of.
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "account": "id", "key": "secret", "endpoint": "place"}
NEEDS = {"account": ("secret",), "key": ("id",), "endpoint": ("id", "secret")}

ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run with too few characters is no match and holds no other, so the least length can be part of these patterns.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ACCOUNT_WORDS = ("user", "login", "account", "client_id", "clientid", "access_key_id")
ACCOUNT = r"""(?i)\b(username|user|login|account|client_?id|access_key_id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})"""
KEY = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/=])"
ENDPOINT_WORDS = ("://", "host", "endpoint", "server")
ENDPOINT = r"""(?i)\b(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s"'<>]{4,}|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:/-]{4,}"""

_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def spans(text: Column, pattern: str, kind: int, least_of_group: tuple[int, int] | None = None) -> Column:
    """(start, kind, end) of all matches, in code points: the lengths of what lies between matches and of the matches add up to positions.

    ``least_of_group``: a group and the characters it must have.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    group, least = least_of_group or (0, 0)
    parts = F.zip_with(
        F.slice(between, 1, F.size(found)),
        F.zip_with(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m, g: F.struct(m.alias("m"), g.alias("g"))),
        lambda b, m: F.struct(
            F.length(b).cast("bigint").alias("gap"), F.length(m["m"]).cast("bigint").alias("len"), (F.length(m["g"]) >= least).alias("ok")
        ),
    )
    empty = F.array().cast(_SPANS)

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + part["gap"]
        end = start + part["len"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(part["ok"], F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(parts, start, step, lambda s: s["out"])).otherwise(empty)


def _when(condition: Column, value: Column) -> Column:
    """``value`` is only computed where the condition holds; elsewhere no spans."""
    return F.when(condition, value).otherwise(F.array().cast(_SPANS))


def _has(lower: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(lower, F.lit(w)) for w in words))


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (o["end"] > span["start"]))


def with_parts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(rid, doc_id, base, weak): spans of the kinds always reported, and of the weak ones, which never overlap them."""
    t, low = F.col("t"), F.col("low")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("low", F.lower("t"))
    base = F.concat(
        _when(_has(low, ASSIGN_WORDS), spans(t, ASSIGN, 0, (2, 6))),
        _when(F.contains(t, F.lit("AKIA")), spans(t, ACCESS, 1)),
        _when(t.rlike("[0-9a-f]{24}"), spans(t, HEX, 2)),
    )
    rows = rows.withColumn("base", base)
    account = _when(_has(low, ACCOUNT_WORDS), spans(t, ACCOUNT, 3))
    key = _when(t.rlike("[A-Za-z0-9+/]{32}"), spans(t, KEY, 4))
    place = _when(_has(low, ENDPOINT_WORDS), spans(t, ENDPOINT, 5))
    rows = rows.withColumn("weak", F.concat(account, key, place))
    free = F.filter("weak", lambda w: ~overlaps(w, F.col("base")))
    return rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "base", free.alias("weak"))


def linked_spans(parts: DataFrame) -> DataFrame:
    """(rid, span) of the weak spans that have every complementary role within their scope."""
    role = F.element_at(F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(i), F.lit(ROLES[k])))), F.col("kind"))
    both = parts.where((F.size("weak") > 0) & (F.size("base") + F.size("weak") > 1))
    every = both.select("rid", F.inline(F.concat("base", "weak"))).withColumn("role", role)

    def buckets(start: Column, end: Column) -> Column:
        return F.explode(F.sequence(F.floor(start / SCOPE), F.floor(end / SCOPE))).alias("bucket")

    # spans of one kind never overlap, so a bucket of one text holds a bounded number of parts
    there = every.select("rid", F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("role").alias("o_role"), buckets(F.col("start"), F.col("end")))
    weak = both.select("rid", F.inline("weak"))
    asks = weak.select("rid", "start", "kind", "end", buckets(F.greatest(F.col("start") - SCOPE, F.lit(0)), F.col("end") + SCOPE))
    met = asks.join(there, ["rid", "bucket"]).where((F.col("o_start") < F.col("end") + SCOPE) & (F.col("o_end") > F.col("start") - SCOPE))
    roles = met.groupBy("rid", "start", "kind", "end").agg(F.collect_set("o_role").alias("roles"))  # three roles at most
    enough = reduce(
        lambda a, b: a | b,
        ((F.col("kind") == KINDS.index(k)) & reduce(lambda x, y: x & y, (F.array_contains("roles", r) for r in needs)) for k, needs in NEEDS.items()),
    )
    return roles.where(enough).select("rid", F.struct("start", "kind", "end").alias("span"))


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: spans always reported (``base``) and linked ones (``linked``), each sorted by start and kind.

    Positions are code points of the whole text, ends exclusive. A null or empty text has no spans; repeated rows give a
    row each; matches of a kind do not overlap, the leftmost wins; other columns are not read; an empty table gives an empty table.
    """
    parts = write_and_read(with_parts(docs, doc_id, text), "parts")
    links = linked_spans(parts).groupBy("rid").agg(F.collect_list("span").alias("linked"))  # of one text
    joined = parts.join(links, "rid", "left")
    return joined.select(
        "doc_id", F.sort_array("base").alias("base"), F.sort_array(F.coalesce("linked", F.array().cast(_SPANS))).alias("linked")
    )


def as_text(found: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def secret_report(docs: DataFrame) -> DataFrame:
    found = secret_spans(docs)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
        as_text(F.sort_array(F.concat("base", "linked"))).alias("spans"),
    )
