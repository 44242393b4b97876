"""Queries of the projection, filter, ordering and set operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidewell.functions.columns import date_key, plain_date
from tidewell.operators import relational as R
from tidewell.plans.common import BARS, bars
from tidewell.plans.registry import query
from tidewell.tables import load

LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice"]
LINE_KEY_SQL = ", ".join(LINE_KEY)


@query("rename_columns", """
SELECT o_orderkey AS pedido, o_custkey AS cliente, o_orderstatus AS situacao, o_totalprice AS total,
  o_orderdate, o_orderpriority FROM orders""")
def rename_columns(spark, d):
    names = {"o_orderkey": "pedido", "o_custkey": "cliente", "o_orderstatus": "situacao", "o_totalprice": "total"}
    return R.rename_columns(load(spark, d, "orders"), names)


@query("drop_columns", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate FROM lineitem""")
def drop_columns(spark, d):
    gone = ["l_tax", "l_discount", "l_returnflag", "l_linestatus", "l_comment"]
    return R.drop_present(load(spark, d, "lineitem"), gone)


@query("project_preview", f"""
SELECT {LINE_KEY_SQL} FROM lineitem
ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice LIMIT 20""")
def project_preview(spark, d):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    return R.preview(load(spark, d, "lineitem"), LINE_KEY, [F.col(c) for c in order], 20)


@query("filter_equals", "SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey")
def filter_equals(spark, d):
    return R.where_equals(load(spark, d, "orders"), o_orderstatus="F").orderBy("o_totalprice", "o_orderkey")


def gappy_orders(spark, d):
    """Orders with nulls planted by key arithmetic."""
    k = F.col("o_orderkey")
    return load(spark, d, "orders").select(
        "o_orderkey", "o_custkey",
        F.when(k % 6 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 10 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(k % 15 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
    )


GAPPY = """
gappy AS (SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 6 <> 0 THEN o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 15 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders)"""


@query("filter_null", f"WITH {GAPPY} SELECT * FROM gappy WHERE o_totalprice IS NULL")
def filter_null(spark, d):
    return R.where_null(gappy_orders(spark, d), "o_totalprice")


@query("filter_or", "SELECT * FROM lineitem WHERE l_discount = 0 OR l_tax = 0")
def filter_or(spark, d):
    return R.where_any(load(spark, d, "lineitem"), [F.col("l_discount") == 0, F.col("l_tax") == 0])


@query("search_contains", "SELECT * FROM part WHERE p_name ILIKE '%RING%' AND p_type ILIKE '%an%'")
def search_contains(spark, d):
    return R.search(load(spark, d, "part"), p_name="RING", p_type="an", p_brand=None)


@query("filter_range", "SELECT * FROM part WHERE p_retailprice BETWEEN 950 AND 1100")
def filter_range(spark, d):
    return R.where_between(load(spark, d, "part"), "p_retailprice", 950.0, 1100.0)


@query("filter_range_open", "SELECT * FROM orders WHERE o_totalprice >= 250000")
def filter_range_open(spark, d):
    return R.where_between(load(spark, d, "orders"), "o_totalprice", low=250000.0)


@query("filter_suffix_max", "SELECT * FROM part WHERE p_name ILIKE '%RING' AND p_size <= 25")
def filter_suffix_max(spark, d):
    return R.where_ends_with(load(spark, d, "part"), "p_name", "RING", "p_size", 25)


@query("trim_outliers", """
SELECT * FROM lineitem WHERE l_extendedprice > 0
  AND l_extendedprice <= (SELECT quantile_cont(l_extendedprice, 0.99) FROM lineitem)""")
def trim_outliers(spark, d):
    return R.trim_outliers(load(spark, d, "lineitem"), "l_extendedprice", 0.99)


@query("lookup_keys", """
WITH wanted AS (SELECT DISTINCT l_orderkey * 2 AS o_orderkey FROM lineitem)
SELECT w.o_orderkey, o_custkey, o_totalprice, o.o_orderkey IS NOT NULL AS found
FROM wanted w LEFT JOIN orders o USING (o_orderkey)""")
def lookup_keys(spark, d):
    wanted = load(spark, d, "lineitem").select((F.col("l_orderkey") * 2).alias("o_orderkey"))
    table = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return R.lookup(table, wanted, "o_orderkey")


@query("recode_conditional", """
SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'N' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def recode_conditional(spark, d):
    rows = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return R.recode(rows, "o_orderstatus", F.col("o_totalprice") < 100000, "N").drop("o_totalprice")


@query("fill_constants", f"""
WITH {GAPPY} SELECT o_orderkey, o_custkey, coalesce(o_orderstatus, 'UNKNOWN') AS o_orderstatus,
  coalesce(o_totalprice, 0) AS o_totalprice, coalesce(o_orderpriority, 'UNKNOWN') AS o_orderpriority FROM gappy""")
def fill_constants(spark, d):
    return R.fill_constants(
        gappy_orders(spark, d), {"o_orderstatus": "UNKNOWN", "o_orderpriority": "UNKNOWN", "o_totalprice": 0.0}
    )


@query("derive_label", f"""
SELECT {LINE_KEY_SQL}, l_quantity + l_linenumber AS total, CAST(l_quantity + l_linenumber > 30 AS INTEGER) AS label FROM lineitem""")
def derive_label(spark, d):
    rows = load(spark, d, "lineitem")
    return R.add_total_and_label(rows, ["l_quantity", "l_linenumber"], "total", "label", 30).select(*LINE_KEY, "total", "label")


@query("slice_time", f"WITH {BARS} SELECT * FROM bars WHERE day >= DATE '2024-01-11'")
def slice_time(spark, d):
    return R.from_date(bars(spark, d), "day", date(2024, 1, 11))


@query("last_rows", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def last_rows(spark, d):
    return R.last_rows(load(spark, d, "events").select("event_id", "ts", "event_type"), ["ts", "event_id"], 25)


@query("pick_one_per_group", """
SELECT c_mktsegment, c_custkey, c_name FROM customer
QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || '|42'), CAST(c_custkey AS VARCHAR)) = 1""")
def pick_one_per_group(spark, d):
    rows = load(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_name")
    return R.pick_one(rows, "c_mktsegment", "c_custkey", 42)


@query("sort_user_choice", "SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey")
def sort_user_choice(spark, d):
    return R.sort_by_choice(load(spark, d, "part"), "p_retailprice", False, "p_partkey")


@query("newest_page", "SELECT * FROM events ORDER BY event_id DESC LIMIT 10 OFFSET 30")
def newest_page(spark, d):
    return R.newest(load(spark, d, "events"), "event_id", limit=10, offset=30)


@query("paginate", """
SELECT p_partkey, p_name, p_brand, CAST(ceil(row_number() OVER (ORDER BY p_name, p_partkey) / 25) AS BIGINT) AS page,
  CAST(ceil(count(*) OVER () / 25) AS BIGINT) AS page_count FROM part""")
def paginate(spark, d):
    rows = load(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    return R.number_pages(rows, [F.col("p_name"), F.col("p_partkey")], 25)


@query("paginate_deep", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 10 OFFSET (SELECT count(*) // 2 FROM orders)")
def paginate_deep(spark, d):
    """A page in the middle of the table: found by counting ranges of the key, not by sorting all rows before it."""
    rows = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return R.newest(rows, "o_orderkey", limit=10, offset=rows.count() // 2)


@query("top_k", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 3")
def top_k(spark, d):
    return R.top_k(load(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 3)


@query("append_batches", """
SELECT event_id, ts, event_type FROM events WHERE value >= 20
UNION ALL SELECT event_id, ts, event_type FROM events WHERE value < 20
UNION ALL SELECT event_id, ts, event_type FROM events WHERE event_type = 'error'""")
def append_batches(spark, d):
    events = load(spark, d, "events")
    parts = [events.where("value >= 20"), events.where("value < 20"), events.where("event_type = 'error'")]
    columns = ["event_id", "ts", "event_type"]
    return R.append_batches(parts[0].select(columns), *(p.select(columns[::-1]) for p in parts[1:]))


@query("union_keys", """
SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier ORDER BY 1""")
def union_keys(spark, d):
    left = load(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"))
    right = load(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    return R.union_keys(left, right, "nationkey")


@query("set_equality", """
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer),
n AS (SELECT (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS only_left,
             (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS only_right)
SELECT only_left, only_right, only_left = 0 AND only_right = 0 AS equal FROM n""")
def set_equality(spark, d):
    left = load(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    right = load(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return R.same_set(left, right)


@query("quote_columns", f"""
WITH {BARS} SELECT series, day, CAST(strftime(day, '%Y%m%d') AS INTEGER) AS dataproc, open AS "Abertura",
  high AS "Máximo", low AS "Mínimo", close AS "Fechamento", volume AS "Volume de Transação" FROM bars""")
def quote_columns(spark, d):
    labels = {
        "open": "Abertura", "high": "Máximo", "low": "Mínimo", "close": "Fechamento", "volume": "Volume de Transação",
    }
    renamed = R.rename_columns(bars(spark, d), labels)
    return renamed.withColumn("dataproc", date_key(plain_date(F.col("day"))))
