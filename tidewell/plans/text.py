"""Queries of the page extraction and text operators."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tidewell.functions import pages as P
from tidewell.functions import search as S
from tidewell.functions import text as X
from tidewell.plans.common import sql_list
from tidewell.plans.registry import query
from tidewell.session import scratch_root, spread
from tidewell.tables import load

# blanks of the SQL patterns: the ASCII ones and the no-break space family
BLANK = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPLITS = "regexp_replace(lower(text), '[^a-z" + BLANK + "]', '', 'g')"
for first, second in X.SPLIT_WORDS:
    SPLITS = f"regexp_replace({SPLITS}, '\\b{first}{second}\\b', '{first} {second}', 'g')"
TOKENS = f"""
tokens AS (SELECT doc_id, list_filter(string_split_regex({SPLITS}, '[{BLANK}]+'),
    lambda w: w <> '' AND NOT list_contains({sql_list(X.STOP_WORDS)}, w)) AS w FROM documents)"""
TERMS = TOKENS + """,
long AS (SELECT doc_id, list_filter(w, lambda x: length(x) >= 2) AS w FROM tokens),
terms AS (SELECT doc_id, w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]) AS t FROM long)"""
WEIGHTS = TERMS + """,
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM terms) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
raw AS (SELECT doc_id, term, df, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)),
weights AS (SELECT doc_id, term, df, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


@query("page_title", r"""
SELECT page_id, regexp_replace(replace(replace(replace(replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;?', '&', 'g') AS title FROM pages""")
def page_title(spark, d):
    return P.page_titles(load(spark, d, "pages"), "page_id")


@query("page_content", r"""
SELECT page_id, CAST(len(regexp_extract_all(regexp_replace(html, '<script.*?</script>', '', 'gs'), '<p>[^<&]*</p>')) AS INTEGER) AS n_plain, true AS all_found FROM pages""")
def page_content(spark, d):
    """Paragraphs without inner markup, by pattern, are all among those the page reader finds, in order."""
    pages = load(spark, d, "pages").select("page_id", "html")
    bare = F.regexp_replace("html", "(?s)<script.*?</script>", "")
    plain = F.transform(F.regexp_extract_all(bare, F.lit("<p>([^<&]*)</p>"), F.lit(1)), lambda t: F.trim(t))
    found = P.page_contents(pages, "page_id").select(F.col("page_id").alias("found_id"), "paragraphs")
    both = pages.select("page_id", plain.alias("plain")).join(found, F.col("page_id") == F.col("found_id"))
    return both.select("page_id", F.size("plain").alias("n_plain"), (F.size(F.array_except("plain", "paragraphs")) == 0).alias("all_found"))


@query("page_headers", r"""
SELECT page_id, list_transform(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1), lambda h: regexp_replace(replace(replace(replace(replace(trim(h),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;?', '&', 'g')) AS headers FROM pages""")
def page_headers(spark, d):
    return P.page_contents(load(spark, d, "pages"), "page_id").select("page_id", "headers")


@query("page_content_counts", r"""
WITH c AS (SELECT page_id, regexp_replace(html, '<script.*?</script>', '', 'gs') AS h FROM pages)
SELECT page_id, CAST(len(regexp_extract_all(h, '<h[123][ >]')) AS INTEGER) AS n_headers, CAST(len(regexp_extract_all(h, '<p[ >]')) AS INTEGER) AS n_paragraphs FROM c""")
def page_content_counts(spark, d):
    return P.page_contents(load(spark, d, "pages"), "page_id").select(
        "page_id", F.size("headers").alias("n_headers"), F.size("paragraphs").alias("n_paragraphs")
    )


PAGE_SIZE = 20
# Rating words of the derived listing pages.
WORDS = ["One", "Two", "Three", "Four", "Five"]


def listing_pages(spark, d):
    """Catalogue listing pages written from the part table, twenty cards a page."""
    part = load(spark, d, "part")
    word = F.element_at(F.array(*(F.lit(w) for w in WORDS)), F.col("p_size") % 5 + 1)
    key = F.col("p_partkey").cast("string")
    card = F.concat(
        F.lit('<li class="col"><article><div><a href="x"><img src="../media/'), key, F.lit('.jpg"></a></div><p class="star-rating '),
        word, F.lit('"><i class="icon-star"></i></p><h3><a href="book_'), key, F.lit('/index.html" title="'), "p_name",
        F.lit(" &amp; "), "p_brand", F.lit('">short...</a></h3><div><p class="price_color">Â£'),
        F.format_string("%.2f", "p_retailprice"),
        F.lit('</p><p class="instock availability"><i class="icon-ok"></i> In stock</p></div></article></li>'),
    )
    page = F.floor(F.col("p_partkey") / PAGE_SIZE)
    pages = part.groupBy(page.alias("page_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", card.alias("card")))), lambda s: s["card"]), "").alias("cards")
    )
    last = part.agg(F.max(page).alias("last"))
    full = F.concat(
        F.lit('<html><body><ol class="row">'), "cards", F.lit("</ol>"),
        F.when(
            F.col("page_id") % 4 != 0,
            F.concat(F.lit('<ul class="pager"><li class="current"> Page '), F.col("page_id") + 1, F.lit(" of "), F.col("last") + 1, F.lit(" </li></ul>")),
        ).otherwise(""),
        F.lit("</body></html>"),
    )
    url = F.concat(F.lit("https://books.example/catalogue/page-"), F.col("page_id"), F.lit(".html"))
    return pages.crossJoin(F.broadcast(last)).select("page_id", url.alias("url"), full.alias("html"))


@query("page_cards", f"""
SELECT p_partkey // {PAGE_SIZE} AS page_id, p_name || ' & ' || p_brand AS title, format('{{:.2f}}', p_retailprice) AS price,
  {sql_list(WORDS)}[p_size % 5 + 1] AS rating, 'ok' AS availability,
  'https://books.example/media/' || p_partkey || '.jpg' AS image,
  'https://books.example/catalogue/book_' || p_partkey || '/index.html' AS url FROM part""")
def page_cards(spark, d):
    return P.page_cards(listing_pages(spark, d), "page_id", "url")


@query("page_total", f"""
WITH p AS (SELECT DISTINCT p_partkey // {PAGE_SIZE} AS page_id FROM part)
SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN CAST((SELECT max(page_id) + 1 FROM p) AS INTEGER) ELSE 1 END AS total_pages FROM p""")
def page_total(spark, d):
    return P.page_totals(listing_pages(spark, d), "page_id")


@query("page_category", """
SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 'Desconhecido' ELSE p_brand END AS category FROM part""")
def page_category(spark, d):
    crumb = F.when(F.col("p_size") % 6 != 0, F.concat(F.lit('<li><a href="../c">'), "p_brand", F.lit("</a></li>"))).otherwise("")
    html = F.concat(
        F.lit('<html><ul class="other"><li>a</li><li>b</li><li><a>no</a></li></ul><ul class="breadcrumb"><li><a href="/">Home</a></li><li><a>Books</a></li>'),
        crumb, F.lit("</ul></html>"),
    )
    return P.page_categories(load(spark, d, "part").select("p_partkey", html.alias("html")), "p_partkey")


@query("page_categories_nav", r"""
WITH n AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages)
SELECT page_id, CASE WHEN len(t) >= 3 AND t[3] <> '' THEN t[3] ELSE 'Desconhecido' END AS category FROM n""")
def page_categories_nav(spark, d):
    """The third entry of the navigation list of the stored pages."""
    return P.page_categories(load(spark, d, "pages"), "page_id", tag="nav", mark=None)


@query("page_links_udtf", r"""
WITH n AS (SELECT page_id, regexp_extract(html, '<nav>(.*?)</nav>', 1, 's') AS nav FROM pages),
l AS (SELECT page_id, regexp_extract_all(nav, '<a href="([^"]*)"', 1) AS h, regexp_extract_all(nav, '<a href="[^"]*">([^<]*)</a>', 1) AS t FROM n)
SELECT page_id, CAST(i - 1 AS INTEGER) AS position, h[i] AS href, t[i] AS label FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM l)""")
def page_links_udtf(spark, d):
    return P.page_links(load(spark, d, "pages").select("page_id", "html"), "page_id")


@query("clean_text", f"WITH {TOKENS} SELECT doc_id, array_to_string(w, ' ') AS clean FROM tokens")
def clean_text(spark, d):
    return spread(load(spark, d, "documents").select("doc_id", "text")).select("doc_id", X.clean_text(F.col("text")).alias("clean"))


@query("ngrams", f"WITH {TERMS} SELECT doc_id, unnest(t) AS term FROM terms")
def ngrams(spark, d):
    return X.exploded_terms(load(spark, d, "documents"), "doc_id", "text")


@query("tfidf_weights", f"WITH {WEIGHTS} SELECT doc_id, term, df, round(weight, 6) AS weight FROM weights")
def tfidf_weights(spark, d):
    return X.tfidf_weights(load(spark, d, "documents"), "doc_id", "text").withColumn("weight", F.round("weight", 6))


def _index(spark, d):
    """The index of the documents of a folder: built by the first query that asks it, found again by the others while the files stay the same."""
    folder = f"{scratch_root(spark)}/tidewell/text-index-{hashlib.md5(d.encode()).hexdigest()}"
    return S.index_of(load(spark, d, "documents"), "doc_id", "text", folder)


QUESTION = "That the hein thatre eranenes, whou therouou heron then eratsh; theren blees sheon erstly at the rest of unseen zzz"


@query("text_similar", f"""
WITH {WEIGHTS.replace('FROM documents)', "FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1, '" + QUESTION + "'))", 1).replace(
    'tf AS (', 'tf_all AS (', 1).replace('df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)',
    'tf AS (SELECT * FROM tf_all WHERE doc_id >= 0), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)')},
asked AS (SELECT term, df, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS q FROM tf_all JOIN df USING (term) WHERE doc_id = -1),
s AS (SELECT doc_id, round(sum(weight * q) / (SELECT sqrt(sum(q * q)) FROM asked), 6) AS score FROM weights JOIN asked USING (term) GROUP BY 1)
SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 3""")
def text_similar(spark, d):
    return S.most_similar(spark, _index(spark, d), QUESTION, k=3)


@query("text_similar_unknown", "SELECT doc_id, 0.0::DOUBLE AS score FROM documents ORDER BY doc_id LIMIT 3")
def text_similar_unknown(spark, d):
    """No text shares a word with the question: still three rows."""
    return S.most_similar(spark, _index(spark, d), "qqqq zzzz", k=3)


@query("text_similar_each", f"""
WITH {WEIGHTS}, questions AS (SELECT item_id, text AS question FROM benchmark),
q_split AS (SELECT item_id AS doc_id, question AS text FROM questions),
{TERMS.replace('tokens', 'q_tokens').replace('FROM documents)', 'FROM q_split)').replace('long AS', 'q_long AS').replace('FROM long', 'FROM q_long').replace('terms AS', 'q_terms AS').strip()},
q_tf AS (SELECT doc_id AS item_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM q_terms) GROUP BY 1, 2),
asked AS (SELECT item_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS q FROM q_tf JOIN df USING (term)),
lengths AS (SELECT item_id, sqrt(sum(q * q)) AS len FROM asked GROUP BY 1),
s AS (SELECT item_id, doc_id, round(sum(weight * q) / max(len), 6) AS score FROM weights JOIN asked USING (term) JOIN lengths USING (item_id) GROUP BY 1, 2)
SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s
QUALIFY rank <= 3""")
def text_similar_each(spark, d):
    """The three closest documents of every benchmark item, all asked of the stored index at once."""
    return S.most_similar_each(_index(spark, d), load(spark, d, "benchmark"), "item_id", "text", k=3)
