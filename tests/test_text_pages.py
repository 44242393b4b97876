"""Text weights against a direct computation; page extraction on small pages."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewell.functions import pages as P
from tidewell.functions import text as X

TEXTS = [
    (0, "The Quick brown fox, can't jump over 2 dogs!"), (1, "quick quick fox cannot"), (2, ""), (3, "A lazy dog; a lazy fox"),
    (4, "gonna fox"), (5, "café noir x y zz"),
]


def direct_terms(text):
    kept = re.sub(r"[^a-z\s]", "", text.lower())
    for a, b in X.SPLIT_WORDS:
        kept = re.sub(rf"\b{a}{b}\b", f"{a} {b}", kept)
    words = [w for w in kept.split() if w not in X.STOP_WORDS and len(w) >= 2]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def direct_weights(texts):
    counts = {i: Counter(direct_terms(t)) for i, t in texts}
    df = Counter(t for c in counts.values() for t in c)
    out = {}
    for i, c in counts.items():
        raw = {t: n * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        out.update({(i, t): w / norm for t, w in raw.items()})
    return out, df


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id int, text string")


def test_cleaning(texts):
    got = {r["id"]: r["c"] for r in texts.select("id", X.clean_text(F.col("text")).alias("c")).collect()}
    assert got[0] == "quick brown fox cant jump dogs" and got[1] == "quick quick fox" and got[2] == ""
    assert got[4] == "gon na fox" and got[5] == "caf noir x zz"


def test_weights(texts):
    want, _ = direct_weights(TEXTS)
    got = {(r["id"], r["term"]): r["weight"] for r in X.tfidf_weights(texts, "id", "text").collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_only_distinct_terms_of_a_block_travel(spark):
    """Terms of texts meet their count and norm where the texts lie; repeated and null keys keep their rows."""
    rows = [(i % 7 if i % 11 else None, f"fox dog {'fox ' * (i % 3)}w{chr(97 + i % 5)}x") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string")
    weights = X.tfidf_weights(df, "id", "text")
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id#" not in plan and plan.count("hashpartitioning(term#") == 1
    got = weights.collect()
    assert len(got) == sum(len(set(direct_terms(t))) for _, t in rows)
    assert {r["df"] for r in got if r["term"] == "fox"} == {60}
    squares = Counter()
    for r in got:
        squares[r["id"]] += r["weight"] ** 2
    assert set(squares) == {*range(7), None} and all(x == pytest.approx(1) for x in squares.values())


def test_similarity(texts):
    query = "quick fox unheardof"
    want, df = direct_weights(TEXTS)
    asked = {t: n * (math.log((1 + len(TEXTS)) / (1 + df[t])) + 1) for t, n in Counter(direct_terms(query)).items() if t in df}
    norm = math.sqrt(sum(w * w for w in asked.values()))
    scores = {i: sum(want.get((i, t), 0) * w for t, w in asked.items()) / norm for i, _ in TEXTS}
    best = sorted(((i, round(s, 6)) for i, s in scores.items() if s), key=lambda p: (-p[1], p[0]))[:3]
    assert [tuple(r) for r in X.most_similar(texts, "id", "text", query).collect()] == best
    unknown = X.most_similar(texts, "id", "text", "unheardof").collect()
    assert len(unknown) == min(3, texts.count()) and {r.score for r in unknown} == {0.0}


PAGE = """<html><head><title> A &amp; B </title><script>var p = "<p>no</p>";</script></head><body>
<h2>second</h2><h1> first </h1><p>one <b>bold</b> two</p><p>open <i>end<p>inner</p></div>
<h3>third</h3><h1>last</h1><br/><p/>x</body></html>"""


def test_title_and_content(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>no title"), (3, None)], "id int, html string")
    titles = {r["id"]: r["title"] for r in P.page_titles(pages, "id").collect()}
    assert titles == {1: "A & B", 2: None, 3: None}
    content = {r["id"]: (r["headers"], r["paragraphs"]) for r in P.page_contents(pages, "id").collect()}
    heads, paragraphs = content[1]
    assert heads == ["first", "last", "second", "third"]
    assert paragraphs[0] == "oneboldtwo" and "inner" in paragraphs and paragraphs[1].startswith("openend")
    assert content[2] == ([], ["no title"]) and content[3] == ([], [])


def test_rejected_markup_does_not_lose_the_page(spark):
    pages = spark.createDataFrame([(1, "<title>t</title><p>a</p><![odd[ <p>b"), (2, "<title>u")], "id int, html string")
    assert {r["id"]: r["title"] for r in P.page_titles(pages, "id").collect()} == {1: "t", 2: "u"}


CARD = """<ol class="row"><li class="col"><article class="product_pod"><div><a href="x"><img src="../../media/i.jpg"></a></div>
<p class="star-rating Three"></p><h3><a href="../../book_1/index.html" title="Full &quot;Title&quot;">Full...</a></h3>
<div><p class="price_color">Â£51.77</p><p class="instock availability"><i class="icon-ok"></i> In stock</p></div></article></li>
<li><h3>no link</h3></li></ol><ul><li>outside</li></ul>"""


def test_cards_pager_and_category(spark):
    pages = spark.createDataFrame(
        [(1, "https://s.example/catalogue/category/page-1.html", CARD + '<ul><li class="current"> Page 1 of 50 </li></ul>'), (2, "u", "<p>none</p>")],
        "id int, url string, html string",
    )
    cards = [r.asDict() for r in P.page_cards(pages, "id", "url").collect()]
    assert cards == [{
        "id": 1, "title": 'Full "Title"', "price": "51.77", "rating": "Three", "availability": "ok",
        "image": "https://s.example/media/i.jpg", "url": "https://s.example/book_1/index.html",
    }]
    assert {r[0]: r[1] for r in P.page_totals(pages, "id").collect()} == {1: 50, 2: 1}
    crumbs = spark.createDataFrame(
        [(1, '<ul class="breadcrumb"><li><a>H</a></li><li><a>B</a></li><li><a>Poetry</a></li></ul>'), (2, '<ul class="breadcrumb"><li>H</li></ul>'), (3, "")],
        "id int, html string",
    )
    assert {r[0]: r[1] for r in P.page_categories(crumbs, "id").collect()} == {1: "Poetry", 2: "Desconhecido", 3: "Desconhecido"}


def test_links_of_navigation_only(spark):
    pages = spark.createDataFrame([(1, '<nav><a href="/a">A</a></nav><a href="/b">B</a>'), (2, "none")], "id int, html string")
    assert [tuple(r) for r in P.page_links(pages, "id").collect()] == [(1, 0, "/a", "A")]


def test_long_pages_make_small_batches(spark):
    """What a Python worker is handed at once is bounded by its bytes, not only by its rows."""
    from tidewell.session import tune

    def sizes(batches):
        for batch in batches:
            yield batch[["id"]].head(1).assign(id=len(batch))

    pages = tune(spark).range(0, 1000, 1, 1).select("id", F.repeat(F.lit("x"), 40_000).alias("html"))
    handed = [r["id"] for r in pages.mapInPandas(sizes, "id long").collect()]
    assert sum(handed) == 1000 and max(handed) * 40_000 <= 9_000_000
    counts = P.page_contents(pages.withColumn("html", F.concat(F.lit("<p>"), "html")), "id").select(F.size("paragraphs").alias("n"))
    assert counts.groupBy("n").count().collect() == [(1, 1000)]
