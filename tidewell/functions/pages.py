"""Extraction from stored web pages: titles, headings, paragraphs, cards, links."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tidewell.functions.columns import after_prefix, last_piece, last_word_int, resolve_link
from tidewell.session import spread

# Elements without content, and elements whose content is not text.
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = {"script", "style", "template"}
NO_CATEGORY = "Desconhecido"
#: Pages whose extracts a task holds at once.
PAGES_AT_ONCE = 256


class Element:
    """One element with its attributes, place and the text found inside it."""

    __slots__ = ("tag", "attrs", "parent", "pieces")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.pieces = tag, attrs, parent, []

    def enclosing(self) -> Iterator[Element]:
        above = self.parent
        while above is not None:
            yield above
            above = above.parent

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def text(self) -> str:
        return "".join(self.pieces)

    def stripped(self) -> str:
        return "".join(p.strip() for p in self.pieces)

    def within(self, other: Element) -> bool:
        return any(e is other for e in self.enclosing())


class PageReader(HTMLParser):
    """Collects the elements with wanted tags. An unclosed element runs on until its
    parent closes, so it holds the text of what follows."""

    def __init__(self, wanted: set[str]):
        super().__init__(convert_charrefs=True)
        self.wanted, self.open, self.found, self.run = wanted, [], [], []

    def _end_run(self) -> None:
        # neighbouring character data forms one piece
        if self.run:
            piece = "".join(self.run)
            self.run = []
            if not any(e.tag in RAW_TAGS for e in self.open):
                for element in self.open:
                    if element.tag in self.wanted:
                        element.pieces.append(piece)

    def handle_starttag(self, tag, attrs):
        self._end_run()
        element = Element(tag, {k: v or "" for k, v in attrs}, self.open[-1] if self.open else None)
        if tag in self.wanted:
            self.found.append(element)
        if tag not in VOID_TAGS:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._end_run()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.run.append(data)

    def handle_comment(self, data):
        self._end_run()

    def close(self):
        super().close()
        self._end_run()


def read_page(html: str | None, wanted: set[str]) -> list[Element]:
    reader = PageReader(wanted)
    try:
        reader.feed(html or "")
        reader.close()
    except AssertionError:
        # a declaration the parser rejects: keep what came before it, not lose the job
        reader._end_run()
    return reader.found


def _map_pages(
    pages: DataFrame, html: str, keep: list[str], wanted: set[str], extract: Callable[[list[Element]], object], result
) -> DataFrame:
    """Run a small function over the elements of every page, on Arrow batches."""
    schema = StructType([*(pages.schema[c] for c in keep), StructField("_tw", result)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), PAGES_AT_ONCE):
                some = batch.iloc[start : start + PAGES_AT_ONCE]
                out = some[keep].copy()
                out["_tw"] = [extract(read_page(text, wanted)) for text in some[html]]
                yield out

    return spread(pages.select(*dict.fromkeys([*keep, html]))).mapInPandas(run, schema)


def page_titles(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Text of the first title element, stripped; null without one."""

    def first(found: list[Element]):
        return found[0].text().strip() if found else None

    return _map_pages(pages, html, [key], {"title"}, first, StringType()).withColumnRenamed("_tw", "title")


def page_contents(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """All h1, then h2, then h3 texts, and all paragraph texts, as two arrays."""
    levels = ["h1", "h2", "h3"]

    def both(found: list[Element]):
        heads = [e.stripped() for level in levels for e in found if e.tag == level]
        return [heads, [e.stripped() for e in found if e.tag == "p"]]

    kind = ArrayType(ArrayType(StringType()))
    return _map_pages(pages, html, [key], {*levels, "p"}, both, kind).select(
        key, F.col("_tw")[0].alias("headers"), F.col("_tw")[1].alias("paragraphs")
    )


def _cards(found: list[Element]) -> list[dict]:
    contents: dict[int, list[Element]] = {}
    for element in found:
        above = list(element.enclosing())
        if element.tag == "li" and any(a.tag == "ol" and "row" in a.classes() for a in above):
            contents[id(element)] = []
        for a in above:
            if id(a) in contents:
                contents[id(a)].append(element)
    out = []
    for inside in contents.values():

        def first(tag, test=lambda e: True):
            return next((e for e in inside if e.tag == tag and test(e)), None)

        heading = first("h3")
        link = first("a", lambda e: heading is not None and e.within(heading))
        price = first("p", lambda e: "price_color" in e.classes())
        rating = first("p")
        stock = first("p", lambda e: "instock" in e.classes() and "availability" in e.classes())
        icon = first("i", lambda e: stock is not None and e.within(stock))
        image = first("img")
        if link is None:
            continue
        out.append(
            {
                "title": link.attrs.get("title"),
                "price_text": price.text() if price else None,
                "rating": rating.classes()[1] if rating and len(rating.classes()) > 1 else None,
                "availability_class": icon.classes()[0] if icon and icon.classes() else None,
                "image_src": image.attrs.get("src") if image else None,
                "href": link.attrs.get("href"),
            }
        )
    return out


def page_cards(pages: DataFrame, key: str, url: str, html: str = "html") -> DataFrame:
    """One row per product card: title, price text, rating word, availability, links."""
    names = ["title", "price_text", "rating", "availability_class", "image_src", "href"]
    kind = ArrayType(StructType([StructField(n, StringType()) for n in names]))
    tags = {"ol", "li", "h3", "a", "p", "i", "img"}
    cards = _map_pages(pages, html, [key, url], tags, _cards, kind).select(key, url, F.inline("_tw"))
    return cards.select(
        key,
        "title",
        after_prefix(F.col("price_text"), 2).alias("price"),
        "rating",
        last_piece(F.col("availability_class")).alias("availability"),
        resolve_link(F.col(url), F.col("image_src")).alias("image"),
        resolve_link(F.col(url), F.col("href")).alias("url"),
    )


def page_categories(
    pages: DataFrame, key: str, html: str = "html", tag: str = "ul", mark: str | None = "breadcrumb"
) -> DataFrame:
    """Text of the link in the third entry of the breadcrumb list, or a default.

    The list is the first ``tag`` element with the class ``mark``; None takes any class.
    """

    def third(found: list[Element]):
        crumbs = next((e for e in found if e.tag == tag and (mark is None or mark in e.classes())), None)
        entries = [e for e in found if e.tag == "li" and crumbs is not None and e.within(crumbs)]
        if len(entries) < 3:
            return None
        return next((e.text() for e in found if e.tag == "a" and e.within(entries[2])), None)

    out = _map_pages(pages, html, [key], {tag, "li", "a"}, third, StringType())
    return out.select(key, F.coalesce(F.nullif(F.col("_tw"), F.lit("")), F.lit(NO_CATEGORY)).alias("category"))


def page_totals(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Number of pages from the pager text, 1 without a pager."""

    def pager(found: list[Element]):
        return next((e.stripped() for e in found if "current" in e.classes()), None)

    out = _map_pages(pages, html, [key], {"li"}, pager, StringType())
    return out.select(key, F.coalesce(last_word_int(F.col("_tw")), F.lit(1)).alias("total_pages"))


def _links(found: list[Element]) -> list[dict]:
    links = [e for e in found if e.tag == "a" and any(a.tag == "nav" for a in e.enclosing())]
    return [{"position": i, "href": e.attrs.get("href"), "label": e.text()} for i, e in enumerate(links)]


def page_links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """The links inside the page's navigation, one row each."""
    kind = ArrayType(StructType([StructField("position", IntegerType()), StructField("href", StringType()), StructField("label", StringType())]))
    return _map_pages(pages, html, [key], {"nav", "a"}, _links, kind).select(key, F.inline("_tw"))


@F.udtf(returnType="position int, href string, label string", useArrow=True)
class PageLinks:
    """The same as a table function, for use in SQL and lateral joins."""

    def eval(self, html: str):
        for link in _links(read_page(html, {"nav", "a"})):
            yield link["position"], link["href"], link["label"]
