"""Page extraction rules over the node array of each page.

Everything here is a per-row array expression (``filter`` / ``transform`` /
``array_sort`` over the page's own nodes): no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, utrim
from ..sources.html_nodes import TEXT_SELECTORS, html_nodes

# A paragraph counts only when its trimmed text is longer than
# this many UTF-8 bytes; paragraphs are joined by a blank line.
MIN_PARAGRAPH_BYTES = 10
PARAGRAPH_JOIN = "\n\n"


def _blank(c: Column) -> Column:
    return utrim(F.coalesce(c, F.lit(""))) == F.lit("")


def _has_class(cls: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(F.split(cls, rf"{WS}+", -1), F.lit(name)), F.lit(False))


def _first(nodes: Column, pred) -> Column:
    return F.get(F.filter(nodes, pred), 0)


def title_expr(nodes="nodes") -> Column:
    """First ``<title>`` if non-blank, else first ``h1.firstHeading``, else
    first ``h1`` (inner HTML, untrimmed); null if none qualifies."""
    n = F.col(nodes) if isinstance(nodes, str) else nodes
    t1 = _first(n, lambda x: x["kind"] == "title")["html"]
    t2 = _first(n, lambda x: (x["kind"] == "h") & (x["level"] == 1) & _has_class(x["cls"], "firstHeading"))["html"]
    t3 = _first(n, lambda x: (x["kind"] == "h") & (x["level"] == 1))["html"]
    return (
        F.when(t1.isNotNull() & ~_blank(t1), t1)
        .when(t2.isNotNull() & ~_blank(t2), t2)
        .when(t3.isNotNull() & ~_blank(t3), t3)
    )


def headings_with_level_expr(nodes="nodes") -> Column:
    """``array<struct<l, o, h>>`` (level, document order, inner HTML), sorted."""
    n = F.col(nodes) if isinstance(nodes, str) else nodes
    hs = F.filter(n, lambda x: (x["kind"] == "h") & ~_blank(x["html"]))
    keyed = F.transform(hs, lambda x: F.struct(x["level"].alias("l"), x["ord"].alias("o"), x["html"].alias("h")))
    return F.array_sort(keyed)


def headings_expr(nodes="nodes") -> Column:
    """All non-blank h1, then all h2, then all h3 (document order within a level)."""
    return F.transform(headings_with_level_expr(nodes), lambda x: x["h"])


def link_kept(x: Column) -> Column:
    href = x["href"]
    return (
        (x["kind"] == "a")
        & href.isNotNull()
        & ~_blank(href)
        & ~href.startswith("#")
        & ~(_blank(x["html"]) & ~href.startswith("http"))
    )


def links_expr(nodes="nodes") -> Column:
    """``array<struct<url, text>>`` of kept ``a[href]`` in document order."""
    n = F.col(nodes) if isinstance(nodes, str) else nodes
    return F.transform(F.filter(n, link_kept), lambda x: F.struct(x["href"].alias("url"), x["html"].alias("text")))


def _qualifies(x: Column, bit: int) -> Column:
    return (
        (x["kind"] == "p")
        & ((x["sel"].bitwiseAND(F.lit(1 << bit))) != 0)
        & (F.octet_length(utrim(x["text"])) > F.lit(MIN_PARAGRAPH_BYTES))
    )


def _qualifier(bit: int):
    return lambda x: _qualifies(x, bit)


def _tagger(bit: int):
    return lambda x: F.struct(F.lit(bit).alias("sel"), x["text"].alias("text"))


def main_paragraphs_expr(nodes="nodes") -> Column:
    """``array<struct<sel, text>>``: qualifying paragraphs of the first selector
    of the cascade that has at least one (empty if none)."""
    n = F.col(nodes) if isinstance(nodes, str) else nodes
    out = F.array().cast("array<struct<sel:int,text:string>>")
    for bit in reversed(range(len(TEXT_SELECTORS))):
        picked = F.filter(n, _qualifier(bit))
        tagged = F.transform(picked, _tagger(bit))
        out = F.when(F.size(picked) > 0, tagged).otherwise(out)
    return out


def text_content_expr(nodes="nodes") -> Column:
    """Main text: the winning paragraphs joined by a blank line."""
    return F.array_join(F.transform(main_paragraphs_expr(nodes), lambda x: x["text"]), PARAGRAPH_JOIN)


def extract_pages(pages: DataFrame, html: str = "html", keep=None) -> DataFrame:
    """``page_extract``: keep columns + ``title, headings, links, text_content``."""
    nodes = html_nodes(pages, html=html, keep=keep)
    base = [c for c in nodes.columns if c != "nodes"]
    return nodes.select(
        *base,
        title_expr().alias("title"),
        headings_expr().alias("headings"),
        links_expr().alias("links"),
        text_content_expr().alias("text_content"),
    )
