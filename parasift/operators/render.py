"""Plain-text and Markdown renderings of a page extract.

Pure column expressions over ``title, headings, links, text_content``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import clean_text, wrap_text

# Labels and limits of the renderers.
NO_TITLE = "(No title found)"
RULE = "=" * 50
MAX_LINKS_SHOWN = 20
WRAP_WIDTH = 80


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def format_link(url, text) -> Column:
    """``text -> url``, or the url alone when the text is blank or equals it."""
    cu, ct = clean_text(_c(url)), clean_text(_c(text))
    return F.when((ct == F.lit("")) | (ct == cu), cu).otherwise(F.concat(ct, F.lit(" -> "), cu))


def format_link_markdown(url, text) -> Column:
    cu, ct = clean_text(_c(url)), clean_text(_c(text))
    label = F.when((ct == F.lit("")) | (ct == cu), cu).otherwise(ct)
    return F.concat(F.lit("["), label, F.lit("]("), cu, F.lit(")"))


def _lines(arr: Column, fmt) -> Column:
    """Concatenate ``fmt(x, i)`` for every element (each already ends with a newline)."""
    return F.array_join(F.transform(arr, fmt), "")


def render_text(title="title", headings="headings", links="links", text_content="text_content") -> Column:
    t, h, lk, tc = _c(title), _c(headings), _c(links), _c(text_content)
    n = F.size(lk)
    head = F.concat(F.lit("TITLE: "), F.coalesce(t, F.lit(NO_TITLE)), F.lit("\n" + RULE + "\n"))
    heads = F.when(
        F.size(h) > 0,
        F.concat(
            F.lit("HEADINGS:\n"),
            _lines(h, lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), clean_text(x), F.lit("\n"))),
            F.lit("\n"),
        ),
    ).otherwise(F.lit(""))
    content = F.when(
        tc != F.lit(""),
        F.concat(F.lit("CONTENT:\n"), wrap_text(clean_text(tc), WRAP_WIDTH), F.lit("\n\n")),
    ).otherwise(F.lit(""))
    shown = F.slice(lk, 1, MAX_LINKS_SHOWN)
    link_block = F.when(
        n > 0,
        F.concat(
            F.lit("LINKS ("), n.cast("string"), F.lit(" found):\n"),
            _lines(shown, lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "),
                                               format_link(x["url"], x["text"]), F.lit("\n"))),
            F.when(n > MAX_LINKS_SHOWN, F.concat(F.lit("  ... and "), (n - MAX_LINKS_SHOWN).cast("string"),
                                                 F.lit(" more links\n"))).otherwise(F.lit("")),
        ),
    ).otherwise(F.lit("LINKS: (No links found)\n"))
    return F.concat(head, heads, content, link_block)


def render_markdown(title="title", headings="headings", links="links", text_content="text_content") -> Column:
    t, h, lk, tc = _c(title), _c(headings), _c(links), _c(text_content)
    n = F.size(lk)
    head = F.concat(F.lit("# "), F.coalesce(t, F.lit(NO_TITLE)), F.lit("\n\n"))
    heads = F.when(
        F.size(h) > 0,
        F.concat(F.lit("## Headings\n"), _lines(h, lambda x: F.concat(F.lit("- "), clean_text(x), F.lit("\n"))), F.lit("\n")),
    ).otherwise(F.lit(""))
    content = F.when(
        tc != F.lit(""), F.concat(F.lit("## Content\n"), clean_text(tc), F.lit("\n\n"))
    ).otherwise(F.lit(""))
    shown = F.slice(lk, 1, MAX_LINKS_SHOWN)
    link_block = F.when(
        n > 0,
        F.concat(
            F.lit("## Links ("), n.cast("string"), F.lit(")\n"),
            _lines(shown, lambda x: F.concat(F.lit("- "), format_link_markdown(x["url"], x["text"]), F.lit("\n"))),
            F.when(n > MAX_LINKS_SHOWN, F.concat(F.lit("- ... and "), (n - MAX_LINKS_SHOWN).cast("string"),
                                                 F.lit(" more links\n"))).otherwise(F.lit("")),
        ),
    ).otherwise(F.lit(""))
    return F.concat(head, heads, content, link_block)
