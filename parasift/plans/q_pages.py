"""Registered queries on the ``pages`` table: extraction (title, headings,
links, main paragraphs), page segments, text cleaning and link rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..operators.extract import (
    headings_with_level_expr,
    links_expr,
    main_paragraphs_expr,
    text_content_expr,
    title_expr,
)
from ..operators.render import format_link, format_link_markdown
from ..operators.segments import explode_segments, title_fallback
from ..sources.html_nodes import html_nodes
from ..sources.tables import read_table
from . import oracle_sql as S
from .registry import register


def page_nodes(spark, d):
    return html_nodes(read_table(spark, d, "pages"), keep=["page_id", "url"])


PAGES = S.pages_ctes()


@register(
    "page_title",
    f"""
WITH {PAGES}, {S.title_sql()}
SELECT page_id, title,
       coalesce(title, string_split(url, '/')[-1]) AS doc_title
FROM tt
""",
)
def q_page_title(spark, d):
    n = page_nodes(spark, d)
    return n.select("page_id", title_expr().alias("title"), "url").select(
        "page_id", "title", title_fallback("title", "url").alias("doc_title")
    )


@register(
    "page_headings",
    f"""
WITH {PAGES}, {S.headings_sql()}
SELECT page_id, heading_pos, level, heading FROM hd
""",
)
def q_page_headings(spark, d):
    n = page_nodes(spark, d)
    h = n.select("page_id", F.posexplode(headings_with_level_expr()).alias("heading_pos", "h"))
    return h.select(
        "page_id", F.col("heading_pos").cast("long").alias("heading_pos"),
        F.col("h.l").alias("level"), F.col("h.h").alias("heading"),
    )


@register(
    "page_links",
    f"""
WITH {PAGES}, {S.links_sql()}
SELECT page_id, link_pos, url, text FROM lk
""",
)
def q_page_links(spark, d):
    n = page_nodes(spark, d)
    lk = n.select("page_id", F.posexplode(links_expr()).alias("link_pos", "l"))
    return lk.select("page_id", F.col("link_pos").cast("long").alias("link_pos"), "l.url", "l.text")


@register(
    "page_paragraphs",
    f"""
WITH {PAGES}, {S.paragraphs_sql()}
SELECT page_id, para_pos, sel, text FROM mp
""",
)
def q_page_paragraphs(spark, d):
    n = page_nodes(spark, d)
    p = n.select("page_id", F.posexplode(main_paragraphs_expr()).alias("para_pos", "p"))
    return p.select("page_id", F.col("para_pos").cast("long").alias("para_pos"), "p.sel", "p.text")


@register(
    "page_segments",
    f"""
WITH {PAGES}, {S.paragraphs_sql()}, {S.segments_cte('seg', 'tcx', 'page_id', 'text_content')}
SELECT page_id, position, path, segment_id, text FROM seg
""",
)
def q_page_segments(spark, d):
    n = page_nodes(spark, d)
    ex = n.select("page_id", text_content_expr().alias("text_content"))
    return explode_segments(ex, "page_id", "text_content").select("page_id", "position", "path", "segment_id", "text")


@register(
    "page_clean_text",
    f"""
WITH {PAGES}, {S.paragraphs_sql()}, {S.title_sql()}
SELECT tcx.page_id, {S.clean_text('tt.title')} AS clean_title, {S.clean_text('tcx.text_content')} AS clean_content
FROM tcx JOIN tt USING (page_id)
""",
)
def q_page_clean_text(spark, d):
    n = page_nodes(spark, d)
    return n.select(
        "page_id",
        clean_text(title_expr()).alias("clean_title"),
        clean_text(text_content_expr()).alias("clean_content"),
    )


@register(
    "link_render",
    f"""
WITH {PAGES}, {S.links_sql()}
SELECT page_id, link_pos, {S.format_link('url', 'text', False)} AS text_line,
       {S.format_link('url', 'text', True)} AS markdown_line
FROM lk
""",
)
def q_link_render(spark, d):
    n = page_nodes(spark, d)
    lk = n.select("page_id", F.posexplode(links_expr()).alias("link_pos", "l"))
    return lk.select(
        "page_id", F.col("link_pos").cast("long").alias("link_pos"),
        format_link("l.url", "l.text").alias("text_line"),
        format_link_markdown("l.url", "l.text").alias("markdown_line"),
    )


def _md_sql() -> str:
    nl = "chr(10)"
    return f"""
WITH {PAGES}, {S.title_sql()}, {S.headings_sql()}, {S.links_sql()}, {S.paragraphs_sql()},
hs AS (SELECT page_id, count(*) AS nh, string_agg('- ' || {S.clean_text('heading')} || {nl}, '' ORDER BY heading_pos) AS hl
       FROM hd GROUP BY page_id),
ls AS (SELECT page_id, count(*) AS nl,
              string_agg(CASE WHEN link_pos < 20 THEN '- ' || {S.format_link('url', 'text', True)} || {nl} ELSE '' END, ''
                         ORDER BY link_pos) AS ll
       FROM lk GROUP BY page_id)
SELECT tt.page_id,
  '# ' || coalesce(tt.title, '(No title found)') || {nl} || {nl}
  || CASE WHEN coalesce(hs.nh, 0) > 0 THEN '## Headings' || {nl} || hs.hl || {nl} ELSE '' END
  || CASE WHEN tcx.text_content <> '' THEN '## Content' || {nl} || {S.clean_text('tcx.text_content')} || {nl} || {nl} ELSE '' END
  || CASE WHEN coalesce(ls.nl, 0) > 0 THEN '## Links (' || CAST(ls.nl AS VARCHAR) || ')' || {nl} || ls.ll
          || CASE WHEN ls.nl > 20 THEN '- ... and ' || CAST(ls.nl - 20 AS VARCHAR) || ' more links' || {nl} ELSE '' END
     ELSE '' END AS markdown
FROM tt JOIN tcx USING (page_id) LEFT JOIN hs USING (page_id) LEFT JOIN ls USING (page_id)
"""


@register("page_render_markdown", _md_sql())
def q_page_render_markdown(spark, d):
    from ..operators.extract import extract_pages
    from ..operators.render import render_markdown

    ex = extract_pages(read_table(spark, d, "pages"), keep=["page_id"])
    return ex.select("page_id", render_markdown().alias("markdown"))


def _wrap_sql(clean: str, width: int = 80) -> str:
    """Greedy byte-width word wrap as a fold over the words (struct accumulator)."""
    words = f"list_filter(string_split({clean}, ' '), lambda w: w <> '')"
    step = (f"lambda acc, w: CASE WHEN acc.c <> '' AND strlen(acc.c) + strlen(w) + 1 > {width} "
            f"THEN {{'o': acc.o || acc.c || chr(10), 'c': w}} "
            f"ELSE {{'o': acc.o, 'c': CASE WHEN acc.c = '' THEN w ELSE acc.c || ' ' || w END}} END")
    return f"list_reduce({words}, {step}, {{'o': '', 'c': ''}})"


def _text_sql() -> str:
    nl = "chr(10)"
    return f"""
WITH {PAGES}, {S.title_sql()}, {S.headings_sql()}, {S.links_sql()}, {S.paragraphs_sql()},
hs AS (SELECT page_id, count(*) AS nh,
              string_agg('  ' || CAST(heading_pos + 1 AS VARCHAR) || '. ' || {S.clean_text('heading')} || {nl}, ''
                         ORDER BY heading_pos) AS hl
       FROM hd GROUP BY page_id),
ls AS (SELECT page_id, count(*) AS nl,
              string_agg(CASE WHEN link_pos < 20 THEN '  ' || CAST(link_pos + 1 AS VARCHAR) || '. '
                              || {S.format_link('url', 'text', False)} || {nl} ELSE '' END, '' ORDER BY link_pos) AS ll
       FROM lk GROUP BY page_id),
wr AS (SELECT page_id, {_wrap_sql(S.clean_text('text_content'))} AS w FROM tcx)
SELECT tt.page_id,
  'TITLE: ' || coalesce(tt.title, '(No title found)') || {nl} || repeat('=', 50) || {nl}
  || CASE WHEN coalesce(hs.nh, 0) > 0 THEN 'HEADINGS:' || {nl} || hs.hl || {nl} ELSE '' END
  || CASE WHEN tcx.text_content <> '' THEN 'CONTENT:' || {nl} || wr.w.o || wr.w.c || {nl} || {nl} ELSE '' END
  || CASE WHEN coalesce(ls.nl, 0) > 0 THEN 'LINKS (' || CAST(ls.nl AS VARCHAR) || ' found):' || {nl} || ls.ll
          || CASE WHEN ls.nl > 20 THEN '  ... and ' || CAST(ls.nl - 20 AS VARCHAR) || ' more links' || {nl} ELSE '' END
     ELSE 'LINKS: (No links found)' || {nl} END AS text
FROM tt JOIN tcx USING (page_id) JOIN wr USING (page_id) LEFT JOIN hs USING (page_id) LEFT JOIN ls USING (page_id)
"""


@register("page_render_text", _text_sql())
def q_page_render_text(spark, d):
    from ..operators.extract import extract_pages
    from ..operators.render import render_text

    ex = extract_pages(read_table(spark, d, "pages"), keep=["page_id"])
    return ex.select("page_id", render_text().alias("text"))


# --------------------------------------------------------------- whole pipelines
@register("page_parse_errors", "SELECT page_id, CAST(0 AS BIGINT) AS n_errors FROM pages")
def q_page_parse_errors(spark, d):
    """Pages that could not be read to their end: none, whatever their markup."""
    return page_nodes(spark, d).select(
        "page_id", F.size(F.filter("nodes", lambda n: n["kind"] == "error")).cast("long").alias("n_errors"))
