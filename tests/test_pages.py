from pyspark.sql import functions as F

from parasift.operators.extract import extract_pages
from parasift.operators.segments import build_documents, title_fallback


def _extract(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r for r in extract_pages(df, keep=["page_id", "url"]).collect()}


def test_selector_cascade_each_wins(spark):
    long = "This paragraph is long enough."
    pages = [
        ("u", f"<div class='content'><p>{long} A</p></div><p>{long} outside</p>"),
        ("u", f"<main><p>{long} M</p></main><p>{long} outside</p>"),
        ("u", f"<p>{long} bare</p>"),
        ("u", f"<div id='mw-content-text'><p>{long} W</p></div><article><p>{long} art</p></article>"),
        ("u", f"<article><p>{long} art</p></article><main><p>{long} M</p></main>"),
    ]
    r = _extract(spark, pages)
    assert r[0].text_content == f"{long} A"
    assert r[1].text_content == f"{long} M"
    assert r[2].text_content == f"{long} bare"
    assert r[3].text_content == f"{long} W"
    assert r[4].text_content == f"{long} art"


def test_paragraph_byte_threshold(spark):
    pages = [("u", "<p>0123456789</p><p>01234567890</p><p>éééééé</p>")]
    r = _extract(spark, pages)[0]
    assert r.text_content == "01234567890\n\néééééé"


def test_title_cascade_and_url_fallback(spark):
    pages = [
        ("https://h/a/b", "<html><head></head><body><p>x</p></body></html>"),
        ("https://h/a/", "<title>  </title><h1>Only h1</h1>"),
        ("u", "<title>T &amp; U</title><h1>H</h1>"),
        ("u", "<title> </title><h1>first</h1><h1 class='firstHeading'>wiki</h1>"),
    ]
    r = _extract(spark, pages)
    assert r[0].title is None and r[1].title == "Only h1"
    assert r[2].title == "T &amp; U"
    assert r[3].title == "wiki"
    df = spark.createDataFrame([("https://h/a/b", None), ("https://h/a/", None)], "url string, title string")
    got = [x[0] for x in df.select(title_fallback("title", "url")).collect()]
    assert got == ["b", ""]


def test_links_filters_and_headings_order(spark):
    html = ("<h2>two</h2><h1>one</h1><h3> </h3><h3>three</h3>"
            "<a href='#x'>anchor</a><a href=' '>blank</a><a href='/rel'> </a><a href='http://h'></a><a href='/k'>keep</a>")
    r = _extract(spark, [("u", html)])[0]
    assert r.headings == ["one", "two", "three"]
    assert [(l.url, l.text) for l in r.links] == [("http://h", ""), ("/k", "keep")]


def test_unclosed_paragraph_and_script_string(spark):
    html = ('<script>var t="</p>";</script><article><h1>T</h1><p><b>First paragraph text here.<br>'
            '<p>Second paragraph, closed.</p></article><footer>&copy; x</footer>')
    r = _extract(spark, [("u", html)])[0]
    assert r.text_content == "First paragraph text here.\n\nSecond paragraph, closed."


def test_page_without_paragraphs_gives_empty_document(spark):
    df = spark.createDataFrame([(0, "https://h/x", "<title>t</title>")], "page_id long, url string, html string")
    ex = extract_pages(df, keep=["page_id", "url"])
    docs = build_documents(ex, url="url", title="title", text="text_content", keys=["page_id"]).first()
    assert docs.segments == [] and docs.title == "t" and docs.lang == "en" and docs.hints == {}


def test_simple_page_like_fixture(spark):
    html = ("<!DOCTYPE html><html><head><title>Harbour notes</title></head><body>"
            "<h1>Tides today</h1><p>First paragraph of the test.</p><p>Second paragraph of the test.</p>"
            "<p>Third paragraph of the test.</p><p>Fourth paragraph of the test.</p></body></html>")
    df = spark.createDataFrame([(0, "https://e.org/t", html)], "page_id long, url string, html string")
    ex = extract_pages(df, keep=["page_id", "url"])
    docs = build_documents(ex, url="url", title="title", text="text_content", keys=["page_id"]).first()
    r = ex.first()
    assert r.title == "Harbour notes" and r.headings == ["Tides today"] and r.links == []
    assert [s.position for s in docs.segments] == [0, 1, 2, 3]
    assert [s.path for s in docs.segments] == ["p[0]", "p[1]", "p[2]", "p[3]"]


def test_tree_rules(spark):
    html = ('<nav><a href="/x?a=1&amp;b=2">A &amp; B</a><a href="/y"><b>bold</b> link</a></nav>'
            "<h2>Two <i>ital</i></h2><p>one <b>two</b> three, long enough</p>")
    r = _extract(spark, [("u", html)])[0]
    assert [(l.url, l.text) for l in r.links] == [("/x?a=1&b=2", "A &amp; B"), ("/y", "<b>bold</b> link")]
    assert r.headings == ["Two <i>ital</i>"]
    # text nodes "one ", "two", " three, ..." joined by one space (as the rule says)
    assert r.text_content == "one  two  three, long enough"


def test_renderers_cap_links_at_twenty(spark):
    from parasift.operators.render import render_markdown, render_text

    links = "".join(f'<a href="/l{i}">L{i}</a>' for i in range(25))
    html = f"<title>T</title><h1>H</h1>{links}<p>{'word ' * 30}</p>"
    df = spark.createDataFrame([(0, "u", html)], "page_id long, url string, html string")
    ex = extract_pages(df, keep=["page_id"])
    r = ex.select(render_text().alias("t"), render_markdown().alias("m")).first()
    t_lines = r.t.split("\n")
    assert t_lines[0] == "TITLE: T" and t_lines[1] == "=" * 50
    assert "LINKS (25 found):" in t_lines and "  20. L19 -> /l19" in t_lines and "  ... and 5 more links" in t_lines
    assert "  21. L20 -> /l20" not in t_lines
    content = t_lines[t_lines.index("CONTENT:") + 1: t_lines.index("CONTENT:") + 3]
    assert all(len(x.encode()) <= 80 for x in content) and content[0].startswith("word word")
    m_lines = r.m.split("\n")
    assert "## Links (25)" in m_lines and "- [L19](/l19)" in m_lines and "- ... and 5 more links" in m_lines
    assert r.m.startswith("# T\n\n## Headings\n- H\n\n## Content\n")


def test_pages_are_parsed_in_bounded_pieces(spark):
    import pyarrow as pa

    from parasift.sources.html_nodes import PIECE_CHARS, _pieces, parse_nodes

    pages = ["<p>a paragraph of words</p>" * 400, None, "", "<title>t</title>" + "<p>x</p>" * PIECE_CHARS] + ["<a href='u'>b</a>" * 100] * 500
    pieces = list(_pieces(pa.array(pages, pa.string())))
    ends = [s + len(n) for s, n in pieces]
    assert [s for s, _ in pieces] == [0, *ends[:-1]] and ends[-1] == len(pages) and len(pieces) > 3
    assert all(sum(len(h or "") for h in pages[s:e - 1]) < PIECE_CHARS for (s, _), e in zip(pieces, ends))
    assert [n for _, nodes in pieces for n in nodes] == [parse_nodes(h) for h in pages]
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages) if i != 3], "page_id long, url string, html string").coalesce(1)
    rows = {r.page_id: len(r.links) for r in extract_pages(df, keep=["page_id"]).select("page_id", "links").collect()}
    assert rows == {i: 100 if i > 3 else 0 for i in range(len(pages)) if i != 3}
