import html
import re
import time
from collections import Counter

from parasift.llm import wrapper
from parasift.llm.q_wrapper import op3_wrapper_extraction

PAGES = "page_id long, url string, html string, text string, host string"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)


def _site(n, host="a.example.org"):
    rows, want = [], {}
    for i in range(n):
        body = [f"Paragraph {i} {k} about topic {i * k}" for k in range(2 + i % 4)]
        page = (
            f"<html><head><title>T{i}</title><script>var p='<p>no</p>';</script></head><body class='has-sidebar'>"
            f"<div id='top'><a href='/'>Site</a> <span>visit {i}</span></div><div class='cookie-notice'><p>We use cookies {i}</p></div>"
            f"<div id='x1'><div id='x2'><h1>Title {i}</h1>" + "".join(f"<p>{b} &amp; <b>more</b>.</p>" for b in body)
            + f"<div>Share this</div><form><p>Mail {i}</p></form><section id='comments'><p>Reader {i} says hi</p></section></div>"
            f"<div class='sidebar'><p>Popular {i}: " + "very long teaser " * 3 + "</p></div></div>"
            f"<footer>&copy; {i}</footer></body></html>")
        rows.append((i, f"https://{host}:80/{i}", page))
        want[i] = " ".join([f"Title {i}", *[f"{b} & more." for b in body]])
    return rows, want


def test_induced_wrapper_without_article_markup(spark):
    rows, want = _site(12)
    got = {r["page_id"]: r["text"] for r in wrapper.extract(_pages(spark, rows)).collect()}
    assert got == want


def test_constant_paragraphs_stay_and_copies_teach_nothing(spark):
    article = "<html><body><nav><p>menu {0}</p></nav><article><h1>Same</h1><p>Shared licence text.</p><p>Own {0}</p></article></body></html>"
    rows = [(i, "http://b.example.org/x", article.format(i // 2)) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(_pages(spark, rows)).collect()}
    assert got == {i: f"Same Shared licence text. Own {i // 2}" for i in range(6)}


def test_edge_cases(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://one.example/", "<p>First<![x[ y ]]><p>Second &lt;b&gt; &#233;&nbsp;x<br>y"),
            (None, "nonsense", "plain text"), (4, "http://one.example/2", "<article>" + "<div>" * 3000 + "deep</article>"),
            (5, "http://c.example/", "<article><p>" + "word " * 100_000 + "</p></article>"), (5, "http://c.example/", "<article><p>cut <a href=\"x")]
    got = {}
    for r in wrapper.extract(_pages(spark, rows)).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert got[1] == [""] and got[2] == [""] and got[None] == ["plain text"] and got[4] == ["deep"]
    assert got[3] == ["First Second <b> é x y"]
    assert sorted(len(t) for t in got[5]) == [3, 499_999]
    assert wrapper.extract(_pages(spark, [])).count() == 0


def _templated(i, ids=""):
    rows = "".join(f"<li>Section {k} of the site</li>" for k in range(30))
    return (f"<html><body class='page{ids}'><div class='a{ids}'><ul>{rows}</ul><div>{'All about the house. ' * 40}</div></div>"
            f"<div class='b{ids}' id='e{i}'><div>Save page</div><p>First of {i}.</p><p>Second of {i}, a little longer.</p></div></body></html>")


def test_a_host_whose_nodes_are_mostly_template(spark):
    rows = [(i, "http://t.example.org/x", _templated(i)) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(_pages(spark, rows)).collect()}
    assert got == {i: f"First of {i}. Second of {i}, a little longer." for i in range(6)}


def test_ids_and_classes_of_a_single_page_do_not_end_the_match(spark):
    rows = [(i, "http://u.example.org/x", _templated(i, f" postid-{i}")) for i in range(6)]
    rows += [(10 + i, "http://v.example.org/x", _templated(i).replace("'page'", f"'p{i}'").replace("'b'", f"'post-{i}'")) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(_pages(spark, rows)).collect()}
    assert got == {j + i: f"First of {i}. Second of {i}, a little longer." for i in range(6) for j in (0, 10)}


def test_every_frequent_layout_of_a_host_has_a_wrapper(spark):
    other = ("<html><body><table class='frame'><tr><td class='left'><div>{1}</div></td><td class='right'><section class='story'><div>Save page</div>"
             "<p>Story {0} of the second kind, which is rather long.</p><p>Its end {0}.</p></section></td></tr></table></body></html>")
    rows = [(i, "http://w.example.org/x", _templated(i)) for i in range(60)]
    rows += [(100 + i, "http://w.example.org/y", other.format(i, "All about the house. " * 40)) for i in range(5)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(_pages(spark, rows)).collect()}
    want = {i: f"First of {i}. Second of {i}, a little longer." for i in range(60)}
    assert got == want | {100 + i: f"Story {i} of the second kind, which is rather long. Its end {i}." for i in range(5)}


def test_text_after_very_deep_elements_stays():
    for inside in ("text", "<ul><li>text<li></ul>", "text</i></span>"):
        page = "<body><div id=w><article>" + "<div>" * 200 + inside + "</div>" * 200 + "<p>rest</p></article><p>after</p></div></body>"
        assert wrapper.Wrapper(None).extract(page) == "text rest"


def test_simple_tree_matching_keeps_order():
    a = wrapper.condense(wrapper.parse("<ul><li>1</li><li>2</li></ul><p>x</p><div><p>y</p></div>"))
    b = wrapper.condense(wrapper.parse("<p>x</p><ul><li>1</li></ul><div><p>z</p><p>y</p></div>"))
    pairs = [(x.tag, y.tag) for x, y in wrapper.match(a, b)]
    assert pairs[0] == ("#root", "#root") and all(x == y for x, y in pairs)
    assert len(pairs) == 5  # root, ul, one li, div, one p; the p before it would cross


def test_no_text_goes_for_its_markup_names():
    got = wrapper.Wrapper(None).extract
    text = "<p>A first paragraph.</p><p>A second one.</p>"
    want = "A first paragraph. A second one."
    assert got(f"<body><form id='aspnetForm'><div>{text}</div></form></body>") == want
    assert got(f"<body><form id='f'><nav><p>menu</p></nav><div>{text}</div></form><div>c</div></body>") == want
    assert got("<article><p>See <a class='related'>other essay</a> and <span class='tags'>foo</span>, <span class='ad-hoc'>bar</span>.</p></article>") == (
        "See other essay and foo, bar.")
    for name in ("related-work", "notice-of-award", "comment-policy", "has-sidebar", "searchable"):
        assert got(f"<article><h1>T</h1><section class='{name}'><p>Kept text.</p></section></article>") == "T Kept text."
    for name in ("related-posts", "cookie-notice", "commentlist", "adBox", "site-sidebar sidebar-left", "social-share-buttons"):
        assert got(f"<article><h1>T</h1><p>Kept.</p><div class='{name}'><p>Other text.</p></div></article>") == "T Kept."
    assert got("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p></article>") == "Let x=2 hold."
    assert got("<nav><p>menu</p></nav><div class='ad'>Buy</div><article></article><form><p>Mail</p></form><footer>c</footer>") == ""
    assert got("<article><font><nav><p>menu</p></nav><p>Inside.</p></font></article>") == "Inside."


def test_many_siblings_are_aligned_in_linear_time():
    def page(n, extra=""):
        return ("<body><div>" + "".join(f"<p>par {i}</p>" for i in range(n)) + "</div><table>" + "".join(
            f"<tr><td>{i}<td>{'<div>x</div>' if extra and i % 7 == 0 else i}" for i in range(n)) + "</table><dl>" + "".join(
            f"<dt>k{i}<dd>v{i}{extra if i % 5 == 0 else ''}" for i in range(n)) + "</dl></body>")

    a, b = (wrapper.condense(wrapper.parse(p)) for p in (page(5000), page(4000, "<div>y</div>")))
    start = time.perf_counter()
    pairs = wrapper.match(a, b)
    assert time.perf_counter() - start < 20
    kinds = Counter(x.tag for x, y in pairs)
    assert kinds["tr"] > 3000 and kinds["dl"] == 1 and kinds["p"] == 1
    assert [y.nodes[0].children[0].text for x, y in pairs if x.tag == "p"] == ["par 0"]


def _stripped(page):
    """A page without article tags and without class names."""
    return re.sub(r"</?article>|\sclass=(?:\"[^\"]*\"|'[^']*')", "", page or "")


def test_template_decides_on_stripped_pages(spark, sf_dir, duck):
    want = duck.sql("SELECT page_id, url, html FROM pages").fetchall()
    hosts = Counter(re.sub(r"^[a-z]+://([^/:?#]*).*", r"\1", u or "") for _, u, _ in want)
    whole = {r["page_id"]: r["text"] for r in op3_wrapper_extraction(spark, sf_dir).collect()}
    pages = spark.createDataFrame([(i, u, _stripped(h), "", "") for i, u, h in want], PAGES)
    got = {r["page_id"]: r["text"] for r in wrapper.extract(pages).collect()}
    often = [i for i, u, _ in want if hosts[re.sub(r"^[a-z]+://([^/:?#]*).*", r"\1", u or "")] >= 3]
    assert sum(got[i] == whole[i] for i in often) >= 0.95 * len(often)


def test_query_returns_the_articles(spark, sf_dir, duck):
    def article(page):
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.S)[1]
        blocks = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1)\b[^>]*>", "\x01", inner.replace("<br>", " "))).split("\x01")
        return " ".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b)

    want = {i: article(h) for i, h in duck.sql("SELECT page_id, html FROM pages").fetchall()}
    rows = op3_wrapper_extraction(spark, sf_dir).collect()
    assert {r["page_id"]: r["text"] for r in rows} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_the_text_of_an_element_is_kept_from_the_parse():
    root = wrapper.parse("<div> a <b>b<i>c</i></b><br>d<p>e &amp;amp; f</p> g</div>")
    assert [n.text for n in wrapper._elements(root)] == ["a bc d g", "e &amp; f"]
    assert [n.size for n in wrapper._elements(root)] == [8, 9]
