from __future__ import annotations

from urllib.parse import urldefrag, urljoin

from pyspark.sql import functions as F

from stallwise.functions.html import read_page
from stallwise.operators import pages as G

HTML = """<html><head><title> A &amp; B </title><style>p{}</style><script>var t = "</p><p>not text at all, really</p>";</script></head><body>
<nav><h1>menu</h1><li>navigation entry</li></nav><h1>Top</h1><h2>Sub <b>two</b></h2>
<p>A paragraph of more than twenty characters.<p>Second paragraph, left open by the author<ul><li>one entry<li>tiny<li>two entry</ul>
<p>short</p><footer><p>A footer paragraph of more than twenty characters.</p></footer></body></html>"""


def pages(spark, *html, url="https://x.example.com/a/b?q=1#f"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(html)], "page_id bigint, url string, html string")


def test_reader_skips_noise_and_closes_open_elements():
    r = read_page(HTML)
    assert r["title"] == ["A & B"] and r["h1"] == ["Top"] and r["h2"] == ["Sub two"]
    assert r["p"] == ["A paragraph of more than twenty characters.", "Second paragraph, left open by the author", "short"]
    assert r["li"] == ["one entry", "tiny", "two entry"]


def test_nested_lists():
    r = read_page("<ul><li>outer text<ul><li>inner one<li>inner two</ul></li><li>last</ul><p>after</p>")
    assert r["li"] == ["inner one", "inner two", "outer textinner oneinner two", "last"] and r["p"] == ["after"]


def test_extract(spark):
    row = G.extract(pages(spark, HTML, None)).orderBy("page_id").collect()
    assert row[0]["title"] == "A & B" and len(row[0]["paragraphs"]) == 2 and row[0]["list_items"] == ["one entry", "two entry"]
    assert row[1]["title"] == "" and row[1]["paragraphs"] == []


def test_links_resolve_like_urljoin(spark):
    hrefs = ["/r", "c", "../up/./d?x=1", "?only=query", "//x.example.com/net", "https://x.example.com/abs#part", "https://other.example.com/", "mailto:a@b", "#top", "javascript:x()", "./e/../f"]
    html = "".join(f'<a class="l" href="{h}">t{i} <b>bold</b></a>' for i, h in enumerate(hrefs)) + '<a href="/r#again">later text</a>'
    base = "https://x.example.com/a/b?q=1#f"
    want = {urldefrag(urljoin(base, h))[0] for h in hrefs if not h.startswith(("mailto:", "#", "javascript:"))}
    got = {r["link"]: r["text"] for r in G.links(pages(spark, html)).collect()}
    assert set(got) == {w for w in want if w.startswith("https://x.example.com")}
    assert got["https://x.example.com/r"] == "t0 bold"


def test_card_fields(spark):
    card = ('<div class="loempia_app_entry loempia_app_card"><a href="/apps/modules/17.0/my_tool/"></a><p class="loempia_panel_summary"> Does <i>things</i></p>'
            '<div class="loempia_app_entry_bottom"><h5>Plain name</h5></div><div class="loempia_panel_author"><b>Me</b></div>{price}'
            '<div class="loempia_rating_stars" title="1,234 votes"><i class="rating_star_active"></i><i class="rating_star_active"></i></div>'
            '<div class="loempia_tags"><span title="Total Purchases: 2,252, Last month: 42">x</span></div></div>')
    paid = '<div class="loempia_panel_price">€ <span class="oe_currency_value">1,234.565</span></div>'
    free = '<div class="loempia_panel_price">FREE</div>'
    bad = '<div class="loempia_app_entry loempia_app_card"><a href="/elsewhere/">x</a></div>'
    got = G.cards(pages(spark, "<div>" + card.format(price=paid) + bad + card.format(price=free) + card.format(price="") + "</div>")).orderBy("pos").collect()
    assert len(got) == 3
    r = got[0]
    assert (r["version"], r["tech_name"], r["display_name"], r["author"], r["currency"], r["rating_stars"]) == ("17.0", "my_tool", "Plain name", "Me", "€", 2.0)
    assert (r["review_count"], r["total_purchases"], r["last_month_purchases"]) == (1234, 2252, 42)
    assert r["price_cents"] == round(1234.565 * 100) and got[1]["price_cents"] == 0 and got[2]["price_cents"] is None and r["image_url"] is None


def test_references_skip_the_industry_line(spark):
    text = "<div>Alpha Works</div><div>Trade / Retail</div><div>Gamma / Delta</div><div>short</div><div>beta works</div><div>A / B</div>" \
           "<div>Contact us</div><div>A / B</div><div>ALPHA works</div><div>X / Y</div><div>A longer description of this client</div>"
    got = [tuple(r) for r in G.references(pages(spark, text)).select("client_name", "client_industry", "description").orderBy("pos").collect()]
    # "Trade / Retail" is an industry, so it is no company; lower-case and navigation lines are none; the repeated name is dropped.
    assert got == [("Alpha Works", "Trade / Retail", "")]


def test_contacts(spark):
    html = ('<div class="o_portal_header">Mail: me.you@x-y.example.com<br>+32 (0)2 290 34 90 <a href="http://x.example.com">w</a></div><p>Based in: Ghent</p>'
            "<p>20 - 50 Employees</p><b>Gold Partner</b>")
    r = G.contacts(pages(spark, html, "<p>nothing</p>")).orderBy("page_id").collect()
    assert (r[0]["email"], r[0]["phone"], r[0]["website"]) == ("me.you@x-y.example.com", "+32 (0)2 290 34 90", "http://x.example.com")
    assert (r[0]["employees"], r[0]["location"], r[0]["certification"]) == ("20-50", "Ghent", "Gold Partner")
    assert all(r[1][c] is None for c in ("email", "phone", "website", "employees", "location", "certification"))


def test_industries_from_pills_and_labelled_section(spark):
    html = '<span class="badge x">Retail</span><span class="badge">v17</span><div><h4>Industries</h4><ul><li>Food</li><li>Retail</li></ul></div><p>1,200 employees</p><li>Other</li>'
    r = G.industries(pages(spark, html)).first()
    assert r["industries"] == ["Retail", "Food"] and r["employees"] == "1200"


def test_frontier_levels_and_cap(spark):
    edges = spark.createDataFrame([("s", "a"), ("s", "b"), ("a", "c"), ("b", "c"), ("c", "s"), ("c", "d"), ("d", "e")], "src string, dst string")
    start = spark.createDataFrame([("s",)], "src string")
    assert {r["page"]: r["level"] for r in G.crawl_frontier(edges, start, 2).collect()} == {"s": 0, "a": 1, "b": 1, "c": 2}
    assert [r["page"] for r in G.crawl_frontier(edges, start, 9, 3).orderBy("level", "page").collect()] == ["s", "a", "b"]


def test_max_page(spark):
    block = '<ul class="pagination"><li><a class="page-link" href="/x/page/7">n</a></li><li><a class="page-link" href="#"> 12 </a></li></ul>'
    assert [r["max_page"] for r in G.max_page(pages(spark, block, "<p>/page/9</p>")).orderBy("page_id").collect()] == [12, None]


def test_a_reference_goes_on_without_the_lines_of_its_page(spark):
    html = "<b> Top </b>" + "".join(f"<h5>  Client {i} </h5><p>Trade / X</p><p>  A description of client {i}&nbsp;</p>" for i in range(30)) + "<h5>Menu Corp</h5><p>Trade / X</p><h5>CLIENT 3</h5><p>A / B</p>"
    refs = G.references(spark.createDataFrame([(1, html), (2, ""), (3, None)], "page_id int, html string"))
    got = sorted((r["pos"], r["client_name"], r["client_industry"], r["description"]) for r in refs.collect())
    assert got == [(1 + 3 * i, f"Client {i}", "Trade / X", f"A description of client {i}") for i in range(30)]
    assert "l#" not in refs._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
