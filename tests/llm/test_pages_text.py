"""Main text of pages: hand-made pages, differencing against brute force, edges."""

from __future__ import annotations

from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stallwise.llm import html_text, queries
from stallwise.llm.common import table


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_common_is_a_longest_common_subsequence(a, b):
    @cache
    def longest(i, j):
        if i == len(a) or j == len(b):
            return 0
        return max(longest(i + 1, j), longest(i, j + 1), 1 + longest(i + 1, j + 1) if a[i] == b[j] else 0)

    found = [a[i] for i in sorted(html_text.common(a, b))]
    rest = iter(b)
    assert len(found) == longest(0, 0) and all(x in rest for x in found)


@pytest.mark.parametrize("page, want", [
    ("", []), ("plain  text\n here", ["plain text here"]), ("<p>a &amp; b&nbsp;c<p>d", ["a & b c", "d"]),
    ("<nav>menu</nav><p>x <b>y</b>z</p><script>if (a < b) '</p>'</script><footer>f</footer>", ["x yz"]),
    ("<ul><li>one<li>two</ul>", ["one", "two"]), ("<div class='side-bar sidebar'><p>no</p></div><p>yes", ["yes"]),
    ("<!-- <p>no</p> --><p>1<br>2</p>", ["1 2"]), ("<div hidden>no</div><p>&lt;p&gt;</p>", ["<p>"]), ("<p>open", ["open"]), ("</p></div>x", ["x"])])
def test_lines(page, want):
    assert [x for x, m in zip(*html_text.lines(page), strict=True) if m != html_text.FRAME_LINE] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30))
def test_halving_loses_no_common_line(a, b):
    whole = len(html_text.common(a, b))
    limit, html_text.MATRIX = html_text.MATRIX, 8
    try:
        found = [a[i] for i in sorted(html_text.common(a, b))]
    finally:
        html_text.MATRIX = limit
    rest = iter(b)
    assert len(found) == whole and all(x in rest for x in found)


def test_odd_pages_end_in_seconds():
    assert len(html_text.common([1] * 20_000 + [2], [3] + [1] * 20_000)) == 20_000
    many, more = [k * k % 97 for k in range(20_000)], [k * k % 89 for k in range(20_000)]
    assert html_text.common(many, more)
    assert html_text.lines("<div>" * 100_000 + "x" + "</b>" * 100_000)[0] == ["x"]


def test_a_quote_counts_behind_an_equals_sign():
    assert html_text.lines("<p title=5\">Hello there</p><p class=\"x\">World</p>")[0] == ["Hello there", "World"]
    assert html_text.lines("<p title = 'a > b'>x</p><p \">y")[0] == ["x", "y"]


def site(host, k):
    """A page without any hint: one of three menus and notices, then its own lines; and the latter."""
    own = [f"{host} {k} says {j} of {(k * 7 + j) % 11}" for j in range(3 + k % 4)]
    frame = [f"Menu {k % 3} of {host}", "Home", "About us", f"Notice {k % 3}"]
    body = "".join(f"<div>{x}</div>" for x in [*frame, *own, f"End of {host}", f"Partner {k % 3}"])
    return f"http://{host}/{'ab'[k % 2]}/{k:03}", f"<html><body>{body}</body></html>", own


def test_pages_without_hints(spark):
    made = [site(host, k) for host in ("one", "two") for k in range(40)]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(made)], "page_id long, url string, html string")
    wanted = {i: own for i, (_, _, own) in enumerate(made)}
    whole = {r["page_id"]: r["text"].split("\n\n") for r in html_text.extract(pages).collect()}
    right = sum(len(set(whole[i]) & set(wanted[i])) for i in wanted)
    assert right >= 0.95 * sum(map(len, whole.values())) and right >= 0.95 * sum(map(len, wanted.values()))
    # Small chunks give what one list of all pages gives.
    order = sorted(range(len(made)), key=lambda i: made[i][0])
    read = [html_text.lines(made[i][1]) for i in order]
    hosts, paths = [made[i][0].split("/")[2] for i in order], [made[i][0].split("/", 3)[3] for i in order]
    shared = html_text.frames(hosts, paths, [f for f, _ in read], [m for _, m in read], 3)
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages, near=3, chunk=4).collect()}
    assert got == {i: "\n\n".join(f[x] for x in html_text.keep(m, s)) for i, (f, m), s in zip(order, read, shared, strict=True)}


def test_articles_are_protected_and_copies_stay_equal(spark):
    page = lambda own, note: f"<nav>Menu</nav><div>Site</div><article><p>Same words</p><p>{own}</p></article><!-- {note} -->"
    rows = [(1, "http://h/1", page("a", 0), "x"), (2, "http://h/2", page("b", 0), "x"), (3, "http://h/3", page("a", 1), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _page string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got == {1: "Same words\n\na", 2: "Same words\n\nb", 3: "Same words\n\na"}


def test_neighbours_lose_shared_lines(spark):
    page = lambda own: f"<html><body><div>Shared top</div><p>{own}</p><div>Shared end</div></body></html>"
    rows = [(1, "http://h/a/1", page("first"), "t"), (2, "http://h/a/2", page("second"), "t"), (3, "http://other/a", page("third"), "t"), (4, None, None, "t"),
            (5, "http://h/a/1", page("first"), "t"), (6, "", "", "t"), (7, "http://long/x", "<p>" + "word " * 60_000 + "</p>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, lines string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert (got[1], got[2], got[5], got[4], got[6]) == ("first", "second", "first", "", "")
    assert got[3] == "Shared top\n\nthird\n\nShared end" and len(got[7]) == 60_000 * 5 - 1
    assert html_text.extract(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        html_text.extract(pages, out="lines")


def test_query_gives_one_row_a_page(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_html_text(spark, sf)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    pages = {r["page_id"]: r["html"] or "" for r in table(spark, sf, "pages").select("page_id", "html").collect()}
    rows = got.collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages) and all(r["n_chars"] == len(r["text"]) for r in rows)
    for r in rows:
        found, marks = html_text.lines(pages[r["page_id"]])
        assert r["text"].split("\n\n") == [x for x, m in zip(found, marks, strict=True) if m == html_text.ARTICLE_LINE] or html_text.ARTICLE_LINE not in marks
    assert got.filter(F.col("text") != F.trim("text")).count() == 0
