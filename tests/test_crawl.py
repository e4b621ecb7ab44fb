from __future__ import annotations

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from stallwise.operators import crawl as W

BASE = "http://a.b/c/d;p?q"
REFS = ["g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g",
        "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "http://a.b/x/../y", "HTTP://A.B:80/z"]


def test_references_resolve_as_the_standard_says(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(REFS)], "i int, ref string")
    got = {r["ref"]: r["u"] for r in df.select("ref", W.resolve(F.lit(BASE), F.col("ref")).alias("u")).collect()}
    for ref in REFS:
        want = {"g:h": None, "//g": "http://g/", "HTTP://A.B:80/z": "http://a.b/z", "http://a.b/x/../y": "http://a.b/y"}.get(ref, urljoin(BASE, ref).split("#")[0])
        assert got[ref] == want, ref


def test_links_in_any_quotes(spark):
    html = """<!-- <a href="/no">x</a> --><script>'<a href="/no2">'</script><a href='/one'>1</a><a class=k href=two>2</a><A HREF="three#x">3</A>
      <a data-href="/no3">n</a><a href="mailto:x@y.z">m</a><a href="//other.h/p">o</a><a href="#top">t</a><a href="/one">again</a>"""
    rows = spark.createDataFrame([("https://H.h/dir/page", html), ("https://h.h/x", None), (None, "<a href=y>")], "url string, html string")
    assert sorted(r["dst"] for r in W.link_table(rows).collect()) == ["https://h.h/dir/three", "https://h.h/dir/two", "https://h.h/one"]


@pytest.mark.parametrize("k", [0, 1, 7, 50, 51])
def test_first_by_takes_the_first_rows(spark, k):
    rows = spark.range(50).select(F.format_string("%03d", F.col("id") * 7 % 50).alias("page")).repartition(5)
    assert sorted(r["page"] for r in W.first_by(rows, "page", k).collect()) == [f"{i:03d}" for i in range(min(k, 50))]


def test_crawl_levels_budget_and_rings(spark):
    url = lambda n: f"http://h.h/{n}"
    pages = spark.createDataFrame([(url(n), f"<a href=/{a}>a</a><a href='/{b}'>b</a>") for n, a, b in [("s", "a", "b"), ("a", "s", "c"), ("b", "c", "gone"), ("c", "d", "s"), ("d", "s", "s")]], "url string, html string")
    links, start = W.link_table(pages), spark.createDataFrame([(url("s"),), (url("none"),)], "page string")
    of = lambda df: {r["page"][-1]: r["level"] for r in df.collect()}
    assert of(W.crawl(pages, links, start, 2)) == {"s": 0, "a": 1, "b": 1, "c": 2}
    assert of(W.crawl(pages, links, start, 9, max_pages=2)) == {"s": 0, "a": 1}
    assert of(W.crawl(pages, links, start, 0)) == {"s": 0}
    assert of(W.crawl(pages.limit(0), links.limit(0), start, 3)) == {}


def test_pages_are_read_for_links_once(spark, monkeypatch):
    pages = spark.createDataFrame([("http://h.h/a", "<a href=/b>b</a>"), ("http://h.h/b", "<a href=/c>c</a>"), ("http://h.h/c", "")], "url string, html string")
    links = W.link_table(pages)
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    read = spark.sparkContext.accumulator(0)
    counted = links.rdd.map(lambda r: read.add(1) or r).toDF(links.schema)
    start = spark.createDataFrame([("http://h.h/a",)], "page string")
    assert W.crawl(pages, counted, start, 3).count() == 3 and read.value == 2


def test_parts_of_odd_urls(spark):
    odd = ["http://a.b/x\u0001y?q#f", "http://a.b/x\ny", "http://a.b/x#f\ng", "//h", "", "?q", "a:b:c", "http://u@h:8/p;x?y?z", "$1", "a\\b"]
    rows = spark.createDataFrame([(u,) for u in odd] + [(None,)], "u string")
    each = F.struct(*[F.regexp_extract("u", W._URL, k + 1).alias(n) for k, n in enumerate(("scheme", "host", "path", "query"))])
    for r in rows.select(W._parts(F.col("u")).alias("got"), each.alias("want")).collect():
        assert r["got"] == r["want"]
