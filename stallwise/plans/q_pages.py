"""Stored pages to rows.  Listing and profile pages are laid out from the catalog by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallwise.functions import columns as C
from stallwise.operators import crawl as W, pages as G
from stallwise.plans import views as V
from stallwise.plans.registry import query
from stallwise.session import fresh_path

L = F.lit


def pages(spark, sf):
    return V.table(spark, sf, "pages")


@query("page_extract")
def page_extract(spark, sf):
    return G.extract(pages(spark, sf))


@query("page_text_lines", """SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(html, '<script\\b.*?</script\\s*>', '', 'gis'), '<style\\b.*?</style\\s*>', '', 'gis'), '<[^>]*>', '', 'g')) AS chars FROM pages""")
def page_text_lines(spark, sf):
    text = F.regexp_replace(G.without("html", ["script", "style"]), "<[^>]*>", "")
    return pages(spark, sf).select("page_id", F.length(text).alias("chars"))


_HREF = """SELECT page_id, origin || split_part(href, '#', 1) AS link, text, pos FROM (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin,
    unnest(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS text,
    generate_subscripts(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1), 1) AS pos FROM pages) WHERE href LIKE '/%'"""


@query("page_links", f"""SELECT page_id, link, arg_min(substring(trim(replace(regexp_replace(text, '<[^>]*>', '', 'g'), '&amp;', '&')), 1, 120), pos) AS text FROM ({_HREF}) GROUP BY 1, 2""")
def page_links(spark, sf):
    # The navigation is kept here: it holds the links of these pages.
    return G.links(pages(spark, sf), noise=("script", "style"))


@query("set_dedupe_links", f"SELECT page_id, count(DISTINCT link) AS n FROM ({_HREF}) GROUP BY 1")
def set_dedupe_links(spark, sf):
    return G.links(pages(spark, sf), noise=("script", "style")).groupBy("page_id").agg(F.count(L(1)).alias("n"))


@query("set_distinct_urls", "SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS site FROM pages UNION SELECT DISTINCT 'https://p' || s_suppkey || '.example.com' FROM supplier WHERE s_suppkey % 5 = 0")
def set_distinct_urls(spark, sf):
    a = pages(spark, sf).select(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1).alias("site"))
    b = V.partners(spark, sf).filter(F.col("website").isNotNull()).select(F.col("website").alias("site"))
    return a.unionByName(b).distinct()


def site_pages(spark, sf):
    """A site for each nation: a home page with its customers, a page for each customer with the orders, one for each order with its
    customer and suppliers, one for each supplier; references take every form a page may use."""
    nation, customer, orders, line, supplier = (V.table(spark, sf, t) for t in ("nation", "customer", "orders", "lineitem", "supplier"))
    site = lambda n: F.concat(L("https://N"), n.cast("string"), L(".example.com:443"))
    ref = lambda *parts: F.concat(*[L(p) if isinstance(p, str) else p.cast("string") for p in parts])
    links = lambda c: F.concat(L("<html><body><!-- <a href='/no'>no</a> -->"), F.array_join(F.array_sort(F.collect_set(c)), ""), L("</body></html>"))
    home = customer.groupBy("c_nationkey").agg(links(ref("<a class=x href='c/", F.col("c_custkey"), "/'>c</a>")).alias("html")).select(site(F.col("c_nationkey")).alias("url"), "html")
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", F.col("c_nationkey").alias("n"))
    people = placed.groupBy("n", "c_custkey").agg(links(ref('<a href="../../c/./../o/', F.col("o_orderkey"), '?a=1&amp;b=2#top">o</a>')).alias("html"))
    people = people.select(F.concat(site(F.col("n")), L("/c/"), F.col("c_custkey").cast("string"), L("/")).alias("url"), "html")
    sold = line.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    bought = sold.groupBy("n", "o_orderkey", "c_custkey").agg(F.concat(
        links(ref("<a href=//n", F.col("s_nationkey"), ".example.com/s/", F.col("s_suppkey"), ">s</a>")), ref('<A HREF="?p=2">2</A><a href="/c/', F.first("c_custkey"), '/">back</a>')).alias("html"))
    bought = bought.select(F.concat(site(F.col("n")), L("/o/"), F.col("o_orderkey").cast("string"), L("?a=1&b=2")).alias("url"), "html")
    shops = supplier.select(F.concat(site(F.col("s_nationkey")), L("/s/"), F.col("s_suppkey").cast("string")).alias("url"), L("<p>no links</p>").alias("html"))
    return home.unionByName(people).unionByName(bought).unionByName(shops)


# The same links from the keys alone; a link leads on where its page is stored.
_SITES = """sites AS (SELECT 'https://n' || c_nationkey || '.example.com' AS site, c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey),
edges AS (
  SELECT site || '/' AS src, site || '/c/' || c_custkey || '/' AS dst FROM sites WHERE o_orderkey IS NOT NULL
  UNION SELECT site || '/c/' || c_custkey || '/', site || '/o/' || o_orderkey || '?a=1&b=2' FROM sites JOIN lineitem ON l_orderkey = o_orderkey
  UNION SELECT site || '/o/' || o_orderkey || '?a=1&b=2', site || '/c/' || c_custkey || '/' FROM sites JOIN lineitem ON l_orderkey = o_orderkey
  UNION SELECT site || '/o/' || o_orderkey || '?a=1&b=2', site || '/s/' || s_suppkey FROM sites JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
    AND site = 'https://n' || s_nationkey || '.example.com'),
walk(page, level) AS (
  SELECT DISTINCT 'https://n' || c_nationkey || '.example.com/', 0 FROM customer
  UNION SELECT dst, level + 1 FROM walk JOIN edges ON src = page WHERE level < 3),
reached AS (SELECT page, min(level) AS level FROM walk GROUP BY page)"""


@query("page_crawl_frontier", f"WITH RECURSIVE {_SITES} SELECT page, level FROM reached")
def page_crawl_frontier(spark, sf):
    """Three links deep from every home page."""
    stored, starts = _site(spark, sf)
    return W.crawl(stored, W.link_table(stored), starts, 3)


@query("page_crawl_budget", f"WITH RECURSIVE {_SITES} SELECT page, level FROM reached ORDER BY level, page LIMIT (SELECT 25 + count(*) // 2 FROM customer)")
def page_crawl_budget(spark, sf):
    """The same crawl with a budget of pages that ends inside a level."""
    stored, starts = _site(spark, sf)
    return W.crawl(stored, W.link_table(stored), starts, 3, max_pages=25 + V.table(spark, sf, "customer").count() // 2)


def _site(spark, sf):
    path = fresh_path(spark, "site")
    site_pages(spark, sf).write.parquet(path)
    stored = spark.read.parquet(path)
    return stored, stored.filter(F.col("url").rlike(":443$")).select(F.col("url").alias("page"))


# ---- laid-out pages ----------------------------------------------------------

def listing_pages(spark, sf):
    """Pages of 20 cards each, written from the listings."""
    cents = F.col("price_cents")
    price = F.when(cents.isNull(), L("")).when(cents == 0, L('<div class="loempia_panel_price">FREE</div>')).otherwise(F.concat(
        L('<div class="loempia_panel_price">$ <span class="oe_currency_value">'), F.format_number(cents / 100.0, 2), L("</span></div>")))
    stars = F.repeat(L('<i class="rating_star_active"></i>'), F.coalesce("rating_stars", L(0.0)).cast("int"))
    sold = F.concat(L('<div class="loempia_tags"><span title="Total Purchases: '), F.format_number("total_purchases", 0),
                    F.coalesce(F.concat(L(", Last month: "), F.format_number("last_month_purchases", 0)), L("")), L('">s</span></div>'))
    card = F.concat(
        L('<div class="loempia_app_entry loempia_app_card"><a href="/apps/modules/'), "version", L("/"), "tech_name", L('/"></a><div class="loempia_cover"><div class="img" style="background: url(\'//img.example.com/'),
        F.col("file_pos").cast("string"), L('\')"></div></div><p class="loempia_panel_summary">'), "summary", L('</p><div class="loempia_app_entry_bottom"><h5 title="'), "display_name",
        L('">cut</h5></div><div class="loempia_panel_author">by <b>'), "author", L("</b></div>"), price, L('<div class="loempia_rating_stars" title="'),
        F.format_number("review_count", 0), L(' votes">'), stars, L("</div>"), sold, L("</div>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_pos", card.alias("c")))), lambda s: s["c"]), "\n")  # 20 cards
    page = F.floor(F.col("file_pos") / 20)
    nav = F.concat(L('<ul class="pagination"><li><a class="page-link" href="/apps/browse/page/'), (F.col("page_id") + 3).cast("string"), L('">next</a></li><li><a class="page-link" href="#">2</a></li></ul>'))
    rows = V.listings(spark, sf).groupBy(page.alias("page_id")).agg(body.alias("b"))
    return rows.select("page_id", F.concat(L("<html><body>"), "b", nav, L("</body></html>")).alias("html"))


@query("page_cards", """SELECT tech_name, version, '/apps/modules/' || version || '/' || tech_name || '/' AS detail_url, display_name, summary, author, price_cents,
    CASE WHEN price_cents > 0 THEN '$' END AS currency, rating_stars, review_count, total_purchases, last_month_purchases, 'https://img.example.com/' || file_pos AS image_url FROM listings""")
def page_cards(spark, sf):
    return G.cards(listing_pages(spark, sf)).drop("page_id", "pos")


@query("page_max_page", "SELECT DISTINCT file_pos // 20 AS page_id, (file_pos // 20 + 3)::INT AS max_page FROM listings")
def page_max_page(spark, sf):
    return G.max_page(listing_pages(spark, sf))


def _slug(c):
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", "-"))


def directory_pages(spark, sf):
    """One directory entry per partner; every third grade is told by its class only."""
    p = V.partners(spark, sf)
    slug = F.concat(L("p-"), _slug("name"), L("-"), F.col("partner_id").cast("string"))
    badge = F.when(F.col("grade") == "Unknown", L("")).when(F.col("phone").isNotNull(), F.concat(L('<i class="bg_'), F.lower("grade"), L('"></i>'))).otherwise(
        F.concat(L('<span class="badge x">'), "grade", L("</span>")))
    country = F.concat(L('<a href="/partners/country/'), _slug("country"), L("-"), F.regexp_extract("country", r"(\d+)$", 1), L('">c</a>'))
    html = F.concat(L('<a aria-label="Go to reseller" href="/partners/'), slug, L('?country=1"><h5>'), "name", L(" "), F.when(F.col("grade") == "Unknown", L("")).otherwise(F.col("grade")), L("</h5>"), badge, L("</a>"), country)
    return p.select(F.col("partner_id").alias("page_id"), html.alias("html"))


@query("page_partners", "SELECT partner_id::VARCHAR AS partner_id, name, grade, '/partners/p-' || lower(regexp_replace(name, '[^A-Za-z0-9]+', '-', 'g')) || '-' || partner_id AS url FROM partners")
def page_partners(spark, sf):
    return G.partner_cards(directory_pages(spark, sf)).select("partner_id", "name", "grade", "url")


@query("page_countries", """SELECT DISTINCT lower(replace(country, '_', '-')) || '-' || regexp_extract(country, '([0-9]+)$', 1) AS slug, regexp_extract(country, '([0-9]+)$', 1) AS id,
    'Nation ' || regexp_extract(country, '([0-9]+)$', 1) AS name FROM partners""")
def page_countries(spark, sf):
    return G.countries(directory_pages(spark, sf))


def profile_pages(spark, sf, refs=True):
    """A profile per partner: contacts and industries, and its clients as references, a page for each thousand."""
    p = V.partner_pages(spark, sf) if refs else V.partners(spark, sf).withColumn("clients", F.array().cast("array<string>"))
    head = F.concat(L('<div class="o_portal_header">'), F.coalesce("email", L("")), L("<br>"), F.coalesce(F.concat(L("tel "), F.col("phone")), L("")), L("<br>"),
                    F.coalesce(F.concat(L('<a href="'), F.col("website"), L('">site</a>')), L("")), L("</div>"))
    refs = F.array_join(F.transform("clients", lambda c: F.concat(L("<h5>"), c, L("</h5><p>Trade / "), F.upper(F.substring(c, 1, 1)), L("</p><p>Served since the start of the directory, "), c, L("</p>"))), "")
    pills = F.array_join(F.transform("industries", lambda i: F.concat(L('<span class="badge">'), i, L("</span>"))), "")
    cert = F.when(F.col("grade").isin("Gold", "Silver"), F.concat("grade", L(" Partner"))).otherwise("member")
    html = F.concat(L("<html><body>"), head, L("<div>"), cert, L("</div><div>Location: "), "country", L("</div><div>"), F.replace("employees", L("-"), L(" - ")), L(" staff</div>"), pills, refs,
                    L("</body></html>"))
    return p.select(F.col("partner_id").alias("page_id"), html.alias("html"))


@query("page_contact", """SELECT partner_id AS page_id, email, CASE WHEN phone IS NOT NULL AND length(phone) >= 7 THEN phone END AS phone, website, employees, country AS location,
    CASE WHEN grade IN ('Gold', 'Silver') THEN grade || ' Partner' END AS certification FROM partners""")
def page_contact(spark, sf):
    return G.contacts(profile_pages(spark, sf, refs=False))


@query("page_refs", """SELECT partner_id AS page_id, client AS client_name, 'Trade / ' || upper(client[1]) AS client_industry, 'Served since the start of the directory, ' || client AS description
    FROM (SELECT partner_id, unnest(clients) AS client FROM partners)""")
def page_refs(spark, sf):
    return G.references(profile_pages(spark, sf)).select("page_id", "client_name", "client_industry", "description")


@query("page_industries", "SELECT partner_id AS page_id, array_to_string(industries, ',') AS industries FROM partners")
def page_industries(spark, sf):
    return G.industries(profile_pages(spark, sf, refs=False)).select("page_id", F.array_join("industries", ",").alias("industries"))
