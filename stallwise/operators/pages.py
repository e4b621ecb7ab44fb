"""Stored web pages to rows.

Structure that needs a parser runs as Arrow batches over whole pages; everything
with a fixed pattern stays in column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stallwise.functions.html import HEADINGS, read_page
from stallwise.functions.match import explode_once
from stallwise.session import shared_dir

EXTRACT = "page_id bigint, url string, title string, h1 array<string>, h2 array<string>, h3 array<string>, paragraphs array<string>, list_items array<string>"


def extract(pages: DataFrame) -> DataFrame:
    """Title, headings, paragraphs over 20 characters and list items over 5, without scripts and navigation."""
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            read = [read_page(h) for h in pdf["html"]]
            yield pd.DataFrame({
                "page_id": pdf["page_id"], "url": pdf["url"], "title": [(r["title"] or [""])[0] for r in read],
                **{h: [r[h] for r in read] for h in HEADINGS},
                "paragraphs": [[t for t in r["p"] if len(t) > 20] for r in read], "list_items": [[t for t in r["li"] if len(t) > 5] for r in read]})
    return pages.select("page_id", "url", "html").mapInPandas(batches, EXTRACT)


def industries(pages: DataFrame) -> DataFrame:
    """Industry pills and entries of a labelled section in page order, and the employee count."""
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = []
            for r in (read_page(h) for h in pdf["html"]):
                pills = [t for t in r["pill"] if 2 < len(t) < 40 and not any(ch.isdigit() for ch in t)]
                found.append(list(dict.fromkeys(pills + [t for t in r["labelled"] if len(t) > 2])))
            yield pd.DataFrame({"page_id": pdf["page_id"], "industries": found, "html": pdf["html"]})
    rows = pages.select("page_id", "html").mapInPandas(batches, "page_id bigint, industries array<string>, html string")
    count = F.regexp_extract(page_text("html"), r"(?i)(\d[\d,]*)\s+employee", 1)
    return rows.select("page_id", "industries", F.replace(count, F.lit(","), F.lit("")).alias("employees"))


# ---- text and links ----------------------------------------------------------

def unescape(c: Column) -> Column:
    """The named character references of text content."""
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(ch))
    return c


def strip_tags(c: Column) -> Column:
    return F.trim(unescape(F.regexp_replace(c, "<[^>]*>", "")))


def without(html: str | Column, tags: Sequence[str]) -> Column:
    c = F.col(html) if isinstance(html, str) else html
    for t in tags:
        c = F.regexp_replace(c, rf"(?is)<{t}\b.*?</{t}\s*>", "")
    return c


def page_text(html: str) -> Column:
    """Text with one line per element."""
    return unescape(F.regexp_replace(without(html, ["script", "style"]), "<[^>]*>", "\n"))


def _resolve_path(path: Column) -> Column:
    """Dot segments of an absolute path, folded left to right."""
    segments = F.split(path, "/")
    folded = F.aggregate(segments, F.array().cast("array<string>"), lambda acc, s: F.when(
        s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).when(s == ".", acc).otherwise(F.array_append(acc, s)))
    return F.array_join(folded, "/")


def absolute(base: Column, href: Column) -> Column:
    """``href`` seen from ``base``, without its fragment."""
    origin = F.regexp_extract(base, r"^([a-z][a-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-z][a-z0-9+.-]*:)", 1)
    path = F.regexp_extract(base, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    h = F.regexp_replace(href, "#.*$", "")
    target = F.regexp_extract(h, r"^([^?]*)", 1)
    query = F.regexp_extract(h, r"(\?.*)$", 1)
    rooted = F.when(h.startswith("/"), target).when(h.startswith("?"), path).otherwise(F.concat(folder, target))
    return F.when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(scheme, h)).otherwise(
        F.concat(origin, F.when(rooted.contains("/."), _resolve_path(rooted)).otherwise(rooted), query))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def links(pages: DataFrame, noise: Sequence[str] = ("script", "style", "nav", "header", "footer")) -> DataFrame:
    """Links to the page's own host, one per URL with its first text (120 characters)."""
    body = without("html", noise)
    part = lambda g: F.regexp_extract_all(body, F.lit(r'(?is)<a\b[^>]*?\bhref="([^"]*)"[^>]*>(.*?)</a>'), F.lit(g))
    each = pages.select("page_id", "url", F.posexplode(F.arrays_zip(part(1).alias("href"), part(2).alias("text"))).alias("pos", "l"))
    href = unescape(F.trim("l.href"))
    kept = each.withColumn("href", href).filter(~F.col("href").rlike("^(mailto:|tel:|#|javascript:|$)"))
    out = kept.select("page_id", "pos", host(F.col("url")).alias("_host"), absolute(F.col("url"), F.col("href")).alias("link"),
                      F.substring(strip_tags(F.col("l.text")), 1, 120).alias("text"))
    same = out.filter(host(F.col("link")) == F.col("_host"))
    return same.groupBy("page_id", "link").agg(F.min_by("text", "pos").alias("text"))


def crawl_frontier(edges: DataFrame, starts: DataFrame, depth: int, max_pages: int | None = None) -> DataFrame:
    """Pages reached from ``starts`` (src) over edges (src, dst), with their level.

    Every round meets only the newest pages; what has been seen is written to
    the checkpoint folder, so plans stay short and lost executors can be replaced.
    """
    shared_dir(edges.sparkSession)
    seen = starts.select(F.col("src").alias("page"), F.lit(0).alias("level")).distinct().checkpoint()
    newest = seen
    for level in range(1, depth + 1):
        found = edges.join(newest.select(F.col("page").alias("src")), "src").select(F.col("dst").alias("page")).distinct()
        newest = found.join(seen.select("page"), "page", "left_anti").withColumn("level", F.lit(level)).checkpoint()
        seen = seen.unionByName(newest)
    if max_pages is not None:
        seen = seen.orderBy("level", "page").limit(max_pages)
    return seen


# ---- pages of fixed layout ---------------------------------------------------

def _node(html: str, cls: str, tag: str = "[a-z0-9]+") -> Column:
    """Inner HTML of the first element with a class, up to its first closing tag of that name."""
    return F.regexp_extract(html, rf'(?is)<{tag}\b[^>]*class="[^"]*\b{cls}\b[^"]*"[^>]*>(.*?)</', 1)


def to_int(c: Column) -> Column:
    """A thousands-separated number; anything else is NULL."""
    return F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("bigint")


# Marks of the card layout.
CARD = "loempia_app_card"
CARD_URL = r'href="(/apps/modules/([\d.]+)/([a-zA-Z0-9_]+)/?)"'
PURCHASES = r"Total Purchases:\s*(\d+(?:,\d+)*)(?:\s*,\s*Last month:\s*(\d+(?:,\d+)*))?"


def cards(pages: DataFrame, base: str = "") -> DataFrame:
    """Listing cards of listing pages; a card without a listing link is left out."""
    pieces = F.split("html", rf'(?=<div class="[^"]*{CARD})')
    card = pages.select("page_id", F.posexplode(pieces).alias("pos", "c")).filter(F.col("c").contains(CARD)).withColumn("_link", F.regexp_extract("c", CARD_URL, 1))
    card = card.filter(F.col("_link") != "")
    blank = lambda c: F.nullif(c, F.lit(""))
    heading = F.regexp_extract("c", r'(?is)loempia_app_entry_bottom.*?<h5\b([^>]*)>(.*?)</h5>', 2)
    head_attr = F.regexp_extract("c", r'(?is)loempia_app_entry_bottom.*?<h5\b[^>]*title="([^"]*)"', 1)
    price = F.regexp_extract("c", r'(?is)class="[^"]*loempia_panel_price[^"]*"[^>]*>(.*?)</div>', 1)
    amount = F.replace(F.regexp_extract(price, r'oe_currency_value"[^>]*>([^<]*)<', 1), F.lit(","), F.lit("")).try_cast("double")
    has_amount = price.contains("oe_currency_value")
    stars = F.size(F.regexp_extract_all("c", F.lit("rating_star_active"), F.lit(0)))
    votes = F.regexp_extract("c", r'(?is)loempia_rating_stars[^>]*title="\s*(\d+(?:,\d+)*)\s+votes?\s*"', 1)
    sold = lambda g: to_int(F.regexp_extract("c", rf'(?is)<span[^>]*title="[^"]*?{PURCHASES}', g))
    image = F.regexp_replace(F.trim(F.regexp_extract("c", r"(?is)loempia_cover.*?url\(([^)]+)\)", 1)), "^['\"]|['\"]$", "")
    return card.select(
        "page_id", "pos", F.regexp_extract("c", CARD_URL, 3).alias("tech_name"), F.regexp_extract("c", CARD_URL, 2).alias("version"),
        F.concat(F.lit(base), "_link").alias("detail_url"), unescape(F.coalesce(blank(head_attr), blank(F.trim(heading)))).alias("display_name"),
        blank(strip_tags(_node("c", "loempia_panel_summary"))).alias("summary"),
        blank(strip_tags(F.regexp_extract("c", r"(?is)loempia_panel_author.*?<b[^>]*>(.*?)</b>", 1))).alias("author"),
        F.when(has_amount, F.bround(amount * 100.0).cast("bigint")).when(F.lower(price).contains("free"), F.lit(0)).alias("price_cents"),
        F.when(has_amount, blank(F.regexp_extract(strip_tags(price), r"^([^\d\s]+)", 1))).alias("currency"),
        F.when(stars > 0, stars.cast("double")).alias("rating_stars"), to_int(votes).alias("review_count"),
        sold(1).alias("total_purchases"), sold(2).alias("last_month_purchases"),
        blank(F.when(image.startswith("//"), F.concat(F.lit("https:"), image)).otherwise(image)).alias("image_url"))


def max_page(pages: DataFrame) -> DataFrame:
    """Highest page number of the pagination block, NULL when there is one page."""
    block = F.regexp_extract("html", r'(?is)<ul[^>]*class="[^"]*\bpagination\b[^"]*"[^>]*>(.*?)</ul>', 1)
    ints = lambda p: F.transform(F.regexp_extract_all(block, F.lit(p), F.lit(1)), lambda x: x.cast("int"))
    best = F.array_max(F.concat(ints(r"/page/(\d+)"), ints(r">\s*(\d+)\s*</a>")))
    return pages.select("page_id", F.when(best > 1, best).alias("max_page"))


def partner_cards(pages: DataFrame, base: str = "") -> DataFrame:
    """Partner id, slug, name and grade of directory pages."""
    block = F.regexp_extract_all("html", F.lit(r'(?is)<a\b[^>]*aria-label="Go to reseller".*?</a>'), F.lit(0))
    each = pages.select("page_id", F.explode(block).alias("c"))
    href = F.regexp_extract("c", r'href="([^"]*)"', 1)
    slug, pid = F.regexp_extract(href, r"/partners/([a-z0-9][a-z0-9-]+-(\d+))", 1), F.regexp_extract(href, r"/partners/([a-z0-9][a-z0-9-]+-(\d+))", 2)
    named = strip_tags(F.regexp_extract("c", r"(?is)<(h5|strong)[^>]*>(.*?)</(h5|strong)>", 2))
    name = F.when(named != "", named).otherwise(F.initcap(F.replace(slug, F.lit("-"), F.lit(" "))))
    badge = F.regexp_extract("c", r'(?is)<span[^>]*class="[^"]*\bbadge\b[^"]*"[^>]*>\s*(Gold|Silver|Ready)\s*</span>', 1)
    by_class = F.initcap(F.regexp_extract("c", r'class="[^"]*bg_(gold|silver|ready)', 1))
    grade = F.when(badge != "", badge).when(by_class != "", by_class).otherwise("Unknown")
    return each.filter(pid != "").select("page_id", pid.alias("partner_id"), slug.alias("slug"), F.trim(F.regexp_replace(name, r"\s*(Gold|Silver|Ready)$", "")).alias("name"),
                                         grade.alias("grade"), F.concat(F.lit(base), F.regexp_replace(F.split_part(href, F.lit("?"), F.lit(1)), "/+$", "")).alias("url"))


def countries(pages: DataFrame) -> DataFrame:
    slugs = F.regexp_extract_all("html", F.lit(r"/partners/country/([a-z0-9][a-z0-9-]+-\d+)"), F.lit(1))
    one = pages.select(F.explode(slugs).alias("slug")).distinct()
    return one.select("slug", F.regexp_extract("slug", r"-(\d+)$", 1).alias("id"), F.initcap(F.replace(F.regexp_replace("slug", r"-\d+$", ""), F.lit("-"), F.lit(" "))).alias("name"))


# Words of navigation lines, which are never companies.
NAV_WORDS = ["skip", "menu", "sign", "search", "try it", "download", "follow", "login", "contact", "home", "blog", "pricing", "documentation"]


def references(pages: DataFrame) -> DataFrame:
    """Client references of profile pages: a company line followed by an ``A / B`` line.

    A line used as industry cannot be a company itself, so of neighbouring
    candidates every second one counts: a fold over the few candidates of a page.
    """
    # Trimmed lines without the empty ones, by one pattern over the page rather than a step for each line.
    lines = F.split(F.btrim(F.regexp_replace(page_text("html"), " *\n[ \n]*", "\n"), F.lit(" \n")), "\n")
    rows = pages.select("page_id", lines.alias("l"))
    at = lambda i: F.get(F.col("l"), i)

    def candidate(i: Column) -> Column:
        company, nxt = at(i), at(i + 1)
        slashes = F.length(nxt) - F.length(F.replace(nxt, F.lit("/"), F.lit("")))
        nav = F.lower(company).rlike("|".join(NAV_WORDS))
        return (nxt.contains(" / ") & (slashes <= 4) & (F.length(nxt) < 120) & (F.length(company) > 5) & (F.length(company) < 150)
                & company.rlike(r"^\p{Lu}") & ~nav)

    found = F.filter(F.when(F.size("l") > 1, F.sequence(F.lit(0), F.size("l") - 2)).otherwise(F.array().cast("array<int>")), candidate)
    start = F.struct(F.lit(-2).alias("last"), F.array().cast("array<int>").alias("out"))
    kept = F.aggregate(found, start, lambda acc, i: F.when(
        i - acc["last"] >= 2, F.struct(i.alias("last"), F.array_append(acc["out"], i).alias("out"))).otherwise(acc))["out"]
    # Only the three lines of a reference go on with it, not all lines of its page.
    each = explode_once(rows, "r", F.transform(kept, lambda i: F.struct(i.alias("pos"), at(i).alias("client_name"), at(i + 1).alias("client_industry"), at(i + 2).alias("desc"))))
    desc = F.col("r.desc")
    refs = each.select("page_id", "r.pos", "r.client_name", "r.client_industry", F.when(F.length(desc) > 20, F.substring(desc, 1, 300)).otherwise("").alias("description"))
    first = W.partitionBy("page_id", F.lower("client_name")).orderBy("pos")
    return refs.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def contacts(pages: DataFrame) -> DataFrame:
    """Email, phone, website, employees, location and certification of a profile page."""
    head = F.regexp_extract("html", r'(?is)<div[^>]*class="[^"]*\bo_portal_header\b[^"]*"[^>]*>(.*?)</div>', 1)
    text, head_text = page_text("html"), F.regexp_replace(head, "<[^>]*>", "\n")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    low = lambda g: F.regexp_extract(text, r"(?i)(\d+)\s*-\s*(\d+)\s*(employees|staff)", g)
    return pages.select(
        "page_id", blank(F.regexp_extract(head_text, r"[\w.-]+@[\w.-]+", 0)).alias("email"),
        blank(F.regexp_extract(head_text, r"\+?[\d \-()]{7,}", 0)).alias("phone"), blank(F.regexp_extract(head, r'href="(http[^"]*)"', 1)).alias("website"),
        F.when(low(1) != "", F.concat_ws("-", low(1), low(2))).alias("employees"),
        blank(F.regexp_extract(text, r"(?:Location|Based in):\s*([^<\n]+)", 1)).alias("location"),
        blank(F.regexp_extract(text, r"(Gold|Silver|Bronze)\s+(Partner|Certification)", 0)).alias("certification"))
