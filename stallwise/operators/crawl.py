"""Breadth-first crawls over the links of stored pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions.match import explode_once
from stallwise.operators.pages import unescape, without
from stallwise.session import fresh_path

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(?:#.*)?$"
#: Ports that a scheme implies.
_PORTS = {"http": "80", "https": "443"}


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


#: Stands between the parts of a URL that is taken apart by one match.
_MARK = "\u0001"


def _parts(url: Column) -> Column:
    """Scheme, host, path and query with its mark; empty where absent."""
    names = ("scheme", "host", "path", "query")
    cut = _let(F.split(F.regexp_replace(url, _URL, _MARK.join(f"${k + 1}" for k in range(4))), _MARK),
               lambda x: F.struct(*[F.when(F.size(x) == 4, F.get(x, F.lit(k))).otherwise("").alias(name) for k, name in enumerate(names)]))
    each = F.struct(*[F.regexp_extract(url, _URL, k + 1).alias(name) for k, name in enumerate(names)])
    return F.when(url.contains(_MARK) | url.isNull(), each).otherwise(cut)


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 2)


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; one that ends in such a segment ends in a slash."""
    rooted = path.startswith("/")
    none = F.array().cast("array<string>")
    up = lambda acc: F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).when(rooted, acc).otherwise(none)
    folded = F.aggregate(F.split(path, "/"), none, lambda acc, s: F.when(s == "..", up(acc)).when(s == ".", acc).otherwise(F.array_append(acc, s)))
    closed = F.concat(F.array_join(folded, "/"), F.when(path.rlike(r"(^|/)\.\.?$"), F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), closed).otherwise(path)


def _built(p: Column) -> Column:
    """Host and canonical URL of the parts of one."""
    scheme = F.lower(p["scheme"])
    implied = F.create_map(*[F.lit(x) for pair in _PORTS.items() for x in (pair[0], ":" + pair[1])])
    bare = F.regexp_replace(F.lower(p["host"]), ":$", "")
    port = F.coalesce(F.try_element_at(implied, scheme), F.lit("::"))
    host = F.when(F.endswith(bare, port), F.left(bare, F.length(bare) - F.length(port))).otherwise(bare)
    dotted = p["path"].contains("/.") | p["path"].startswith(".")
    path = F.when(p["path"] == "", F.lit("/")).when(dotted, without_dots(p["path"])).otherwise(p["path"])
    known = (scheme != "") & (bare != "")
    return F.struct(F.when(known, host).alias("host"), F.when(known, F.concat(scheme, F.lit("://"), host, path, p["query"])).alias("url"))


def _target(r: Column, b: Column) -> Column:
    """The parts of a reference's target, from its own and those of the absolute URL it is seen from."""
    own = F.when(b["path"] == "", F.lit("/")).otherwise(b["path"])
    named, placed = r["scheme"] != "", (r["scheme"] != "") | (r["host"] != "")
    path = (F.when(placed, r["path"]).when(r["path"] == "", own).when(r["path"].startswith("/"), r["path"])
            .otherwise(F.concat(F.regexp_replace(own, "[^/]*$", ""), r["path"])))
    query = F.when(~placed & (r["path"] == "") & (r["query"] == ""), b["query"]).otherwise(r["query"])
    return F.struct(F.when(named, r["scheme"]).otherwise(b["scheme"]).alias("scheme"), F.when(placed, r["host"]).otherwise(b["host"]).alias("host"),
                    path.alias("path"), query.alias("query"))


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no dot segments, no fragment, ``/`` for an empty path; NULL without scheme or host."""
    return _let(_parts(url), _built)["url"]


def resolve(base: Column, ref: Column) -> Column:
    """The canonical target of a reference seen from an absolute URL: a scheme, an authority, a rooted path, a path, a query, or nothing."""
    return _let(_let(F.struct(_parts(ref).alias("r"), _parts(base).alias("b")), lambda x: _target(x["r"], x["b"])), _built)["url"]


def link_table(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) of every link of a page to its own host, both canonical, each pair once.

    References in double, single or no quotes; comments, scripts and styles have
    none.  Mail, phone and script references are no links, nor is one to the page itself.
    """
    body = F.regexp_replace(without(html, ["script", "style"]), "(?s)<!--.*?-->", "")
    refs = F.regexp_extract_all(body, F.lit(r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    # Each step is an array that is exploded once: a filter on its result isn't pushed below it, where it would be computed again.
    own = pages.select(html, _parts(F.col(url)).alias("base"))
    each = explode_once(own.select("base", _let(F.col("base"), _built).alias("src"), html), "ref", F.array_distinct(refs))
    quoted = F.col("ref").startswith('"') | F.col("ref").startswith("'")
    bare = F.trim(unescape(F.when(quoted, F.col("ref").substr(F.lit(2), F.length("ref") - 2)).otherwise(F.col("ref"))))
    named = explode_once(each.select("base", "src", bare.alias("ref")), "dst", F.array(_let(_let(_parts(F.col("ref")), lambda r: _target(r, F.col("base"))), _built)))
    same = named.filter((F.col("src.host") == F.col("dst.host")) & (F.col("src.url") != F.col("dst.url")) & F.col("dst.url").rlike("^https?:"))
    return same.select(F.col("src.url").alias("src"), F.col("dst.url").alias("dst")).distinct()


def first_by(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` rows that come first by a column of distinct values, whatever ``k`` and the number of rows.

    Rows are dealt over ranges and counted per range; only the range in which
    the k-th row lies is ordered, and no task sees more than one range.
    """
    spark, path = rows.sparkSession, fresh_path(rows.sparkSession, "ranges")
    rows.repartitionByRange(column).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    before = 0
    for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():  # one row a range
        if before + r["n"] > k:
            inside = dealt.filter(F.col("_range") == r["_range"]).orderBy(column).limit(k - before)
            return dealt.filter(F.col("_range") < r["_range"]).unionByName(inside).drop("_range")
        before += r["n"]
    return dealt.drop("_range")


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = fresh_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def crawl(pages: DataFrame, links: DataFrame, starts: DataFrame, depth: int, max_pages: int | None = None, url: str = "url") -> DataFrame:
    """``page`` and ``level`` of the pages that a breadth-first crawl gets from ``starts`` (page), at most ``depth`` links away.

    A link to a page that isn't stored is passed over.  With ``max_pages`` the
    crawl ends after that many pages, in the order of level and URL.  Each round
    meets only the newest pages; pages, links and rounds are stored, so that no
    page is read for its links twice, plans stay short and lost executors are replaced.
    """
    spark = pages.sparkSession
    known = _stored(pages.select(canonical(F.col(url)).alias("page")).filter("page is not null").distinct(), "known")
    # A link to a page that isn't stored leads nowhere, at whatever level.
    links = _stored(links.join(known.select(F.col("page").alias("dst")), "dst", "left_semi").select("src", "dst"), "links") if depth else links
    newest = starts.select(canonical(F.col("page")).alias("page")).distinct().join(known, "page", "left_semi")
    seen, count = None, 0
    for level in range(depth + 1):
        if level:
            found = links.join(newest.select(F.col("page").alias("src")), "src", "left_semi").select(F.col("dst").alias("page")).distinct()
            newest = found.join(seen.select("page"), "page", "left_anti")
        newest = _stored(newest, "level")
        size = newest.count()
        if max_pages is not None and count + size > max_pages:
            newest, size = first_by(newest, "page", max_pages - count), max_pages - count
        here = newest.withColumn("level", F.lit(level))
        seen = here if seen is None else seen.unionByName(here)
        count += size
        if not size or (max_pages is not None and count >= max_pages):
            break
    return seen
