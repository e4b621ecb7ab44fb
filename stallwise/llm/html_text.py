"""Main text of web pages by differencing with the pages of the nearest URLs.

Pages are sorted by host and URL path, and each is paired with its neighbours
of the same host, nearest first.  The text lines of two pages (one line for
each block element) are aligned by longest common subsequence; what they share
is the site's frame, and is deleted.  A frame changes from page to page, so
several neighbours are asked, and a line that any of them shares goes.

Markup has two words beside it: an article that a page marks is protected from
deletion, since several pages may print the same lines; and of what is left,
lines inside elements that never hold main text (menus, headers, footers,
asides, forms, adverts, comments ...) are dropped, as are, on a page that marks its
article, all lines outside it.
"""

from __future__ import annotations

import html as entities
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.llm.common import free_name, written

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*?)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=\s|/|\Z)", re.IGNORECASE)
#: Elements whose content is no markup, up to their own end tag.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = RAW | set("nav header footer aside form template svg math button select option dialog menu head object canvas audio video".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
ARTICLE = {"article", "main"}
FRAME_LINE, ARTICLE_LINE = -1, 1
#: Neighbours that a page is compared with on either side, and pages of a chunk.
NEAR, CHUNK = 8, 256
#: Bits that are kept to align two pages.
MATRIX = 1 << 24
#: Words of a class, id or role that mark what is not main text.
WORDS = set("""ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices
    popup modal overlay newsletter subscribe subscription signup login sidebar sidebars widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs footer header
    masthead comment comments commentlist disqus reply replies respond share sharing social related recommended toolbar search searchbox contentinfo complementary form
    alert skip pagination pager copyright legal disclaimer tags""".split())

#: Those that tell so of an article element, too.
ARTICLE_WORDS = set("ad ads advert advertisement sponsor sponsored promo promotion comment comments reply related recommended".split())


def _unwanted(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element never holds main text; an article's own header does."""
    if name in NEVER and not (name == "header" and inside):
        return True
    if not attributes or name in {"body", "html"}:
        return False
    words_of_kind = ARTICLE_WORDS if name in ARTICLE else WORDS
    for m in ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "hidden" and m[2] is None and m[3] is None and m[4] is None:
            return True
        words = set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()))
        hit = words & words_of_kind
        if hit and not (hit == {"header"} and inside):
            return True
    return False


def lines(page: str) -> tuple[list[str], list[int]]:
    """Text lines, and for each ARTICLE_LINE inside an article, FRAME_LINE inside an unwanted element, else 0.

    White space inside a block is one space, character references are
    decoded, empty blocks leave no line.  Tags that never end and ends that
    never began are read as browsers do, in the main: a block ends an open
    paragraph, an end tag closes what is open inside its element, and a quote
    counts only behind an equals sign.
    """
    found: list[str] = []
    marks: list[int] = []
    stack: list[tuple[str, bool, bool]] = []
    blocks: list[int] = []
    opened: Counter[str] = Counter()
    text: list[str] = []
    bad = inside = 0

    def flush() -> None:
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            if line:
                found.append(line)
                marks.append(FRAME_LINE if bad else ARTICLE_LINE if inside else 0)
            text.clear()

    def close(depth: int) -> None:
        nonlocal bad, inside
        while len(stack) > depth:
            name, unwanted, article = stack.pop()
            opened[name] -= 1
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            if name not in INLINE or unwanted:
                flush()
            bad -= unwanted
            inside -= article

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        text.append(page[at: m.start() if m else size])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "br" or name == "p" and not opened["p"]:
                text.append(" ")
            if opened[name]:
                close(next(d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == name))
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                text.append(" ")
            continue
        if name not in INLINE:
            if blocks and stack[blocks[-1]][0] == "p":
                close(blocks[-1])
            if blocks and name in {"li", "dt", "dd", "tr", "td", "th", "option"} and stack[blocks[-1]][0] in {name, *({"dt", "dd"} if name in {"dt", "dd"} else ()), *({"td", "th"} if name in {"td", "th"} else ())}:
                close(blocks[-1])
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        unwanted, article = _unwanted(name, m[3], inside > 0), name in ARTICLE or 'role="main"' in m[3]
        if name not in INLINE or unwanted:
            flush()
        if m[3].endswith("/") and name not in INLINE and name in {"svg", "path"}:
            continue
        if name not in INLINE:
            blocks.append(len(stack))
        stack.append((name, unwanted, article))
        opened[name] += 1
        bad += unwanted
        inside += article
    close(0)
    flush()
    return found, marks


def _rows(left: list[int], right: list[int]) -> Iterator[int]:
    """For each start of ``left``, bits of ``right``: 0 where the longest common subsequence grows by that line."""
    where: dict[int, int] = {}
    for j, line in enumerate(right):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(right)) - 1
    row = full
    for line in left:
        met = row & where.get(line, 0)
        row = (row + met | row - met) & full
        yield row


def _lengths(left: list[int], right: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of ``left`` with each start of ``right``."""
    row = (1 << len(right)) - 1
    for row in _rows(left, right):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(right) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(right)]
    return np.append(0, np.cumsum(bits == 0))


def _aligned(left: list[int], right: list[int]) -> list[int]:
    """Positions of ``left`` in a longest common subsequence; rows of bits are kept as far as MATRIX goes, longer pages are halved."""
    if not left or not right:
        return []
    if len(left) > 1 and len(left) * len(right) > MATRIX:
        half = len(left) // 2
        cut = int(np.argmax(_lengths(left[:half], right) + _lengths(left[half:][::-1], right[::-1])[::-1]))
        return _aligned(left[:half], right[:cut]) + [half + i for i in _aligned(left[half:], right[cut:])]
    rows, out = list(_rows(left, right)), []
    i, j = len(left), len(right)
    while i and j:
        if rows[i - 1] >> j - 1 & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> j - 1 & 1:
                out.append(i)
                j -= 1
    return out[::-1]


def common(left: list[int], right: list[int]) -> set[int]:
    """Positions of ``left`` in a longest common subsequence with ``right``.

    Lines that one page alone has and equal starts and ends need no search.
    """
    both = set(left) & set(right)
    at = [i for i, line in enumerate(left) if line in both]
    a, b = [left[i] for i in at], [line for line in right if line in both]
    short = min(len(a), len(b))
    start = next((k for k in range(short) if a[k] != b[k]), short)
    end = next((k for k in range(short - start) if a[-1 - k] != b[-1 - k]), short - start)
    middle = _aligned(a[start: len(a) - end], b[start: len(b) - end])
    return {at[k] for k in (*range(start), *(start + k for k in middle), *range(len(a) - end, len(a)))}


def _alike(a: str, b: str) -> int:
    """How long a start two paths have in common."""
    return len(os.path.commonprefix([a, b]))


def frames(hosts: list[str], paths: list[str], own: list[list[int]], marks: list[list[int]], each: int = NEAR) -> list[list[int]]:
    """For pages in the order of host and path, the numbers of the lines that they share with up to ``each`` neighbours on either side.

    Neighbours are asked nearest first until no line outside articles is left to delete.
    """
    out = []
    for k, host in enumerate(hosts):
        near = [n for n in range(max(0, k - each), min(len(hosts), k + each + 1)) if n != k and hosts[n] == host]
        left = {i for i, m in enumerate(marks[k]) if m != ARTICLE_LINE}
        shared: set[int] = set()
        for n in sorted(near, key=lambda n: (-_alike(paths[k], paths[n]), abs(n - k), n)):
            if not left:
                break
            met = left & common(own[k], own[n])
            shared |= met
            left -= met
        out.append(sorted(shared))
    return out


def keep(marks: list[int], shared: Iterable[int]) -> list[int]:
    """Numbers of the lines that are main text: not shared, and by the page's own marks no frame."""
    gone, least = set(shared), ARTICLE_LINE if ARTICLE_LINE in marks else 0
    return [i for i, m in enumerate(marks) if i not in gone and m >= least]


def _host(url: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def _path(url: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*|[?#].*$", "")


def _chunks(sheets: DataFrame, size: int, each: int) -> DataFrame:
    """The rows with ``chunk`` and their number ``at`` in the order of host and path; rows near a border are in both chunks.

    No host is held in one task: rows are sorted over all tasks and numbered by task and row, and a chunk has
    at most ``size`` rows and ``each`` more on either side.
    """
    order = ["host", "path", "sheet"]
    ids = written(sheets.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "page-order")
    part = F.shiftright("id", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each task of the sort.
    base = ids.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = ids.withColumn("part", part).join(F.broadcast(base), "part").withColumn("at", F.col("base") + F.col("id") - F.shiftleft("part", 33))
    own = F.floor(F.col("at") / size)
    places = F.array_distinct(F.array(own, F.floor(F.greatest(F.col("at") - each, F.lit(0)) / size), F.floor((F.col("at") + each) / size)))
    return numbered.select(*sheets.columns, "at", F.explode(places).alias("chunk"))


def extract(pages: DataFrame, html: str = "html", url: str = "url", out: str = "text", near: int = NEAR, chunk: int = CHUNK) -> DataFrame:
    """All columns of ``pages`` and ``out``, the main text: lines in page order, joined by an empty line.

    Each page is compared with up to ``near`` pages on either side.  Null html counts as empty and gives an empty text; pages without a usable
    URL share the host of no name; a page whose host has no other page with
    other lines loses nothing by differencing.  Pages of a host with equal lines are one page in the order, so
    copies never delete each other and get equal texts.
    ``out`` must not be a column already.  An empty table gives an empty one.
    """
    if out in pages.columns:
        raise ValueError(f"column {out} exists")
    if not 0 < near <= chunk:
        raise ValueError("near must be 1 to chunk")
    body = F.coalesce(F.col(html), F.lit(""))

    def sheet_of(found: list[str], marks: list[int]) -> str:
        return xxhash.xxh3_128_hexdigest(("\n".join(found) + "\n\n" + "".join(map(str, marks))).encode("utf-8", "surrogatepass"))

    @F.pandas_udf("struct<own: array<long>, marks: array<int>, sheet: string>")
    def hashed(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            read = [lines(page) for page in part]
            own = [[xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in found] for found, _ in read]
            yield pd.DataFrame({"own": own, "marks": [m for _, m in read], "sheet": [sheet_of(*x) for x in read]})

    @F.pandas_udf("struct<number: array<int>, line: array<string>, sheet: string>")
    def parsed(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        """The lines that the page's own marks leave, and their numbers among all."""
        for part in parts:
            read = [(f, m, keep(m, ())) for f, m in map(lines, part)]
            yield pd.DataFrame([(at, [f[i] for i in at], sheet_of(f, m)) for f, m, at in read], columns=["number", "line", "sheet"])

    @F.pandas_udf("string")
    def kept(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for numbers, line, shared in parts:
            yield pd.Series(["\n\n".join(x for i, x in zip(n, f, strict=True) if i not in gone) for n, f, gone in zip(numbers, line, map(set, shared), strict=True)], dtype=object)

    def differenced(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a chunk lie together, in order; only the last chunk of a batch can go on in the next."""
        rest = None
        for part in parts:
            rest = part if rest is None else pd.concat([rest, part], ignore_index=True)
            last = rest["chunk"] == rest["chunk"].iloc[-1] if len(rest) else rest["chunk"].isna()
            yield from map(compared, (g for _, g in rest[~last].groupby("chunk", sort=False)))
            rest = rest[last].reset_index(drop=True)
        if rest is not None and len(rest):
            yield compared(rest)

    def compared(some: pd.DataFrame) -> pd.DataFrame:
        own, marks = ([list(x) for x in some[c]] for c in ("own", "marks"))
        made = pd.DataFrame({"host": some["host"].to_numpy(), "sheet": some["sheet"].to_numpy(), "shared": frames(list(some["host"]), list(some["path"]), own, marks, near)})
        return made[(some["at"] // chunk == some["chunk"]).to_numpy()]

    read = pages.select(_host(url).alias("host"), _path(url).alias("path"), hashed(body).alias("read"))
    sheets = read.groupBy("host", "read.sheet").agg(F.min("path").alias("path"), F.min("read.own").alias("own"), F.min("read.marks").alias("marks"))
    dealt = _chunks(sheets.select("host", "path", "sheet", "own", "marks"), chunk, near).repartition("chunk").sortWithinPartitions("chunk", "at")
    found = dealt.select("chunk", "at", "host", "path", "sheet", "own", "marks").mapInPandas(differenced, "host string, sheet string, shared array<int>")
    page, verdict = free_name(pages.columns, "_page"), written(found.filter(F.size("shared") > 0), "page-frames")
    names = [free_name(pages.columns, x) for x in ("_host", "_shared")]
    ready = pages.select(*pages.columns, _host(url).alias(names[0]), parsed(body).alias(page))
    told = verdict.select(F.col("host").alias("h"), F.col("sheet").alias("s"), F.col("shared").alias(names[1]))
    # The verdicts grow with the pages: they are merged at every size, never broadcast.
    joined = ready.join(told.hint("merge"), (F.col(names[0]) == F.col("h")) & (F.col(f"{page}.sheet") == F.col("s")), "left")
    shared = F.coalesce(F.col(names[1]), F.array().cast("array<int>"))
    return joined.select(*(ready[c] for c in pages.columns), kept(f"{page}.number", f"{page}.line", shared).alias(out))
