"""Main text of web pages: nearest-URL differencing of their lines, with markup where it names the article.

A page becomes text lines, one per block. All pages are put in the order of host and path, each is paired with the neighbour
of its host whose path has the longest beginning in common, and the lines of both are aligned by a longest common subsequence.
Lines that both have are deleted, unless the page has them in an article or main element. Lines in menus, headers, footers,
sidebars, notices, adverts, forms and comments go anyway; of a page with an article or main element, other lines do too.

Differencing alone would be wrong both ways: articles of one host may share a paragraph, which is theirs, and menus or adverts
may be drawn anew for each page, so that no neighbour has them. The README gives figures.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

# Element names, roles and the words of class and id attributes that mark parts of a page.
RAW = "script|style|noscript|template|svg|math|iframe|object|textarea|select|title|canvas|audio|video"
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "label", "fieldset", "head"}
MAIN = {"article", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
MARKS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus",
    "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "promotion",
    "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
SPACE = {"br", "td", "th"}
CLOSES_ITSELF = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.S | re.I)
_ATTR = re.compile(r"(?<![^\s/\"'])([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PARTS = re.compile(r"[-_]+")
IN_HEAD = {"base", "link", "meta", "head"}  #: any other element closes an open head


def _names_a_part(value: str) -> bool:
    """Whether a whole class or id, or every part of a compound one, is a mark: has-comments and no-sidebar aren't, cookie-banner is."""
    return any(MARKS.issuperset(_PARTS.split(x)) for x in value.split())


def _marked(tag: str, attrs: str) -> bool:
    if tag in BOILERPLATE:
        return True
    for name, *values in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value in ROLES or name in ("class", "id") and tag not in MAIN and tag not in ("body", "html") and _names_a_part(value):
            return True
    return False


FEW = 100_000  #: pages with lines to delete that are broadcast; more meet their pages in a shuffle
OWN, OPEN, CHROME = 0, 1, 2  #: kinds of lines: of an article, of no marked part, of a marked one


def lines(page: str) -> list[tuple[str, int]]:
    """All lines of a page in order, with their kinds."""
    out: list[tuple[str, int]] = []
    words: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, whether its text is dropped, whether it is in an article
    drop = own = False

    def close() -> None:
        text = " ".join(html_lib.unescape("".join(words)).split())
        words.clear()
        if text:
            out.append((text, CHROME if drop else OWN if own else OPEN))

    at = 0
    for m in _TOKEN.finditer(page):
        if stack and stack[-1][0] == "head" and (page[at : m.start()].strip() or m["tag"] and not m["end"] and m["tag"].lower() not in IN_HEAD):
            close()
            stack.pop()
            drop, own = stack[-1][1:] if stack else (False, False)
        words.append(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if any(t == tag for t, *_ in stack):
                if tag in BLOCK or any(t in BLOCK for t, *_ in stack[-1:]):
                    close()
                while stack:
                    t = stack.pop()[0]
                    if t in BLOCK or drop != (stack[-1][1] if stack else False):
                        close()
                    drop, own = stack[-1][1:] if stack else (False, False)
                    if t == tag:
                        break
            if tag in SPACE:
                words.append(" ")
            continue
        if tag in BLOCK:
            close()
        elif tag in SPACE:
            words.append(" ")
        if tag in VOID:
            continue
        if tag in CLOSES_ITSELF and stack and stack[-1][0] == tag:
            stack.pop()
            if drop != (stack[-1][1] if stack else False):
                close()
            drop, own = stack[-1][1:] if stack else (False, False)
        marked = _marked(tag, m["attrs"])
        if tag == "header" and own and not drop:
            marked = False  # an article's own heading
        if tag in MAIN and not marked and not own and not any(t in ("nav", "footer", "aside") for t, *_ in stack):
            drop = False  # a form or a wrapper around the whole page
        if marked and not drop:
            close()
        drop, own = drop or marked, own or tag in MAIN and not (drop or marked)
        stack.append((tag, drop, own))
    if stack and stack[-1][0] == "head":
        drop = len(stack) > 1 and stack[-2][1]
    words.append(page[at:])
    close()
    return out


def kept(found: list[tuple[str, int]], gone: set[int] = frozenset()) -> list[str]:
    """The text lines of a page: its article's, or its open ones where it marks up none; without those that differencing deleted."""
    kind = OWN if any(k == OWN for _, k in found) else OPEN
    own = [(i, t) for i, (t, k) in enumerate(found) if k == kind]
    left = [t for i, t in own if i not in gone]
    return left or [t for _, t in own]


def shared_lines(a: list, b: list) -> set[int]:
    """Places in a of a longest common subsequence of a and b, by the longest chain of matching places."""
    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    ends: list[int] = []  # of the best chain of each length: its last place in b
    tops: list[tuple[int, int]] = []  # and its last link
    links: list[tuple[int, int]] = []  # place in a, link before
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(ends, j)
            links.append((i, tops[k - 1][0] if k else -1))
            if k == len(ends):
                ends.append(j)
                tops.append((len(links) - 1, j))
            else:
                ends[k], tops[k] = j, (len(links) - 1, j)
    out, at = set(), tops[-1][0] if tops else -1
    while at >= 0:
        i, at = links[at]
        out.add(i)
    return out


def _parsed(column: pa.Array) -> pa.Array:
    rows = [lines(x or "") for x in column.to_pylist()]
    texts, kinds = [[t for t, _ in r] for r in rows], [[k for _, k in r] for r in rows]
    return pa.StructArray.from_arrays([pa.array(texts, pa.list_(pa.string())), pa.array(kinds, pa.list_(pa.int8()))], ["lines", "kinds"])


def parse(html: Column) -> Column:
    """Struct of lines and kinds."""
    return F.arrow_udf(_parsed, "lines array<string>, kinds array<tinyint>")(html)


def _common(x: str, y: str) -> int:
    n = 0
    for p, q in zip(x, y, strict=False):
        if p != q:
            break
        n += 1
    return n


def _deleted(*columns: pa.Array) -> pa.Array:
    """Places of the open lines that a page shares with the nearer of two neighbours; of a page with an article none is open."""
    out = []
    for path, own, kinds, path_before, before, path_after, after in zip(*(x.to_pylist() for x in columns), strict=True):
        if before is None or after is not None and _common(path, path_after) > _common(path, path_before):
            before = after
        out.append([i for i in sorted(shared_lines(own, before or [])) if kinds[i] == OPEN] if OWN not in kinds else [])
    return pa.array(out, pa.list_(pa.int32()))


def differenced(pages: DataFrame) -> DataFrame:
    """(page_key, gone) of the pages that lose lines to their neighbour; pages has page_key, page_id, url and html.

    Pages get their rank in the order of host and path, and neighbours meet by it. Only hashes of lines are shuffled. Rows that are
    equal throughout are one page here, so a copy never deletes what it was copied from.
    """
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract("url", r"^[A-Za-z][\w+.-]*://[^/?#]*([^#]*)", 1)
    parsed = pages.select("page_key", "page_id", "url", parse(F.col("html")).alias("p"))
    rows = parsed.select("page_key", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "page_id", F.transform("p.lines", lambda x: F.xxhash64(x)).alias("lines"), F.col("p.kinds").alias("kinds"))
    rows = rows.dropDuplicates(["page_key"]).orderBy("host", "path", "page_id", "page_key")
    ranked = written(rows.select("page_key", "host", "path", "lines", "kinds", F.monotonically_increasing_id().alias("mid")), "pages")
    part = F.shiftrightunsigned("mid", 33)
    counts = {r["part"]: r["count"] for r in ranked.groupBy(part.alias("part")).count().collect()}  # as many as there are partitions
    starts, total = [], 0
    for p in sorted(counts):
        starts.append((p, total))
        total += counts[p]
    starts = rows.sparkSession.createDataFrame(starts, "part long, start long")
    ranked = ranked.join(F.broadcast(starts), part == F.col("part")).withColumn("rank", F.col("start") + F.col("mid").bitwiseAND((1 << 33) - 1)).drop("mid", "part", "start")
    # A page goes to its own rank and, as a neighbour, to the two beside it: one shuffle, and no rank has more than three rows.
    roles = F.explode(F.array(*(F.struct((F.col("rank") + d).alias("at"), F.lit(d).alias("role")) for d in (0, 1, -1)))).alias("z")
    dealt = ranked.select("host", "path", "page_key", "lines", "kinds", roles).select("*", "z.at", "z.role")
    side = lambda d: F.first(F.when(F.col("role") == d, F.struct("host", "path", "page_key", "lines", "kinds")), ignorenulls=True)
    met = dealt.groupBy("at").agg(side(0).alias("own"), side(1).alias("before"), side(-1).alias("after")).where("own is not null")
    for name in ("before", "after"):
        met = met.withColumn(name, F.when(F.col(f"{name}.host") == F.col("own.host"), F.col(name)))
    gone = F.arrow_udf(_deleted, "array<int>")(*(F.col(x) for x in ("own.path", "own.lines", "own.kinds", "before.path", "before.lines", "after.path", "after.lines")))
    return met.select(F.col("own.page_key").alias("page_key"), gone.alias("gone")).where(F.size("gone") > 0)


def _texts(html: pa.Array, gone: pa.Array) -> pa.Array:
    rows = zip(html.to_pylist(), gone.to_pylist(), strict=True)
    return pa.array(["\n".join(kept(lines(x or ""), frozenset(g or ()))) for x, g in rows], pa.string())


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages; extra columns are left out.

    A null or empty page, or one without a kept line, has an empty text. Rows with the same id are pages of their own, equal
    rows get equal texts. A page without neighbours on its host, or all of whose lines its neighbour has too, keeps its lines.
    Neighbours with paths equally near: the one before. A page of any length is taken whole. An empty table gives no rows.
    """
    own = pages.select("page_id", "url", F.xxhash64("page_id", "url", "html").alias("page_key"), "html")
    gone = written(differenced(own), "gone")
    full = own.join(F.broadcast(gone) if gone.count() <= FEW else gone, "page_key", "left")
    text = F.arrow_udf(_texts, "string")("html", "gone")
    return full.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op3(pages: DataFrame) -> DataFrame:
    return extract(pages)
