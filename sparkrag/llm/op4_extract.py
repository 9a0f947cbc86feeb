"""HTML extraction by page differencing: every page against the page of the nearest URL, structure as guide and check.

A page is cut into text lines, one per block. Lines in elements that never hold main text (menus, headers, footers,
asides, notices, adverts, forms, scripts, styles, reader comments) go. The lines of every page are aligned by longest
common subsequence with those of the page next to it in order of URL path on the same host; what they share is taken for
the site's. Where no article or main element is left, shared lines are deleted. Where there is one, its lines are the text,
and since articles repeat passages of each other, a shared line of it goes only if that is confirmed: differencing finds
it on at least LEAST pages and more than half of the pages of the host, it stands with others like it (and headings, which
stay) at the beginning or end of the main text, and such lines are not most of that text, as they are among copies of an
article. All is decided on the parsed page, never on its source.
Null and empty html give an empty text; a null url is a host of its own; repeated rows and equal payloads are no
neighbours of each other, since they share all lines; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_hot, stored, table

#: Element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP = frozenset("nav header footer aside form script style noscript template iframe svg button select textarea head title object".split())
MAIN = frozenset("article main".split())
BLOCK = frozenset("address article blockquote body caption center dd details dialog div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEAD = frozenset("head title meta link base style script noscript template".split())
#: A class or id is waste if its parts (between - and _) are words of WASTE, or of REMARKS with ABOUT, and else of SIDES only.
WASTE = frozenset("ad ads advert adverts advertisement advertising adslot banner sponsor sponsored sponsors promo promotion nav navbar navigation menu menus sidebar footer header cookie cookies consent notice newsletter popup modal breadcrumb breadcrumbs share sharing social related disqus subscribe widget widgets".split())
REMARKS = frozenset("comment comments reply replies respond".split())
ABOUT = frozenset("post article entry page user reader".split())
SIDES = frozenset("site top bottom left right side global primary secondary box bar block container wrapper wrap list section slot unit area panel form links link item items inner outer buttons button icons text".split())

#: Where a line stands: outside main elements, in one, in a heading in one.
OPEN, INSIDE, HEADING = 0, 1, 2
#: Pages of a host on which differencing must find a line of main elements, at least, before it goes.
LEAST = 3


def waste(names: str) -> bool:
    """Whether a class or id among names marks what is no main text."""
    for name in names.lower().split():
        parts = {x for x in re.split(r"[-_]+", name) if not x.isdigit()}
        rest = parts - WASTE - REMARKS - SIDES
        if parts & WASTE and not rest or parts & REMARKS and not rest - ABOUT:
            return True
    return False


class Lines(HTMLParser):
    """Collects (line, where it stands) of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # Open elements: tag, dropped by an element, dropped by a class, inside a main element.
        self.open: list[tuple[str, bool, bool, bool]] = []
        self.lines: list[tuple[str, int]] = []
        self.text: list[str] = []

    def state(self) -> tuple[bool, bool, bool]:
        return self.open[-1][1:] if self.open else (False, False, False)

    def end_line(self) -> None:
        line = " ".join("".join(self.text).split())
        if line:
            heading = any(x[0] in HEADINGS for x in self.open)
            self.lines.append((line, OPEN if not self.state()[2] else HEADING if heading else INSIDE))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD and self.open and any(x[0] == "head" for x in self.open):
            self.handle_endtag("head")
        if tag in VOID:
            if tag == "hr":
                self.end_line()
            elif tag == "br":
                self.text.append(" ")
            return
        if tag in BLOCK or tag in DROP:
            self.end_line()
        if tag == "p" and any(x[0] == "p" for x in self.open) or tag == "li" and self.open and self.open[-1][0] == "li":
            self.handle_endtag(tag)
        a = dict(attrs)
        element, named, main = self.state()
        element = element or tag in DROP or (a.get("role") or "").lower() in ROLES or "hidden" in a
        if tag in MAIN and not main:
            # The class of a wrapper does not speak for the article in it.
            named, main = False, not element
        elif tag not in ("body", "html"):
            named = named or waste(f"{a.get('class') or ''} {a.get('id') or ''}")
        self.open.append((tag, element, named, main))

    def handle_endtag(self, tag):
        if tag in BLOCK or tag in DROP:
            self.end_line()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break
            if self.open[i][0] in MAIN or self.open[i][0] in DROP:
                if tag not in MAIN | DROP | {"body", "html"}:
                    break

    def handle_data(self, data):
        element, named, _ = self.state()
        if not element and not named:
            self.text.append(data)


def page_lines(html: str | None) -> list[tuple[str, int]]:
    p = Lines()
    p.feed(html or "")
    p.close()
    p.end_line()
    return p.lines


def difference(lines: list[str], other: list[str]) -> str:
    """The lines that a longest common subsequence with `other` leaves."""
    shared = lcs(lines, other)
    return "\n".join(x for i, x in enumerate(lines) if i not in shared)


def main_text(lines: list[tuple[str, int]], gone: set[int]) -> str:
    """The text of a page: of its lines those in main elements, if any, without those at positions `gone`, in main elements at the ends only."""
    main = [i for i, (_, kind) in enumerate(lines) if kind != OPEN]
    if not main:
        return "\n".join(x for i, (x, _) in enumerate(lines) if i not in gone)
    ends = set()
    for order in (main, main[::-1]):
        for i in order:
            if i in gone:
                ends.add(i)
            elif lines[i][1] != HEADING:
                break
    body = [i for i in main if lines[i][1] == INSIDE]
    if 2 * sum(len(lines[i][0]) for i in ends) > sum(len(lines[i][0]) for i in body):
        ends = set()
    return "\n".join(lines[i][0] for i in main if i not in ends)


def rows_of(a: list, b: list) -> Iterator[int]:
    """For each prefix of b a bit per line of a, unset where the common subsequence grows; bit-parallel."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def lcs(a: list, b: list, most: int = 1 << 28) -> set[int]:
    """Positions in a of a longest common subsequence of a and b; memory for about `most` bits, larger pages are split in halves."""
    lo, hi = 0, 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out = {*range(lo), *range(len(a) - hi, len(a))}
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if len(a) > 1 and len(a) * len(b) > most:
        half = len(a) // 2
        left = [0, *(half - v.bit_count() for v in rows_of(a[:half], b))]
        right = [0, *(len(a) - half - v.bit_count() for v in rows_of(a[half:][::-1], b[::-1]))]
        cut = max(range(len(b) + 1), key=lambda j: left[j] + right[len(b) - j])
        found = lcs(a[:half], b[:cut], most) | {half + i for i in lcs(a[half:], b[cut:], most)}
        return out | {lo + i for i in found}
    rows = list(rows_of(a, b))
    i, j = len(a), len(b)
    while i and j:
        bit = 1 << (i - 1)
        if rows[j - 1] & bit:
            i -= 1
        elif j > 1 and not rows[j - 2] & bit:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.add(lo + i)
    return out


def neighbours(distinct: DataFrame) -> DataFrame:
    """(h, p, c, other) of distinct pages (h, p, c, lines): the lines of the page before it in order of (p, c) on its host h, for the first page those of the next; null for a page alone."""
    # The order is cut in ranges of (h, p, c), so that a large host is many tasks; of a range only the ends are seen by others.
    ranged = distinct.select("h", "p", "c").repartitionByRange("h", "p", "c").withColumn("part", F.spark_partition_id())
    light = stored(ranged, "order")
    page = F.struct("h", "p", "c")
    by = Window.partitionBy("part").orderBy("h", "p", "c")
    inside = light.withColumn("before", F.lag(page).over(by)).withColumn("after", F.lead(page).over(by))
    ends = light.groupBy("part").agg(F.min(page).alias("first"), F.max(page).alias("last"))
    order = Window.orderBy("part")
    ends = ends.select("part", F.lag("last").over(order).alias("left"), F.lead("first").over(order).alias("right"))
    near = inside.join(F.broadcast(ends), "part").select("h", "p", "c", F.coalesce("before", "left").alias("b"), F.coalesce("after", "right").alias("a"))
    other = F.when(F.col("b.h") == F.col("h"), F.col("b")).when(F.col("a.h") == F.col("h"), F.col("a"))
    others = distinct.select("h", F.col("p").alias("op"), F.col("c").alias("oc"), F.col("lines").alias("other"))
    return near.withColumn("o", other).select("h", "p", "c", F.col("o.p").alias("op"), F.col("o.c").alias("oc")).join(others, ["h", "op", "oc"], "left").select("h", "p", "c", "other")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, p, c, at, lines, kinds) of (h, p, c, at, html): hashes of all lines, and where they stand."""
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            part = b.slice(lo, 1000)
            found = [page_lines(html.as_py()) for html in part.column(4)]
            lines = [[xxhash.xxh64_intdigest(x.encode()) - (1 << 63) for x, _ in page] for page in found]
            kinds = [[kind for _, kind in page] for page in found]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(lines, pa.list_(pa.int64())), pa.array(kinds, pa.list_(pa.int32()))], ["h", "p", "c", "at", "lines", "kinds"])


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, at, open, main) of (h, at, lines, kinds, other): positions of shared lines where no main element is; else the position and hash of those in main elements, but for headings."""
    for b in batches:
        open_, main = [], []
        for x, kinds, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
            shared = sorted(lcs(x, y or []))
            open_.append([] if any(kinds) else shared)
            main.append([{"i": i, "x": x[i]} for i in shared if kinds[i] == INSIDE])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(open_, pa.list_(pa.int32())), pa.array(main, pa.list_(pa.struct([("i", pa.int32()), ("x", pa.int64())])))], ["h", "at", "open", "main"])


def _text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, text) of (page_id, url, html, gone)."""
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            part = b.slice(lo, 1000)
            texts = [main_text(page_lines(html.as_py()), set(gone.as_py() or [])) for html, gone in zip(part.column(2), part.column(3))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def deleted(light: DataFrame) -> DataFrame:
    """(at, gone): for each page of light (h, p, c, at, lines, kinds) that loses any, the positions of the lines that differencing deletes."""
    distinct = stored(light.groupBy("h", "p", "c", "at").agg(F.min(F.struct("lines", "kinds")).alias("l")).select("h", "p", "c", "at", "l.lines", "l.kinds"), "distinct")
    paired = distinct.join(neighbours(distinct.select("h", "p", "c", "lines")), ["h", "p", "c"]).select("h", "at", "lines", "kinds", "other")
    shared = stored(paired.mapInArrow(_differ, "h string, at string, open array<int>, main array<struct<i: int, x: bigint>>"), "shared")
    pages = shared.groupBy("h").agg(F.count("*").alias("pages"))
    seen = shared.select("h", F.explode(F.array_distinct("main.x")).alias("x")).groupBy("h", "x").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    # Each of a host's lines is on more than half of its pages, so that they are fewer than two pages' lines.
    often = seen.join(pages, "h").where("2 * n > pages").groupBy("h").agg(F.collect_list("x").alias("often"))
    sites = stored(pages.select("h").join(often, "h", "left"), "sites")
    confirmed = F.transform(F.filter("main", lambda m: F.array_contains("often", m["x"])), lambda m: m["i"])
    gone = join_hot(shared, sites, "h").select("at", F.when(F.size("open") > 0, F.col("open")).otherwise(F.coalesce(confirmed, F.array().cast("array<int>"))).alias("gone"))
    return stored(gone.where(F.size("gone") > 0), "deleted")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html)."""
    path = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), F.lit(""))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)), F.concat(F.lit("?"), F.col("page_id").cast("string")), F.lit("?"))
    payload = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    # Pages of one host, path and payload are one.
    rows = pages.select("page_id", "url", "html", host.alias("h"), path.alias("p"), payload.alias("c")).withColumn("at", F.sha1(F.concat_ws("\n", "h", "p", "c")))
    # Lines are compared by their hashes; texts are cut in a second reading, so that no second copy of the pages is written.
    light = stored(rows.select("h", "p", "c", "at", "html").mapInArrow(_parse, "h string, p string, c string, at string, lines array<bigint>, kinds array<int>"), "lines")
    marked = join_hot(rows.select("page_id", "url", "html", "at"), deleted(light), "at", counted=light, how="left")
    texts = marked.select("page_id", "url", "html", "gone").mapInArrow(_text, "page_id bigint, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
