"""Encyclopedia articles: HTML to sections, JSON lines, manifests, fetching."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions import text as T
from . import jsonl
from .forum import filled

#: Elements and classes that go, and first headings whose sections go.
GONE = frozenset("script style".split())
GONE_CLASSES = frozenset("mw-editsection reflist references navbox vertical-navbox authority-control sistersitebox shortdescription noprint".split())
EXCLUDED = ("bibliography", "external links", "further reading", "references", "see also", "sources")
LICENSE = "CC BY-SA 4.0"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CONTENT = frozenset("p ul ol table".split())


class Node:
    def __init__(self, tag: str, classes: set[str], parent: Node | None):
        self.tag, self.classes, self.parent, self.children = tag, classes, parent, []

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def words(self) -> str:
        """Texts below, each stripped, joined by spaces."""
        out = []

        def visit(n):
            for c in n.children:
                if isinstance(c, Node):
                    visit(c)
                elif c.strip():
                    out.append(c.strip())

        visit(self)
        return " ".join(out)


class Tree(HTMLParser):
    def __init__(self):
        super().__init__()
        self.root = self.at = Node("", set(), None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, set((dict(attrs).get("class") or "").split()), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def gone(n: Node) -> bool:
    return n.tag in GONE or bool(n.classes & GONE_CLASSES) or n.tag == "sup" and "reference" in n.classes


def clean(value: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"\{\{.*?\}\}", "", value)).strip()


def block_text(n: Node) -> str:
    """A table as rows of cells, a list as items, else its words."""
    if n.tag == "table":
        rows = ([clean(c.words()) for c in r.children if isinstance(c, Node) and c.tag in {"th", "td"}] for r in n.walk() if r.tag == "tr")
        return "\n".join(" | ".join(filter(None, cells)) for cells in rows if any(cells))
    if n.tag in {"ul", "ol"}:
        items = (clean(c.words()) for c in n.children if isinstance(c, Node) and c.tag == "li")
        return "\n".join(f"- {x}" for x in items if x)
    return clean(n.words())


def sections(html: str | None) -> list[dict[str, str]]:
    """[{title, text}] of an article: titles are paths of headings, the text before the first is Lead."""
    tree = Tree()
    tree.feed(html or "")
    tree.close()

    def prune(n: Node) -> None:
        n.children = [c for c in n.children if not (isinstance(c, Node) and gone(c))]
        for c in n.children:
            if isinstance(c, Node):
                prune(c)

    root = next((n for n in tree.root.walk() if "mw-parser-output" in n.classes), tree.root)
    prune(root)
    path, parts, out = [], [], []

    def end() -> None:
        text = "\n".join(parts).strip()
        if text and (path[0] if path else "Lead").split(" > ", 1)[0].casefold() not in EXCLUDED:
            out.append({"title": " > ".join(path) or "Lead", "text": text})
        parts.clear()

    def visit(n: Node) -> None:
        for c in n.children:
            if not isinstance(c, Node):
                continue
            if re.fullmatch("h[2-6]", c.tag):
                end()
                path[int(c.tag[1]) - 2 :] = [re.sub(r"(?i)\s*\[edit\]\s*$", "", clean(c.words()))]
            elif c.tag in CONTENT:
                text = block_text(c)
                if text:
                    parts.append(text)
            else:
                visit(c)

    visit(root)
    end()
    return out


def html_sections(pages: DataFrame) -> DataFrame:
    """(page_id, section_index, title, text) of pages (page_id, html)."""
    kind = "array<struct<title:string,text:string>>"
    return pages.select("page_id", F.posexplode(F.udf(sections, kind, useArrow=True)("html")).alias("section_index", "s")).select("page_id", "section_index", "s.*")


def without_excluded(rows: DataFrame, title: str = "title") -> DataFrame:
    """Sections whose first heading is none of EXCLUDED."""
    return rows.where(~F.lower(F.split(title, " > ")[0]).isin(*EXCLUDED))


TEXTS = ("requested_title", "title", "source_url", "language", "fetched_at", "license", "revision_timestamp", "html_sha256")
SECTION = StructType([StructField("title", StringType()), StructField("text", StringType())])
ARTICLE = StructType([*[StructField(x, StringType()) for x in TEXTS], StructField("page_id", LongType()), StructField("revision_id", LongType()), StructField("sections", ArrayType(SECTION))])


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document per section with text; ids count sections without text too."""
    rows = jsonl.checked(jsonl.read(spark, path, ARTICLE), (filled("title", "source_url") & F.col("sections").isNotNull(), "missing title, source_url or sections"))
    rows = rows.select("*", F.posexplode("sections").alias("i", "s")).withColumn("body", T.strip(F.col("s.text"))).where("body <> ''")
    title = T.strip(F.col("title"))
    section = F.coalesce(F.nullif(T.strip(F.col("s.title")), F.lit("")), F.lit("Lead"))
    kept = {"title": title, "requested_title": F.coalesce("requested_title", "title"), "section": section, "source_url": T.strip(F.col("source_url")), "page_id": F.col("page_id").cast("string"), "revision_id": F.col("revision_id").cast("string"), "revision_timestamp": F.coalesce("revision_timestamp", F.lit("")), "fetched_at": F.coalesce("fetched_at", F.lit("")), "language": F.coalesce("language", F.lit("en")), "license": F.coalesce("license", F.lit(LICENSE))}
    meta = F.create_map(*[x for k, c in kept.items() for x in (F.lit(k), c)])
    name = F.concat_ws(":", F.lit("wikipedia"), F.coalesce(F.col("page_id").cast("string"), F.lit("None")), F.coalesce(F.col("revision_id").cast("string"), F.lit("None")), F.col("i").cast("string"))
    return rows.select(name.alias("doc_id"), F.concat(F.lit("Article: "), title, F.lit("\nSection: "), section, F.lit("\n\n"), "body").alias("text"), F.lit("wiki").alias("source_type"), meta.alias("metadata"))


def load_manifest(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(ordinal, title) of the pages of a manifest, whose list must be neither empty nor hold blanks or repeats; limit cuts the list where a short run is wanted."""
    rows = spark.read.schema("pages array<string>").json(path, multiLine=True).select(F.posexplode("pages").alias("ordinal", "title")).withColumn("title", T.strip(F.col("title")))
    n, blank, names = rows.agg(F.count("*"), F.count_if(F.coalesce("title", F.lit("")) == ""), F.countDistinct("title")).first()
    if not n or blank or names < n:
        raise ValueError("a manifest needs pages, none blank, none twice")
    return rows if limit is None else rows.where(F.col("ordinal") < limit)


def same_pages(articles: DataFrame) -> DataFrame:
    """(page_id, titles) of articles that several requested titles lead to."""
    return articles.groupBy("page_id").agg(F.sort_array(F.collect_set("requested_title")).alias("titles")).where(F.size("titles") > 1)


def totals(articles: DataFrame) -> DataFrame:
    """One row: articles, sections, characters."""
    chars = F.aggregate("sections", F.lit(0), lambda n, s: n + F.coalesce(F.length(s["text"]), F.lit(0)))
    return articles.agg(F.count("*").alias("articles"), F.sum(F.size("sections")).alias("sections"), F.sum(chars).alias("chars"))


def fetch(send: Callable[[dict], tuple[int, dict, str]], title: str, most: int = 4, sleep: Callable = time.sleep) -> dict:
    """The parsed page of a title through send(params) -> (status, headers, body); 429 and 503 are tried again after Retry-After, else 2, 4, ... at most 30 s."""
    params = {"action": "parse", "page": title, "prop": "text|revid|displaytitle", "redirects": "1", "format": "json", "formatversion": "2"}
    for n in range(most + 1):
        status, headers, body = send(params)
        if status not in (429, 503):
            break
        if n < most:
            sleep(float(headers.get("Retry-After") or min(2**n, 30)))
    if status != 200:
        raise RuntimeError(f"fetching a page failed with status {status}")
    page = json.loads(body)
    if "error" in page:
        raise RuntimeError(f"the service reports {page['error'].get('code')}")
    return page["parse"]
