"""Forum posts: JSON lines, topics, HTML, resuming."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import text as T
from . import jsonl

TEXTS = ("topic_id", "topic_title", "topic_url", "post_id", "post_url", "author", "posted_at", "text")
POST = StructType([*[StructField(x, StringType()) for x in TEXTS], StructField("page_number", IntegerType()), StructField("post_number", IntegerType())])
REQUIRED = ("topic_id", "topic_title", "post_id", "post_url", "text")


def filled(*names: str) -> Column:
    """Whether all of them hold more than white space; null is missing."""
    out = F.lit(True)
    for n in names:
        out = out & (F.coalesce(T.strip(F.col(n)), F.lit("")) != "")
    return out


def load_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts with all REQUIRED fields; raises for a missing one and for a post_id that repeats."""
    rows = jsonl.checked(jsonl.read(spark, path, POST), *[(filled(x), f"missing {x}") for x in REQUIRED])
    return jsonl.unique(rows, "post_id", "duplicate post_id").drop("_file", "_line")


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document per post, with its title."""
    rows = jsonl.checked(jsonl.read(spark, path, POST), (filled("topic_title", "text"), "missing topic_title or text"))
    title = T.strip(F.col("topic_title"))
    kept = {"topic_id": "topic_id", "post_id": "post_id", "topic_url": "topic_url", "source_url": "post_url", "author": "author", "posted_at": "posted_at", "post_number": "post_number"}
    pairs = [x for k, c in kept.items() for x in (F.lit(k), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    meta = F.create_map(F.lit("topic_title"), title, *pairs)
    return rows.select(F.concat_ws(":", F.lit("forum"), "topic_id", "post_id").alias("doc_id"), F.concat(F.lit("Topic: "), title, F.lit("\n\n"), T.strip(F.col("text"))).alias("text"), F.lit("forum").alias("source_type"), meta.alias("metadata"))


def resume_state(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known post ids, and the largest post_number per topic."""
    return posts.select("post_id").distinct(), posts.groupBy("topic_id").agg(F.max("post_number").alias("post_number"))


class PostParser(HTMLParser):
    """Posts of a topic page: article elements named elComment_<id>, their user text without quotes and embeds."""

    SKIP = frozenset("blockquote script style noscript".split())

    def __init__(self):
        super().__init__()
        self.posts: list[dict] = []
        self.stack: list[tuple[str, str]] = []
        self.title: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        names = set(a.get("class", "").split())
        mode = self.stack[-1][1] if self.stack else ""
        if tag in {"br", "img", "hr", "input", "meta", "link"}:
            return
        if tag == "article" and a.get("id", "").startswith("elComment_"):
            self.posts.append({"post_id": a["id"].removeprefix("elComment_"), "author": "", "posted_at": "", "text": [], "author_text": []})
            mode = "post"
        elif mode and (tag in self.SKIP or names & {"ipsQuote", "ipsEmbeddedVideo"}):
            mode = "skip" if mode == "text" else mode
        elif mode == "post" and "ipsRichText--user" in names:
            mode = "text"
        elif mode == "post" and tag == "h3":
            mode = "name"
        elif mode == "name" and tag == "a" and "/profile/" in a.get("href", ""):
            mode = "author"
        elif not mode and tag == "h1":
            mode = "title"
        if tag == "time" and self.posts and mode == "post" and not self.posts[-1]["posted_at"]:
            self.posts[-1]["posted_at"] = a.get("datetime", "")
        self.stack.append((tag, mode))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        mode = self.stack[-1][1] if self.stack else ""
        if mode == "text":
            self.posts[-1]["text"].append(data)
        elif mode == "author":
            self.posts[-1]["author_text"].append(data)
        elif mode == "title":
            self.title.append(data)


def page_posts(html: str | None) -> list[dict]:
    """Posts with text of a topic page: topic_title, post_id, author, posted_at, text."""
    p = PostParser()
    p.feed(html or "")
    p.close()
    out = []
    for x in p.posts:
        body = re.sub(r"\n\s*\n\s*\n+", "\n\n", re.sub(r"[ \t]+", " ", "".join(x["text"]).replace("\u00a0", " "))).strip()
        if x["post_id"] and body:
            out.append({"topic_title": "".join(p.title).strip(), "post_id": x["post_id"], "author": "".join(x["author_text"]).strip(), "posted_at": x["posted_at"], "text": body})
    return out


def extract_posts(pages: DataFrame) -> DataFrame:
    """pages (url, html) as rows of posts, with the URL of the page."""
    kind = "array<struct<topic_title:string,post_id:string,author:string,posted_at:string,text:string>>"
    posts = F.udf(page_posts, kind, useArrow=True)
    return pages.select("url", F.explode(posts("html")).alias("p")).select("url", "p.*")
