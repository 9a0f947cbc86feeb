"""Chunks: token-budget splitting at natural boundaries, generic documents, forum posts."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ForumChunks
from ..functions import text as T
from .threads import with_previous

#: Budget tokens as functions.text.BUDGET counts them, and boundaries from coarse to fine.
TOKEN = re.compile(r"\w+|[^\w \t\n\r\x0b\x0c]")
BOUNDARIES = (re.compile(r"(?<=\n)(?=[^\n])(?<=\n\n)|(?<=\n\n\n)"), re.compile(r"(?<=[.!?。？！])\s+"), re.compile(r"(?<=[,;:])\s+"), re.compile(r"(?<=\s)(?=\S)"))


def count(text: str) -> int:
    return sum(1 for _ in TOKEN.finditer(text))


def pieces(text: str, budget: int, level: int = 0) -> Iterator[tuple[str, int]]:
    """(piece, tokens) that make up text, each within budget, cut at the coarsest boundaries that do: paragraph, sentence, clause, word, sign."""
    n = count(text)
    if n <= budget:
        yield text, n
        return
    if level == len(BOUNDARIES):
        # A single token is never larger than a budget of 1; runs of signs without space are cut after whole tokens.
        at, ends = 0, [m.end() for m in TOKEN.finditer(text)]
        for i in range(budget - 1, len(ends) + budget - 1, budget):
            end = ends[i] if i < len(ends) - 1 else len(text)
            yield text[at:end], min(budget, len(ends) - i + budget - 1)
            at = end
        return
    at = 0
    for m in BOUNDARIES[level].finditer(text):
        if m.end() > at:
            yield from pieces(text[at : m.end()], budget, level + 1)
            at = m.end()
    if at < len(text):
        yield from pieces(text[at:], budget, level + 1)


def split(text: str | None, budget: int, overlap: int = 0) -> list[str]:
    """Chunks of at most budget tokens; each begins with the last whole pieces of the one before that fit overlap. Blank texts have none."""
    if budget < 1 or not 0 <= overlap < budget:
        raise ValueError("overlap must be smaller than the budget")
    out: list[str] = []
    held: list[tuple[str, int]] = []
    total, fresh = 0, False
    for piece, n in pieces(text or "", budget):
        if total + n > budget and fresh:
            out.append("".join(p for p, _ in held))
            kept: list[tuple[str, int]] = []
            room = min(overlap, budget - n)
            for p, k in reversed(held):
                if k > room:
                    break
                kept.insert(0, (p, k))
                room -= k
            held, total, fresh = kept, sum(k for _, k in kept), False
        held.append((piece, n))
        total, fresh = total + n, True
    if fresh:
        out.append("".join(p for p, _ in held))
    return [x.strip() for x in out if x.strip()]


def with_parts(rows: DataFrame, text: str, budget: Column, overlap: Column, out: str = "parts", use: Callable = split) -> DataFrame:
    """rows with an array of the chunks of a text; budget and overlap may differ by row."""
    schema = rows.withColumn(out, F.lit(None).cast("array<string>")).schema
    asked = rows.withColumn("_budget", budget.cast("int")).withColumn("_overlap", overlap.cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index
            parts = [use(t.as_py(), k, o) for t, k, o in zip(b.column(at(text)), b.column(at("_budget")).to_pylist(), b.column(at("_overlap")).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(parts, pa.list_(pa.string()))], names=[*b.schema.names[:-2], out])

    return asked.mapInArrow(run, schema)


def chunk_documents(docs: DataFrame, chunk_size: int = 512, chunk_overlap: int = 64) -> DataFrame:
    """(chunk_id, doc_id, chunk_index, text, source, metadata) of docs (doc_id, text, source_type, metadata map).

    Tokens of the metadata count against the budget. Chats get a header on every chunk. Ids are stable: doc_id and index.
    """
    m = lambda k: F.col("metadata")[k]
    shown = F.array_join(F.transform(F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>"))), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
    budget = F.greatest(F.lit(1), F.lit(chunk_size) - T.token_count(shown))
    parts = with_parts(docs, "text", budget, F.greatest(F.lit(0), F.least(F.lit(chunk_overlap), budget - 1)))
    source = T.first_filled(m("source_url"), m("file_name"), m("file_path"), m("title"))
    header = T.chat_header(m("chat"), m("start_time"), m("end_time"), F.split(F.coalesce(m("participants"), F.lit("")), ","))
    out = parts.select("doc_id", "source_type", "metadata", F.posexplode("parts").alias("chunk_index", "text"))
    text = F.when(F.col("source_type") == "chat", F.concat(header, "text")).otherwise(F.col("text"))
    return out.select(F.concat_ws(":", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", "chunk_index", text.alias("text"), source.alias("source"), "metadata")


def forum_chunks(posts: DataFrame, config: ForumChunks = ForumChunks()) -> DataFrame:
    """Chunks of posts (topic_id, topic_title, post_id, post_number, posted_at, text).

    A post below short_post_tokens comes with the end of the post before it, whatever the size of both; a post within
    max_tokens is a chunk; a longer one is split, and of a diagnostic listing only evenly spaced parts are for dense search.
    """
    c, n = config, T.int_or_zero(F.col("post_number"))
    clean = posts.withColumn("text", T.strip(F.col("text"))).withColumn("topic_title", T.strip(F.col("topic_title"))).withColumn("post_number", n)
    rows = with_previous(clean, "post_id", "post_number", "text").withColumn("tokens", T.token_count(F.col("text")))
    header = F.concat(F.lit("Topic: "), "topic_title", F.lit("\n\nPost #"), F.col("post_number").cast("string"), F.lit(":\n"))
    rows = rows.withColumn("header", header).withColumn("whole", F.concat("header", "text"))
    short, first = F.col("tokens") < c.short_post_tokens, F.col("previous").isNull()
    kind = F.when(short & ~first, "short_with_previous").when(T.token_count(F.col("whole")) > c.max_tokens, F.when(T.is_diagnostic(F.col("text"), c.dump_min_tokens, c.dump_min_lines), "diagnostic_dump_split").otherwise("long_post_split")).when(short, "short_without_previous").otherwise("whole_post")
    rows = rows.withColumn("strategy", kind)
    long = F.col("strategy").isin("diagnostic_dump_split", "long_post_split")
    shared = [F.col("topic_id").cast("string").alias("topic_id"), "topic_title", F.col("post_id").cast("string").alias("post_id"), "post_number", "posted_at", "strategy"]

    def chunk(index: Column, total: Column, sources: Column, text: Column, dense: Column) -> list[Column]:
        return [F.concat_ws(":", F.lit("forum"), "topic_id", "post_id", index).alias("chunk_id"), *shared, index.cast("int").alias("chunk_index"), total.cast("int").alias("chunk_count"), sources.alias("source_post_ids"), text.alias("text"), T.token_count(text).alias("token_count"), dense.alias("index_dense"), F.lit(True).alias("index_lexical")]

    own, zero, one = F.array(F.col("post_id").cast("string")), F.lit(0), F.lit(1)
    plain = rows.where(F.col("strategy").isin("short_without_previous", "whole_post")).select(*chunk(zero, one, own, F.col("whole"), F.lit(True)))
    last = with_parts(rows.where(F.col("strategy") == "short_with_previous").withColumn("before", F.col("previous.text")), "before", F.lit(c.previous_context_tokens), F.lit(0))
    before = F.when(T.token_count(F.col("before")) <= c.previous_context_tokens, F.col("before")).otherwise(F.element_at("parts", -1))
    joined = F.concat(F.lit("Topic: "), "topic_title", F.lit("\n\nPrevious post #"), F.col("previous.post_number").cast("string"), F.lit(":\n"), before, F.lit("\n\nCurrent post #"), F.col("post_number").cast("string"), F.lit(":\n"), "text")
    both = F.array(F.col("previous.post_id").cast("string"), F.col("post_id").cast("string"))
    short_rows = last.select(*chunk(zero, one, both, joined, F.lit(True)))
    budget = F.greatest(F.lit(64), F.lit(c.max_tokens) - T.token_count(F.col("header")) - 8)
    cut = with_parts(rows.where(long), "text", budget, F.least(F.lit(c.overlap_tokens), budget - 1))
    cut = cut.withColumn("total", F.size("parts")).select("*", F.posexplode("parts").alias("i", "part"))
    part = F.concat(F.lit("Topic: "), "topic_title", F.lit("\n\nPost #"), F.col("post_number").cast("string"), F.lit(", part "), (F.col("i") + 1).cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(":\n"), "part")
    dense = (F.col("strategy") == "long_post_split") | F.array_contains(T.representative_indices(F.col("total"), c.dump_dense_chunks), F.col("i"))
    return plain.union(short_rows).union(cut.select(*chunk(F.col("i"), F.col("total"), own, part, dense)))


def chunk_manifest(chunks: DataFrame) -> DataFrame:
    """One row of counts over forum chunks."""
    dump = F.col("strategy") == "diagnostic_dump_split"
    return chunks.agg(
        F.countDistinct("topic_id").alias("topics"), F.countDistinct("post_id").alias("posts"), F.count("*").alias("chunks"), F.countDistinct("chunk_id").alias("chunk_ids"),
        F.count_if("index_dense").alias("dense"), F.count_if("index_lexical").alias("lexical"), F.count_if(dump).alias("dump_chunks"), F.count_if(dump & ~F.col("index_dense")).alias("dump_avoided"),
        F.countDistinct(F.when(dump, F.col("post_id"))).alias("dump_posts"), F.sum("token_count").alias("tokens"),
    ).withColumn("avoided_share", F.round(1 - F.col("dense") / F.col("chunks"), 4))


def strategy_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("strategy").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))


def dump_posts(chunks: DataFrame) -> DataFrame:
    """Per post of a diagnostic listing the chunks kept, embedded and spared."""
    return chunks.where(F.col("strategy") == "diagnostic_dump_split").groupBy("post_id").agg(F.count("*").alias("kept"), F.count_if("index_dense").alias("embedded"), F.count_if(~F.col("index_dense")).alias("avoided"))


def policy_sweep(posts: DataFrame, limits: list[int], config: ForumChunks = ForumChunks()) -> DataFrame:
    """(short_post_tokens, strategy, n, tokens) for each limit."""
    runs = [strategy_counts(forum_chunks(posts, dataclasses.replace(config, short_post_tokens=x))).select(F.lit(x).alias("short_post_tokens"), "strategy", "n", "tokens") for x in limits]
    return reduce(DataFrame.union, runs)


def preview(chunks: DataFrame, per_strategy: int = 25) -> DataFrame:
    """So many chunks of each strategy, in order of a hash of their ids; the limit is the feature."""
    at = F.row_number().over(Window.partitionBy("strategy").orderBy(F.xxhash64("chunk_id"), "chunk_id"))
    return chunks.withColumn("_at", at).where(F.col("_at") <= per_strategy).drop("_at")
