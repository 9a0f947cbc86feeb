"""Queries: citations, context, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Settings
from ..embed import Hashing
from ..functions import text as T
from ..generate import Engine
from ..sinks import scratch
from .registry import query, table

ANSWER = "'see [' || turn || ', ' || conv_id || ',] and [ 1 ] or [2 3] not [a] [99999999999999999999] ' || coalesce(text, '')"


@query(rf"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(flatten(list_transform(regexp_extract_all({ANSWER}, '\[([\d,\s]+)\]', 1), lambda g: regexp_extract_all(g, '\d+'))), lambda x: try_cast(x AS BIGINT)), lambda m: m BETWEEN 1 AND 4))), ',') AS cited FROM conversations")
def citation_extract(spark, sf_dir):
    """Markers of four passages in every turn, with some written around it."""
    answer = F.concat(F.lit("see ["), F.col("turn").cast("string"), F.lit(", "), F.col("conv_id").cast("string"), F.lit(",] and [ 1 ] or [2 3] not [a] [99999999999999999999] "), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.citations(answer, F.lit(4)).cast("array<string>"), ",").alias("cited"))


@query("SELECT conv_id, string_agg('[' || pos || '] (source: ' || role || ')' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY pos) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations) GROUP BY conv_id")
def numbered_context(spark, sf_dir):
    """Turns as numbered passages of their conversation."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("source"), F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    return rows.select("conv_id", T.context(F.col("p")).alias("context"))


@query("SELECT conv_id, turn, NOT contains(coalesce(text, 'INSUFFICIENT_CONTEXT'), 'INSUFFICIENT_CONTEXT') AS grounded, 'Context passages:' || chr(10) || chr(10) || role || chr(10) || chr(10) || 'Question: ' || turn || chr(10) || chr(10) || 'Answer:' AS prompt FROM conversations")
def grounding_and_prompts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.grounded(F.coalesce("text", F.lit(T.INSUFFICIENT))).alias("grounded"), T.prompt(F.col("role"), F.col("turn").cast("string")).alias("prompt"))


@query()
def rag_answers(spark, sf_dir):
    """Every benchmark item as a question: hybrid retrieval over all documents, extractive answers with citations."""
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.col("doc_id").cast("string").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"), T.first_filled(F.col("source")).alias("source")).where("text RLIKE '(?i)[a-z0-9]'")
    engine = Engine.ingest(spark, scratch(spark, "engine"), chunks, Hashing(64), Settings(retrieval_mode="hybrid"))
    items = table(spark, sf_dir, "benchmark").where("text RLIKE '(?i)[a-z0-9]'").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return engine.query_batch(items)
