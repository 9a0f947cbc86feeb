"""Labelled queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERY = "struct<id:string,question:string,q:string,topic_id:string,kind:string,source:string,relevant_post_ids:array<string>,relevant_titles:array<string>>"


def load(spark: SparkSession, path: str, labels: str = "relevant_post_ids") -> DataFrame:
    """(ordinal, query_id, question, labels, topic_id, kind) of a JSON file; queries need an id of their own, a question and labels."""
    rows = spark.read.schema(f"queries array<{QUERY}>").json(path, multiLine=True).select(F.posexplode("queries").alias("ordinal", "q"))
    wanted = F.array(F.col("q.source")) if labels == "source" else F.col(f"q.{labels}")
    rows = rows.select("ordinal", F.coalesce("q.id", F.col("ordinal").cast("string") if labels == "source" else F.lit(None)).alias("query_id"), F.coalesce("q.question", "q.q").alias("question"), wanted.alias("labels"), "q.topic_id", "q.kind")
    bad = (F.coalesce("query_id", F.lit("")) == "") | (F.coalesce("question", F.lit("")) == "") | (F.coalesce(F.size("labels"), F.lit(0)) < 1)
    n, broken, names = rows.agg(F.count("*"), F.count_if(bad), F.countDistinct("query_id")).first()
    if not n or broken or names < n:
        raise ValueError(f"{n} queries, of which {broken} lack id, question or labels; {names} different ids")
    return rows
