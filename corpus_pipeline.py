"""Corpus pipeline: quality rules, near duplicates, decontamination, mixing, token output.

Each stage keeps the columns of its input, whatever their names. Null and repeated ids are rows of their own; null and
empty texts fail the quality rules; equal texts are near copies of each other, and as input of a later stage alone they
are leaked and mixed alike. Empty tables pass through. Folders that a stage wrote go once its result is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrag.llm import near_copies, op1_mix, op3_tokens, op8_rules, op10_decontaminate
from sparkrag.llm.common import mark, release, shared_dir, table


def whole(docs: DataFrame, *more: Column) -> DataFrame:
    """docs as one column `row`, so that no name clashes, with further columns."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule policy keeps."""
    judged = op8_rules.ledger(whole(docs, F.col("text")))
    return judged.where(~op8_rules.fails("v1")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts at a five-word similarity of 0.8 or more."""
    return near_copies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; ids may be null or repeated, so texts are searched under their key."""
    keyed = docs.select(near_copies.text_key().alias("doc_id"), "text")
    found = op10_decontaminate.leaks(keyed, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("k")).distinct()
    return whole(docs, near_copies.text_key().alias("k")).join(found, "k", "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; rows of equal text, id and source stand for each other."""
    by = [near_copies.text_key().alias("k"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("d"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-")).alias("s")]
    names = ["k", "d", "s"]
    keyed = docs.select(F.col("text"), F.col("source"), *by).select(F.struct("k", "d", "s").alias("id"), F.xxhash64("k", "d").alias("doc_id"), "text", "source")
    taken = op1_mix.mix(keyed, "id").where("copies > 0").groupBy("id").agg(F.sum("copies").cast("int").alias("copies")).select("id.*", "copies")
    one = whole(docs, *by).join(taken, names).dropDuplicates(names)
    return one.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold, per document."""
    return op3_tokens.encode_and_read(docs, op3_tokens.default_tokenizer())


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("token_output", tokens)]

#: Near copies, latent retrieval and tokenization have no SQL form; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, start = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = shared_dir(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        release(spark, start, path)
    return docs
