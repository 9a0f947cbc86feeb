"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Within a source every document has the same expected copies, target / source_size (at most 2). Documents
are put in order of size, so that the words taken differ from the target by less than about one document;
the prefix sum of expected copies plus one offset per source crosses as many integers as copies are taken.
Null texts count as empty (size 0, nothing taken), a null source is a source of its own, repeated rows are
documents of their own, an empty table gives no rows, further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import PARTS, WORD, rank_in_group, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(key, source_size, target, offset) from rows (key, source, size). One row per source, so windows without key are small.

    Capped sources are those whose cap per unit of weight lies below the common level; with sources in order of
    that ratio the level is the first one that does not exceed the ratio.
    """
    per = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(by_name) - 1
    weighed = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int")))
    cap = (F.col("source_size") * most).cast("double")
    rising = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        weighed.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("goal", F.sum("source_size").over(every) * share)
        .withColumn("before", F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("goal") - F.col("before")) / F.col("rest"))
        .withColumn("at", F.row_number().over(rising))
        .withColumn("chosen", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("at", "level"))).over(every)["level"])
    )
    digits = F.conv(F.substring(F.md5(F.coalesce(F.col("source"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double")
    target = F.least(F.col("cap"), F.coalesce(F.col("w") * F.col("chosen"), F.col("cap")))
    return level.select("key", "source_size", target.alias("target"), (digits / 4294967296.0).alias("offset"))


def mix(docs: DataFrame, *more: str, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) and the columns `more` for each row of docs (doc_id, text, source)."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    part = F.coalesce(F.pmod("doc_id", F.lit(PARTS)), F.lit(-1))
    sized = docs.select("doc_id", "source", key.alias("key"), size.alias("size"), part.alias("part"), *more)
    targets = source_targets(sized, weights, share, most)
    ranked = rank_in_group(sized, ["key"], ["size", "doc_id"], "part", "rank")
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = lambda i: F.floor(i * F.col("step") + F.col("offset"))
    copies = F.least(F.lit(most), crossed(F.col("rank") + 1) - crossed(F.col("rank")))
    return (
        ranked.join(targets, "key").withColumn("step", step).withColumn("copies", copies.cast("int"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *more)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w, 2.0::DOUBLE * source_size AS cap FROM p),
l AS (SELECT *, cap / w AS ratio, (SELECT sum(source_size) FROM p)::DOUBLE * 1.5::DOUBLE AS goal FROM w),
m AS (SELECT *, (goal - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS pos FROM l),
t AS (SELECT source, source_size, least(cap, coalesce(w * (SELECT arg_min(level, pos) FROM m WHERE level <= ratio), cap)) AS target,
      ('0x' || substr(md5(coalesce(source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS off FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, ((doc_id % 4093) + 4093) % 4093, doc_id) - 1 AS rank FROM s),
c AS (SELECT r.doc_id, r.size, t.source_size, t.target, r.rank, t.off, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS step
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (least(2, floor((rank + 1) * step + off) - floor(rank * step + off)) * size)::BIGINT AS taken FROM c
"""
