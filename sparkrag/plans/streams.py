"""Queries: streams run over what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sinks import scratch
from ..streaming import ingest as I
from .registry import query, table


@query("""WITH b AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL 10 MINUTE, true)::INT AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM b)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*)::BIGINT AS n FROM s GROUP BY user_id, s""")
def session_stream(spark, sf_dir):
    """Sessions of the events as a stream; a gap of ten minutes by time closes one."""
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = I.run_to_table(I.session_windows(stream, "user_id", "ts"), scratch(spark, "sessions"), scratch(spark, "checkpoint"), "complete")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"), "n")


@query("SELECT conv_id::VARCHAR AS topic_id, conv_id || '-' || turn AS post_id, (row_number() OVER (PARTITION BY conv_id ORDER BY printf('%05d', turn)))::INT AS post_number FROM conversations")
def resumed_ingest(spark, sf_dir):
    """Conversations as a stream of posts, taken in twice: each post once, numbered per topic."""
    path = f"{sf_dir}/conversations.parquet"
    out = scratch(spark, "posts")
    for _ in range(2):
        stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
        posts = stream.select(F.col("conv_id").cast("string").alias("topic_id"), F.concat_ws("-", "conv_id", "turn").alias("post_id"), F.format_string("%05d", F.col("turn").cast("int")).alias("posted_at"), F.lit(0).alias("post_number"))
        I.append_posts(posts, out, scratch(spark, "checkpoint"))
    return spark.read.parquet(out).select("topic_id", "post_id", "post_number")
