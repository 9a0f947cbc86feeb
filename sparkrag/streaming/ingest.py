"""Structured Streaming forms of resumable ingest and chat windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import sinks
from ..operators.threads import continued


def read_json(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """New files of JSON lines in a folder, as they come."""
    return spark.readStream.schema(schema).json(folder)


def append_posts(stream: DataFrame, table: str, checkpoint: str, key: str = "post_id", topic: str = "topic_id") -> None:
    """Adds each post once to a table, with numbers per topic that go on from the stored ones; ends when what is there is read.

    A batch that is tried again finds its posts in the table and adds none twice.
    """

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        at, fs = sinks._at(spark, table)
        new = batch.dropDuplicates([key])
        known = spark.read.parquet(table) if fs.exists(at) else None
        if known is not None:
            new = new.join(known.select(key), key, "left_anti")
        stored = known.select(topic, "post_number") if known is not None else spark.createDataFrame([], f"{topic} string, post_number int")
        continued(new.drop("post_number"), stored, topic, ["posted_at", key]).withColumn("post_number", F.col("post_number").cast("int")).write.mode("append").parquet(table)

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def unique_posts(stream: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """Each key once, with state for `late` only."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def session_windows(stream: DataFrame, key: str, ts: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, last, n) of the sessions of a stream: an event more than `gap` after the one before opens one.

    By time, not by order of arrival; the cap on messages has no streaming form without numbering windows anew.
    """
    by = stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap))
    return by.agg(F.count("*").alias("n"), F.max(ts).alias("last")).select(key, F.col("session_window.start").alias("start"), "last", "n")


def run_to_table(stream: DataFrame, table: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """What a stream gives out by the end of what is there. With mode complete the table is swapped whole."""
    if mode == "complete":
        put = lambda batch, _: sinks.swap(batch, table)
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    else:
        stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(table)


def upsert_sources(spark: SparkSession, chunks: DataFrame, table: str) -> int:
    """Adds chunks (source_id, content_hash, version, ...) whose source has another content than its active version; then puts the active versions in place. Returns the number of sources that changed.

    Chunks of old versions stay until after the new ones are active, and running it again changes nothing.
    """
    at, fs = sinks._at(spark, f"{table}/active")
    now = chunks.groupBy("source_id").agg(F.max(F.struct("version", "content_hash")).alias("v")).select("source_id", "v.*")
    active = spark.read.parquet(f"{table}/active") if fs.exists(at) else None
    changed = now if active is None else now.join(active.select("source_id", "content_hash"), ["source_id", "content_hash"], "left_anti")
    n = changed.count()
    if n:
        chunks.join(changed.select("source_id", "content_hash"), ["source_id", "content_hash"]).write.mode("append").parquet(f"{table}/chunks")
        kept = changed if active is None else active.join(changed.select("source_id"), "source_id", "left_anti").unionByName(changed)
        sinks.swap(kept, f"{table}/active")
    return n


def active_chunks(spark: SparkSession, table: str) -> DataFrame:
    """Chunks of the active versions."""
    active = spark.read.parquet(f"{table}/active").select("source_id", "content_hash")
    return spark.read.parquet(f"{table}/chunks").join(active, ["source_id", "content_hash"])
