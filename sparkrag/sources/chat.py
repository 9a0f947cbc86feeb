"""Chat exports: archives, parsing, anonymising, windows."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..operators.threads import aliases, sessions, window_documents
from . import jsonl

#: A message's first line, and any line with a time (else a system event), in Java syntax; times, day first.
HEADER = r"^\[(\d{1,2}/\d{1,2}/\d{2,4}),\s+([^\]]+)\]\s+([^:]+):\s?(.*)$"
TIMED = r"^\[\d{1,2}/\d{1,2}/\d{2,4},\s+[^\]]+\]\s+"
DAYS, TIMES = ("d/M/yy", "d/M/yyyy"), ("h:mm:ss a", "H:mm:ss", "h:mm a", "H:mm")
MESSAGE = StructType([StructField(x, StringType()) for x in ("id", "chat", "timestamp", "sender", "text")])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, text) of ZIP files that hold one .txt member each; another number of them is an error."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    members = [x for x in z.namelist() if x.endswith(".txt")]
                    if len(members) != 1:
                        raise ValueError(f"expected one .txt member, found {len(members)}")
                    data = z.read(members[0])
                rows.append({"path": name, "sha256": hashlib.sha256(data).hexdigest(), "text": data.decode("utf-8-sig")})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, pa.string()) for c in ("path", "sha256", "text")]))

    return raw.mapInArrow(run, "path string, sha256 string, text string")


def parsed_time(day: Column, time: Column) -> Column:
    """Timestamp of a day-first date and a time with or without seconds and AM or PM; else an error."""
    clean = F.upper(T.strip(F.translate(time, "\u202f\u00a0", "  ")))
    value = F.concat(day, F.lit(", "), clean)
    tried = [F.try_to_timestamp(value, F.lit(f"{d}, {t}")).cast("timestamp_ntz") for t in TIMES for d in DAYS]
    return F.coalesce(*tried, F.when(F.lit(True), F.raise_error(F.lit("unsupported chat timestamp"))).cast("timestamp_ntz"))


def parse_messages(exports: DataFrame, key: str = "path") -> DataFrame:
    """(key, ordinal, timestamp, sender, text) of exports (key, text): ordinal from 1; lines without a header go on with the message before; system events end it."""
    rows = exports.select(key, F.posexplode(T.lines(F.col("text"))).alias("at", "line"))
    start = F.regexp_replace("line", "^[\u200e\u200f]+", "")
    rows = rows.withColumn("start", start).withColumn("head", F.col("start").rlike("(?s)" + HEADER)).withColumn("timed", F.col("start").rlike(TIMED))
    by = Window.partitionBy(key).orderBy("at")
    rows = rows.withColumn("part", F.sum((F.col("head") | F.col("timed")).cast("int")).over(by))
    heads = rows.where("head").select(key, "part", *[F.regexp_extract("start", "(?s)" + HEADER, i).alias(x) for i, x in enumerate(("day", "time", "sender", "first"), 1)])
    body = rows.where("part > 0 AND NOT timed").groupBy(key, "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("more"))
    whole = heads.join(body, [key, "part"], "left")
    text = T.strip(F.concat_ws("\n", "first", "more"))
    at = F.row_number().over(Window.partitionBy(key).orderBy("part"))
    return whole.select(key, at.alias("ordinal"), parsed_time(F.col("day"), F.col("time")).alias("timestamp"), T.strip(F.col("sender")).alias("sender"), text.alias("text"))


def prepare(messages: DataFrame, chat: str) -> tuple[DataFrame, DataFrame]:
    """Anonymised messages (id, chat, timestamp, sender, text, ordinal) of one export, and a report of one row.

    Aliases go by first appearance and ids by place, both before deleted and empty messages go. The senders of one chat are
    few; the driver makes one pattern of their names.
    """
    names = [r[0] for r in messages.select("sender").distinct().collect()]
    if not names:
        raise ValueError("no chat messages were parsed")
    rows = messages.join(aliases(messages, "sender", "ordinal"), "sender").withColumn("clean", T.redact(F.col("text"), names)).withColumn("deleted", T.is_deleted(F.col("text")))
    kept = rows.where("NOT deleted AND clean <> ''").select(F.format_string("msg_%06d", "ordinal").alias("id"), F.lit(chat).alias("chat"), T.iso(F.col("timestamp")).alias("timestamp"), F.col("alias").alias("sender"), F.col("clean").alias("text"), "ordinal")
    written = ~F.col("deleted") & (F.col("clean") != "")
    at = F.when(written, T.iso(F.col("timestamp")))
    report = rows.agg(
        F.count("*").alias("parsed_messages"), F.count_if(written).alias("written_messages"), F.countDistinct("sender").alias("participants"), F.count_if("deleted").alias("skipped_deleted"),
        F.count_if(~F.col("deleted") & (F.col("clean") == "")).alias("skipped_empty"), F.min_by(at, F.when(written, F.col("ordinal"))).alias("first_timestamp"), F.max_by(at, F.when(written, F.col("ordinal"))).alias("last_timestamp"),
    )
    return kept, report.select(F.lit(chat).alias("chat"), "*")


def load_windows(spark: SparkSession, path: str, minutes: int = 10, most: int = 20) -> DataFrame:
    """Documents of the windows of an anonymised chat file, in file order."""
    rows = jsonl.checked(jsonl.read(spark, path, MESSAGE)).withColumn("ordinal", F.col("_line").cast("long")).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).withColumn("one", F.lit(1))
    docs = window_documents(sessions(rows, "one", "timestamp", "ordinal", f"{minutes} minutes", most).withColumn("chat", F.col("chat")), "one")
    names = rows.agg(F.min_by("chat", "ordinal").alias("chat"), F.first("_file").alias("file"))
    d = docs.crossJoin(F.broadcast(names))
    source = F.concat("chat", F.substring("name", 2, 1 << 20))
    meta = F.create_map(F.lit("file_name"), source, F.lit("file_path"), "file", F.lit("chat"), "chat", F.lit("start_time"), "start_time", F.lit("end_time"), "end_time", F.lit("participants"), F.array_join("participants", ","), F.lit("message_ids"), F.array_join("message_ids", ","))
    return d.select(source.alias("doc_id"), "text", F.lit("chat").alias("source_type"), meta.alias("metadata"))
