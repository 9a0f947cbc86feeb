"""Documents of a folder: plain files, chats, forum posts, articles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from . import chat, forum, wiki

#: Suffixes of plain files.
PLAIN = ("md", "txt", "rst", "py")
#: Suffixes of the other kinds, as patterns of file names.
KINDS = {"chat": "*.{chat,whatsapp}.jsonl", "forum": "*.{forum,briskoda}.jsonl", "wiki": "*.{wiki,wikipedia}.jsonl"}
COLUMNS = ("doc_id", "text", "source_type", "metadata")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def matching(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Files below path, at any depth, whose names match, in order."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return sorted(r[0] for r in rows.select("path").collect())


def plain_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document per plain file; suffixes in any case."""
    glob = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in x) for x in PLAIN) + "}"
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    name, at = F.col("_metadata.file_name"), F.col("_metadata.file_path")
    return raw.select(F.sha2(at, 256).alias("doc_id"), F.col("value").alias("text"), F.lit("file").alias("source_type"), F.create_map(F.lit("file_name"), name, F.lit("file_path"), at).alias("metadata"))


def load_documents(spark: SparkSession, path: str, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, text, source_type, metadata map) of every file of a folder. No folder: FileNotFoundError; no documents: ValueError."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    parts = [plain_documents(spark, path)]
    readers = {"chat": lambda f: chat.load_windows(spark, f, settings.chat_window_minutes, settings.chat_max_messages), "forum": lambda f: forum.load_documents(spark, f), "wiki": lambda f: wiki.load_documents(spark, f)}
    for kind, reader in readers.items():
        parts += [reader(f) for f in matching(spark, path, KINDS[kind])]
    docs = reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])
    if docs.isEmpty():
        raise ValueError(f"no documents below {path}")
    return docs
