"""Writers: JSON lines, tables swapped in whole, appended tables, reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, put in place by renaming."""
    at, fs = _at(spark, path)
    new, _ = _at(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(at, False)
    if not fs.rename(new, at):
        raise OSError("a written file could not be put in place")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, None if it does not exist."""
    at, fs = _at(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def swap(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """df in place of what path holds; readers see the old or the new, as renaming goes on the file system."""
    spark, new = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    df.write.format(kind).save(new)
    at, fs = _at(spark, path)
    fs.delete(at, True)
    if not fs.rename(_at(spark, new)[0], at):
        raise OSError("a written table could not be put in place")


def write_jsonl(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines, in order over the files if columns are named."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Adds the rows of df whose key the table at path lacks, one per key; returns their number."""
    spark = df.sparkSession
    at, fs = _at(spark, path)
    new = df.dropDuplicates([key])
    if fs.exists(at):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    before = spark.read.parquet(path).count() if fs.exists(at) else 0
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def write_state(spark: SparkSession, path: str, state: dict) -> None:
    write_text(spark, path, json.dumps(state, ensure_ascii=False, indent=2, sort_keys=True) + "\n")


def read_state(spark: SparkSession, path: str, default: dict | None = None) -> dict:
    raw = read_text(spark, path)
    return default or {} if raw is None else json.loads(raw)


def write_report(df: DataFrame, path: str) -> None:
    """A table of results as JSON lines in one file; for a row per configuration or query."""
    df.coalesce(1).write.mode("overwrite").json(path)


def with_digest(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("sha256", F.sha2(text, 256))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir, or the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
