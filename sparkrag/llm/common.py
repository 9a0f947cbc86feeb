"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Ties of one key are numbered in so many parts, each in a task of its own.
PARTS = 4093


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the words of a text; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


#: Called to drop what a worker process remembers from task to task of one stage.
forgetting: list[Callable[[], None]] = []


def give_back() -> None:
    """Memory that was freed goes back to the system; where the C library has no way to, only Arrow's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def forget() -> None:
    for drop in forgetting:
        drop()
    give_back()


def lean(run):
    """`run`, for mapInArrow, in a worker that may come from another stage and go to one: that stage's memory is dropped first, freed memory given back last."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from run(batches)
        give_back()

    return task


#: Shared folders made so far, in order; `release` deletes them.
_made: list[str] = []


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder, as URI of the file system that the session gives to it, below spark.checkpoint.dir; where that is unset (tests), below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    at, fs = _file_system(spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    uri = fs.makeQualified(at).toString()
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri.removeprefix("file:")
    _made.append(uri)
    return uri


def mark() -> int:
    """To hand to `release`."""
    return len(_made)


def release(spark: SparkSession, since: int, keep: str) -> None:
    """Deletes the shared folders made since a mark, but for `keep`: for when no table read from them is needed any more."""
    for path in _made[since:]:
        if path != keep:
            at, fs = _file_system(spark, path)
            fs.delete(at, True)
    _made[since:] = [keep]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_hot(rows: DataFrame, classes: DataFrame, key: str, most: int = 1000, counted: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """rows joined with classes, whose key is unique. Keys of rows that hold more than a `most`-th of them are fewer than `most`,
    so their classes are broadcast and their rows stay where they are; the others are joined by shuffling. Both sides are read more than once: store them,
    or give as `counted` a stored table with the keys of all rows."""
    keys = rows if counted is None else counted
    n = keys.count()
    hot = [r[0] for r in keys.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > max(n // most, 100)).where(F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return rows.join(classes, key, how)
    at = F.col(key).isin(hot)
    return rows.where(at).join(F.broadcast(classes.where(at)), key, how).unionByName(rows.where(~at).join(classes.where(~at), key, how))


def rank_in_group(df: DataFrame, group: list[str], order: list[str], part: str, out: str) -> DataFrame:
    """Adds `out`: the 0-based rank of each row of `group` by (order, part), a gapless number.

    No group need fit a task: rows are numbered within (group, order[0], part) only, and prefix sums
    run over counts of those cells. The columns of `group` and `order[0]` must not be null.
    """
    lead, cell = [*group, order[0]], [*group, order[0], part]
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(*cell).orderBy(*order[1:])))
    cells = df.groupBy(*cell).agg(F.count("*").alias("_c"))
    wide = cells.groupBy(*lead).agg(F.sum("_c").alias("_s"))
    base = wide.select(*lead, (F.sum("_s").over(Window.partitionBy(*group).orderBy(order[0]).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).alias("_b"))
    inner = cells.select(*cell, (F.sum("_c").over(Window.partitionBy(*lead).orderBy(part).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_i"))
    offsets = inner.join(base, lead).select(*cell, (F.col("_b") + F.col("_i")).alias("_o"))
    return numbered.join(offsets, cell).withColumn(out, F.col("_o") + F.col("_n") - 1).drop("_n", "_o")
