"""JSON lines with an explicit schema, checked on read; errors name file and line, never content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Columns of schema, and `_file`, `_line` (from 1), `_bad` (not JSON). Blank lines go."""
    full = StructType([*schema.fields, StructField("_bad", StringType())])
    # The whole text of a file is split, so that lines have numbers; a file is a unit of work.
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), F.posexplode(F.split("value", "\r?\n", -1)).alias("_at", "_text"))
    parsed = raw.where(~F.col("_text").rlike(r"^\s*$")).withColumn("r", F.from_json("_text", full, {"columnNameOfCorruptRecord": "_bad"}))
    return parsed.select("r.*", "_file", (F.col("_at") + 1).alias("_line"))


def checked(rows: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    """rows, or an error at the first rule that a row breaks: not JSON, or the rule's text, with file and line."""
    broken = F.lit(None).cast("string")
    for kept, says in reversed(((F.col("_bad").isNull(), "invalid JSON"), *rules)):
        broken = F.when(~F.coalesce(kept, F.lit(False)), F.lit(says)).otherwise(broken)
    where = F.concat(broken, F.lit(" on "), "_file", F.lit(":"), F.col("_line").cast("string"))
    stop = F.when(broken.isNotNull(), F.raise_error(where)).otherwise(F.lit(True))
    return rows.where(stop).drop("_bad")


def unique(rows: DataFrame, key: str, says: str) -> DataFrame:
    """rows; raises ValueError if a value of key repeats."""
    again = rows.groupBy(key).count().where("count > 1").select(key).limit(5).collect()
    if again:
        raise ValueError(f"{says}: {[r[0] for r in again]}")
    return rows
