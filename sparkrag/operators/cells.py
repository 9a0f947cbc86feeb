"""Numbers and quantiles of a long order without one task that sees all of it.

A numeric order column is cut in cells of `span`; rows are numbered or summed inside a cell, and windows without a bound run over
one row per cell only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1 << 16


def cell_of(order: str, span: float) -> Column:
    return F.floor(F.coalesce(F.col(order), F.lit(0)) / span)


def numbered(rows: DataFrame, order: str, out: str, ties: list[str] = (), group: list[str] = (), span: float = SPAN) -> DataFrame:
    """rows with `out`: 1-based number by (order, ties) within group."""
    group, celled = list(group), rows.withColumn("_cell", cell_of(order, span))
    counts = celled.groupBy(*group, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*group, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(*group, "_cell").orderBy(order, *ties))
    return celled.withColumn("_in", inside).join(base, [*group, "_cell"]).withColumn(out, F.col("_base") + F.col("_in")).drop("_cell", "_in", "_base")


def ordered_values(rows: DataFrame, group: str, value: str, wanted: dict[str, Column], span: float) -> DataFrame:
    """(group, n, names of wanted): the values at 1-based ranks, given as columns over n, the rows of a group; null values do not count.

    Only the cells that hold a wanted rank are put in order, so no group is sorted or held whole.
    """
    celled = rows.where(F.col(value).isNotNull()).select(group, value, cell_of(value, span).alias("_cell"))
    counts = celled.groupBy(group, "_cell").agg(F.count("*").alias("c"))
    by = Window.partitionBy(group)
    upto = F.sum("c").over(by.orderBy("_cell"))
    ranked = counts.withColumn("n", F.sum("c").over(by)).withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("c"))
    targets = ranked.select(group, "_cell", "n", "lo", "hi", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.cast("bigint").alias("rank")) for k, v in wanted.items()])).alias("t"))
    hit = targets.where("t.rank > lo AND t.rank <= hi").select(group, "_cell", "n", "t.name", (F.col("t.rank") - F.col("lo")).alias("at"))
    inside = celled.join(hit.select(group, "_cell").distinct(), [group, "_cell"]).withColumn("at", F.row_number().over(Window.partitionBy(group, "_cell").orderBy(value)))
    found = inside.join(hit, [group, "_cell", "at"])
    return found.groupBy(group, "n").agg(*[F.max(F.when(F.col("name") == k, F.col(value))).alias(k) for k in wanted])
