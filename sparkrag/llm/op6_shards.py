"""Sharding by Karmarkar-Karp differencing, law `bytes`: shard sizes near equal, equal texts kept together.

Groups of equal texts are indivisible. They are dealt by hash into cells of about CELL groups; in each cell
differencing combines the partial partitions of largest spread, oppositely ordered, until one is left; the same
differencing then combines the partitions of FAN cells, and of FAN of those, in a tree on the executors. A group that
alone exceeds an even share of what is left gets a shard to itself first (the driver sees those alone, less than
SHARDS). Members of groups take their group's shard by a join in which frequent groups are broadcast.

A null text counts as empty (16 bytes) and groups with empty texts; repeated rows are rows of their own; fewer
groups than shards leave shards empty; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PARTS, join_hot, rank_in_group, stored, table

SHARDS = 40
CELL = 20000
FAN = 256
ROW_BYTES = 16


def difference(partitions: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Combines partitions, each of k sums; returns the k sums and, per partition, the place that each sum went to."""
    if not partitions:
        return [], []
    k, nodes = len(partitions[0]), []
    heap = []
    for i, sums in enumerate(partitions):
        heap.append((min(sums) - max(sums), i, sums))
        nodes.append(None)
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a, x), (_, b, y) = heapq.heappop(heap), heapq.heappop(heap)
        down = sorted(range(k), key=lambda j: (-x[j], j))
        up = sorted(range(k), key=lambda j: (y[j], j))
        sums = [x[i] + y[j] for i, j in zip(down, up)]
        to_a, to_b = [0] * k, [0] * k
        for place, (i, j) in enumerate(zip(down, up)):
            to_a[i], to_b[j] = place, place
        nodes.append((a, to_a, b, to_b))
        heapq.heappush(heap, (min(sums) - max(sums), len(nodes) - 1, sums))
    _, top, sums = heap[0]
    places: list = [None] * len(nodes)
    places[top] = list(range(k))
    for n in range(len(nodes) - 1, len(partitions) - 1, -1):
        a, to_a, b, to_b = nodes[n]
        places[a] = [places[n][p] for p in to_a]
        places[b] = [places[n][p] for p in to_b]
        places[n] = None
    return sums, places[: len(partitions)]


def balance(groups: DataFrame, shards: int = SHARDS, per_cell: int = CELL) -> DataFrame:
    """groups (gid string, bytes long), gid unique, with the column shard."""
    spark = groups.sparkSession
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    # At most shards groups can exceed an even share.
    large = groups.where(F.col("bytes") > total / shards).orderBy(F.desc("bytes"), "gid").limit(shards).collect()
    own: dict[str, int] = {}
    for r in large:
        if len(own) < shards - 1 and r["bytes"] * (shards - len(own)) > total:
            total -= r["bytes"]
            own[r["gid"]] = len(own)
    k, cells = shards - len(own), max(1, -(-n // per_cell))
    rest = groups.where(~F.col("gid").isin(list(own))) if own else groups

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "gid"], ascending=[False, True], ignore_index=True)
        sums, places = difference([[int(x)] + [0] * (k - 1) for x in pdf["bytes"]])
        return pd.DataFrame({"cell": pdf["cell"], "gid": pdf["gid"], "bytes": pdf["bytes"], "place": [p[0] for p in places]})

    celled = rest.withColumn("cell", F.pmod(F.xxhash64("gid"), F.lit(cells)))
    placed = stored(celled.groupBy("cell").applyInPandas(cell, "cell bigint, gid string, bytes bigint, place int"), "cells")

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf["cell"].unique())
        at = {c: i for i, c in enumerate(names)}
        sums = [[0] * k for _ in names]
        for c, p, x in zip(pdf["cell"], pdf["place"], pdf["bytes"]):
            sums[at[c]][p] = int(x)
        _, places = difference(sums)
        rows = [(c, p, c // FAN, places[i][p], sums[i][p]) for i, c in enumerate(names) for p in range(k)]
        return pd.DataFrame(rows, columns=["cell", "place", "parent", "to", "bytes"])

    # Partitions of FAN cells are combined by the same differencing, level by level, until one is left.
    levels, sums = [], placed.groupBy("cell", "place").agg(F.sum("bytes").alias("bytes"))
    while cells > 1:
        up = sums.withColumn("parent", F.floor(F.col("cell") / FAN)).groupBy("parent").applyInPandas(combine, "cell bigint, place int, parent bigint, to int, bytes bigint")
        levels.append(stored(up, "level"))
        sums = levels[-1].groupBy(F.col("parent").alias("cell"), F.col("to").alias("place")).agg(F.sum("bytes").alias("bytes"))
        cells = -(-cells // FAN)
    for up in reversed(levels[:-1]):
        top = levels.pop().select(F.col("cell").alias("parent"), F.col("place").alias("to"), F.col("to").alias("end"))
        levels[-1] = up.join(top, ["parent", "to"]).select("cell", "place", F.col("end").alias("to"))
    if levels:
        placed = placed.join(levels[0].select("cell", "place", "to"), ["cell", "place"]).select("gid", F.col("to").alias("place"))
    heavy = spark.createDataFrame(list(own.items()), "gid string, shard int")
    return placed.select("gid", (F.col("place") + len(own)).cast("int").alias("shard")).union(heavy)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("gid"))
    rows = stored(rows, "sizes")
    groups = rows.groupBy("gid").agg(F.sum("size").alias("bytes"))
    placed = join_hot(rows, stored(balance(groups, shards), "shards"), "gid")
    part = F.pmod(F.coalesce("doc_id", F.lit(-1)), F.lit(PARTS))
    ranked = rank_in_group(placed.withColumn("part", part).withColumn("zero", F.lit(0)), ["shard"], ["zero", "doc_id"], "part", "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
