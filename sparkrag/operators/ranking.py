"""Vector search in blocks, fusion, collapsing, reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

#: Vectors of the index and of the query set that are multiplied at once.
ROWS, QUERIES = 2048, 256


def _packed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, size):
                part = b.slice(i, size)
                vecs = part.column(1).flatten()
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (part.column(0), vecs)], ["ids", "vecs"])

    return run


def top(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the k highest of each row, in that order; of equal ones the first columns."""
    if k < 1 or not scores.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    low = -scores
    i, j = np.nonzero(~(low > np.partition(low, k - 1, axis=1)[:, [k - 1]]) if k < scores.shape[1] else np.ones(scores.shape, bool))
    order = np.lexsort((j, low[i, j], i))
    i, j = i[order], j[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    i, j = i[kept], j[kept]
    return i, j, scores[i, j]


def _best(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, vecs, qids, qvecs = (b.column(c)[r].values.to_numpy() for c in range(4))
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                m = vecs.reshape(len(ids), -1)[order].astype(np.float64)
                i, j, score = top(np.round(qvecs.reshape(len(qids), -1).astype(np.float64) @ m.T, 6), k)
                yield pa.RecordBatch.from_arrays([pa.array(qids[i], pa.int64()), pa.array(ids[j], pa.int64()), pa.array(score, pa.float64())], ["query_id", "id", "score"])

    return run


def _celled(size: int):
    """Blocks (cell, ids, vecs) of rows (id, vec, cell), of one cell each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = np.argsort(b.column(2).to_numpy(), kind="stable")
            b = b.take(pa.array(order))
            cells = b.column(2).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else []
            for lo, hi in zip(starts, [*starts[1:], len(cells)]):
                for i in range(lo, hi, size):
                    part = b.slice(i, min(size, hi - i))
                    ids, vecs = part.column(0), part.column(1).flatten()
                    yield pa.RecordBatch.from_arrays([part.column(2).slice(0, 1), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, vecs))], ["cell", "ids", "vecs"])

    return run


def _probing(size: int):
    """Blocks (qids, qvecs, qcells) of rows (query_id, qvec, cells), all with as many cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, size):
                part = b.slice(i, size)
                parts = part.column(0), part.column(1).flatten(), part.column(2).flatten()
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in parts], ["qids", "qvecs", "qcells"])

    return run


def probed_top_k(index: DataFrame, queries: DataFrame, k: int, decoded: Callable = lambda vecs, rows, cell: vecs.reshape(rows, -1)) -> DataFrame:
    """(query_id, id, score, rank): index (id, vec, cell) searched by queries (query_id, qvec, cells), each in its cells only.

    Blocks of one cell meet blocks of queries, so no pair of vectors is a row and no cell is one task's; decoded(vecs, rows, cell)
    makes vectors of what the index holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                cell = b.column(0)[r].as_py()
                ids, vecs, qids, qvecs, qcells = (b.column(c)[r].values.to_numpy() for c in range(1, 6))
                asks = (qcells.reshape(len(qids), -1) == cell).any(axis=1)
                if asks.any():
                    order = np.argsort(ids, kind="stable")
                    x = decoded(vecs, len(ids), cell)[order].astype(np.float64)
                    q = qvecs.reshape(len(qids), -1)[asks].astype(np.float64)
                    i, j, score = top(np.round(q @ x.T, 6), k)
                    yield pa.RecordBatch.from_arrays([pa.array(qids[asks][i], pa.int64()), pa.array(ids[order][j], pa.int64()), pa.array(score, pa.float64())], ["query_id", "id", "score"])

    kind = index.schema["vec"].dataType.simpleString()
    left = index.mapInArrow(_celled(ROWS), f"cell int, ids array<bigint>, vecs {kind}")
    right = queries.mapInArrow(_probing(QUERIES), "qids array<bigint>, qvecs array<float>, qcells array<int>")
    best = left.crossJoin(F.broadcast(right)).mapInArrow(run, "query_id bigint, id bigint, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def dense_top_k(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): exact search of index (id, vec) with a stated query set (query_id, qvec) of any size.

    Each block of queries meets each block of the index, and the k best of each meeting are ranked. Null vectors have no
    score and go; k below 1 gives no rows.
    """
    kind = "array<bigint>", "array<float>"
    left = index.where("vec IS NOT NULL").select(F.col("id").cast("long"), "vec").mapInArrow(_packed(ROWS), "ids {}, vecs {}".format(*kind))
    right = queries.where("qvec IS NOT NULL").select(F.col("query_id").cast("long"), "qvec").mapInArrow(_packed(QUERIES), "ids {}, vecs {}".format(*kind)).toDF("qids", "qvecs")
    best = left.crossJoin(right).mapInArrow(_best(max(k, 0)), "query_id bigint, id bigint, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def fuse_lists(lists: DataFrame, k: int = 60, top_k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of result lists (query_id, list_idx, id, rank), rank from 0: (query_id, id, score, rank from 1).

    An id that repeats in a list counts as often. Equal scores keep the order in which ids are first seen, list by list.
    """
    if k < 1:
        raise ValueError("k must be positive")
    sums = lists.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list_idx", "rank")).alias("_seen"))
    by = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "_seen")
    out = sums.withColumn("rank", F.row_number().over(by)).drop("_seen")
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def fuse_ids(lists: DataFrame, k: int = 60, top_k: int | None = None) -> DataFrame:
    """Fusion of id lists (query_id, list_idx, id, rank), rank from 1, repeats in a list ignored: (query_id, id, score, best_rank, rank); ties by best rank, then id."""
    if k < 1:
        raise ValueError("k must be positive")
    first = lists.groupBy("query_id", "list_idx", "id").agg(F.min("rank").alias("rank"))
    sums = first.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min("rank").alias("best_rank"))
    by = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "best_rank", "id")
    out = sums.withColumn("rank", F.row_number().over(by))
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def collapse(ranked: DataFrame, parents: DataFrame, parent: str = "post_id") -> DataFrame:
    """(query_id, parent, rank): chunks (query_id, id, rank) as their posts of parents (id, parent), the first of each kept, ranked anew."""
    best = ranked.join(parents.select("id", parent), "id").groupBy("query_id", parent).agg(F.min("rank").alias("_at"))
    return best.select("query_id", parent, F.row_number().over(Window.partitionBy("query_id").orderBy("_at", parent)).alias("rank"))


def missing_parents(ranked: DataFrame, parents: DataFrame) -> DataFrame:
    """Ranked ids that parents lack."""
    return ranked.select("id").distinct().join(parents.select("id"), "id", "left_anti")


def rerank(found: DataFrame, score: Callable | None = None, top_k: int | None = None) -> DataFrame:
    """found (query_id, question, id, text, rank) by a new score: a vectorised function of two lists (questions, texts), by default the share of the question's tokens that the text holds. Ties keep their rank."""
    if score is None:
        asked = F.array_distinct(tokens(F.col("question")))
        new = F.size(F.array_intersect(asked, tokens(F.col("text")))) / F.greatest(F.size(asked), F.lit(1))
    else:
        @F.pandas_udf("double")
        def scored(q, t):
            import pandas as pd

            return pd.Series(score(q.tolist(), t.tolist()), dtype="float64")

        new = scored("question", "text")
    rows = found.withColumn("score", new)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("_was"))
    out = rows.withColumnRenamed("rank", "_was").withColumn("rank", F.row_number().over(by)).drop("_was")
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def side_by_side(lists: DataFrame, names: list[str]) -> DataFrame:
    """(query_id, id, a rank per list name) of lists (query_id, name, id, rank); null where a list lacks the id."""
    return lists.groupBy("query_id", "id").pivot("name", names).agg(F.min("rank"))
