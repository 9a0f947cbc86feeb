"""Stored vector indexes: exact, inverted lists, product codes, and a hashing substitute for graph search.

An index is a folder: `vectors` (ordinal, chunk_id, text, source, metadata, embedding, cell), a small table of centroids where
the type has them, `meta.json` and `embedding.json`. Inner products of unit vectors are cosines, for every type.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..embed import Provider
from ..operators.cells import numbered
from ..operators.ranking import dense_top_k, probed_top_k
from ..sources.files import exists

#: Parameters of the index types and their defaults.
PARAMS = {"nlist": 100, "nprobe": 8, "hnsw_m": 32, "hnsw_ef_construction": 200, "hnsw_ef_search": 64, "pq_m": 48, "pq_nbits": 8}
TYPES, BACKENDS = ("flat", "ivf", "hnsw", "ivfpq"), ("parquet", "faiss", "qdrant", "opensearch")
#: Vectors that centroids and codebooks are fitted on at most; every vector is indexed.
FIT = 100_000


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids by spherical k-means; fewer rows than k give as many centroids."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].astype(np.float64)
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(n > 0, sums / np.maximum(n, 1e-12), c)
    return c


def codebooks(x: np.ndarray, m: int, bits: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """(m, 2^bits, dim / m) centres of the slices of x, by Euclidean k-means."""
    rng, size = np.random.default_rng(seed), x.shape[1] // m
    books = np.zeros((m, min(1 << bits, len(x)), size))
    for j in range(m):
        s = x[:, j * size : (j + 1) * size].astype(np.float64)
        c = s[rng.permutation(len(s))[: books.shape[1]]]
        for _ in range(rounds):
            at = np.argmin((c**2).sum(1)[None] - 2 * s @ c.T, axis=1)
            n = np.bincount(at, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, at, s)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        books[j] = c
    return books


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a column that are not null."""
    return column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def placed(cells: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Cells of all rows from those of rows that have a vector; the others are in none, -1."""
    out = np.full(len(has), -1, np.int32)
    out[has] = cells
    return out


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, meta: dict):
        self.spark, self.path, self.meta = spark, path, meta
        self.dim, self.index_type, self.params = meta["dim"], meta["index_type"], meta["params"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, dim: int, index_type: str = "flat", backend: str = "parquet", **params) -> VectorIndex:
        """An empty index, in place of any at path. Unknown parameters: TypeError; types: NotImplementedError; backends: ValueError."""
        unknown = sorted(set(params) - set(PARAMS))
        if unknown:
            raise TypeError(f"unknown index params: {unknown}")
        if index_type not in TYPES:
            raise NotImplementedError(f"index type {index_type}")
        if backend not in BACKENDS:
            raise ValueError(f"unknown vector backend {backend}")
        meta = {"dim": dim, "index_type": index_type, "backend": backend, "params": PARAMS | params, "trained": index_type in ("flat", "hnsw"), "format": "sparkrag-1"}
        if index_type == "ivfpq" and dim % meta["params"]["pq_m"]:
            raise ValueError("pq_m must divide the dimension")
        at, fs = sinks._at(spark, path)
        fs.delete(at, True)
        out = cls(spark, path, meta)
        out._save()
        return out

    @classmethod
    def load(cls, spark: SparkSession, path: str, dim: int | None = None) -> VectorIndex:
        """A stored index; FileNotFoundError without one, ValueError for another format or dimension."""
        if not exists(spark, f"{path}/meta.json"):
            raise FileNotFoundError(path)
        meta = json.loads(sinks.read_text(spark, f"{path}/meta.json"))
        if meta.get("format") != "sparkrag-1":
            raise ValueError("the folder holds an index of another kind")
        if dim is not None and meta["dim"] != dim:
            raise ValueError(f"the index has {meta['dim']} dimensions, not {dim}")
        return cls(spark, path, meta)

    def _save(self) -> None:
        sinks.write_text(self.spark, f"{self.path}/meta.json", json.dumps(self.meta, sort_keys=True))

    def _vectors(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/vectors") if exists(self.spark, f"{self.path}/vectors") else None

    @property
    def size(self) -> int:
        rows = self._vectors()
        return 0 if rows is None else rows.count()

    def chunks(self) -> DataFrame:
        """Chunks without vectors, to be ordered by ordinal."""
        return self._vectors().drop("embedding", "cell", "codes")

    def _small(self, name: str) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/{name}").orderBy("i").collect()
        return np.array([r["v"] for r in rows])

    def _train(self, rows: DataFrame) -> None:
        """Centroids and codebooks from at most FIT vectors, those of the least hashes."""
        some = rows.where("embedding IS NOT NULL").select("ordinal", "embedding").orderBy(F.xxhash64("ordinal"), "ordinal").limit(FIT).toPandas()
        x = np.array(some.sort_values("ordinal")["embedding"].tolist(), np.float32).reshape(-1, self.dim)
        c = kmeans(x, self.params["nlist"])
        put = lambda name, m: self.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "i int, v array<double>").write.mode("overwrite").parquet(f"{self.path}/{name}")
        put("centroids", c)
        if self.index_type == "ivfpq":
            rest = x - c[np.argmax(x @ c.T, axis=1)]
            put("codebooks", codebooks(rest, self.params["pq_m"], self.params["pq_nbits"]).reshape(self.params["pq_m"], -1))
        self.meta["trained"] = True
        self._save()

    def add(self, chunks: DataFrame) -> int:
        """Appends chunks (chunk_id, text, source, metadata, embedding, any order column `ordinal` for a start at 0); returns the size.

        Equal chunk ids stay apart. A vector of another size is an error that names no content; a chunk whose vector is null is
        kept and not found.
        """
        start = self.size
        bad = F.when(F.col("embedding").isNotNull() & (F.size("embedding") != self.dim), F.raise_error(F.lit(f"a vector does not have {self.dim} dimensions"))).otherwise(F.col("embedding"))
        order = "ordinal" if "ordinal" in chunks.columns else None
        rows = chunks.withColumn("embedding", bad)
        rows = rows.withColumn("_o", F.col(order).cast("long")) if order else rows.withColumn("_o", F.lit(0).cast("long"))
        rows = numbered(rows.drop("ordinal"), "_o", "ordinal", ["chunk_id"]).withColumn("ordinal", F.col("ordinal") - 1 + start).drop("_o")
        if not self.meta["trained"]:
            self._train(rows)
        out = rows
        if self.index_type in ("ivf", "ivfpq"):
            out = self._celled(rows)
        elif self.index_type == "hnsw":
            out = self._hashed(rows)
        writer = out.write.mode("append")
        (writer.partitionBy("cell") if "cell" in out.columns else writer).parquet(f"{self.path}/vectors")
        return self.size

    def _celled(self, rows: DataFrame) -> DataFrame:
        c, dim = self._small("centroids"), self.dim
        coded = self.index_type == "ivfpq"
        books = self._small("codebooks").reshape(self.params["pq_m"], -1, dim // self.params["pq_m"]) if coded else None
        kept = rows.withColumn("codes", F.lit(None).cast("array<smallint>")).withColumn("cell", F.lit(0)) if coded else rows.withColumn("cell", F.lit(0))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                column = b.column(b.schema.get_field_index("embedding"))
                x, has = matrix(column, dim), column.is_valid().to_numpy(zero_copy_only=False)
                at = np.argmax(x @ c.T, axis=1)
                more = []
                if coded:
                    rest = (x - c[at]).reshape(len(x), len(books), -1)
                    codes = np.zeros((len(has), len(books)), np.int16)
                    codes[has] = np.stack([np.argmin((k**2).sum(1)[None] - 2 * rest[:, j] @ k.T, axis=1) for j, k in enumerate(books)], axis=1)
                    more = [pa.array(codes.tolist(), pa.list_(pa.int16()))]
                yield pa.RecordBatch.from_arrays([*b.columns, *more, pa.array(placed(at, has), pa.int32())], names=[*b.schema.names, *(["codes"] if coded else []), "cell"])

        return rows.mapInArrow(run, kept.schema)

    def _planes(self) -> np.ndarray:
        return np.random.default_rng(11).standard_normal((8, self.dim))

    def _hashed(self, rows: DataFrame) -> DataFrame:
        """cell: the signs of inner products with eight random directions."""
        planes, dim = self._planes(), self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                column = b.column(b.schema.get_field_index("embedding"))
                x, has = matrix(column, dim), column.is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(placed((x @ planes.T > 0) @ (1 << np.arange(8)), has), pa.int32())], names=[*b.schema.names, "cell"])

        return rows.mapInArrow(run, rows.withColumn("cell", F.lit(0)).schema)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score, rank) of the k best ordinals per query (query_id bigint, qvec); an empty index gives no rows."""
        rows = self._vectors()
        if rows is None or k < 1:
            return self.spark.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
        if self.index_type == "flat":
            return dense_top_k(rows.select(F.col("ordinal").alias("id"), F.col("embedding").alias("vec")), queries, k)
        probed = self._probed(queries)
        # The join on the stored cell reads only folders of probed cells; chunks without a vector are in none.
        cells = F.broadcast(probed.select(F.explode("cells").alias("cell")).distinct())
        met = rows.join(cells, "cell", "left_semi").select(F.col("ordinal").alias("id"), F.col("codes" if self.index_type == "ivfpq" else "embedding").alias("vec"), "cell")
        return probed_top_k(met, probed, k, self._decoded()) if self.index_type == "ivfpq" else probed_top_k(met, probed, k)

    def _probed(self, queries: DataFrame) -> DataFrame:
        """(query_id, qvec, cells) with the cells that a query looks into."""
        dim = self.dim
        if self.index_type == "hnsw":
            # So many cells as the search breadth asks for, of 256: those that differ in the signs nearest to zero.
            planes, n = self._planes(), max(1, min(256, self.params["hnsw_ef_search"] * 2))
            every = (np.arange(256)[:, None] >> np.arange(8)) & 1

            def cells(x):
                p = x @ planes.T
                cost = sum(np.abs(p[:, [j]]) * (every[:, j][None] != (p[:, [j]] > 0)) for j in range(8))
                return np.argsort(cost, axis=1, kind="stable")[:, :n]
        else:
            c, n = self._small("centroids"), self.params["nprobe"]

            def cells(x):
                return np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :n]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column(1), dim)
                at = cells(x)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["query_id", "qvec", "cells"])

        asked = queries.where("qvec IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("qvec").cast("array<float>").alias("qvec"))
        return asked.mapInArrow(run, "query_id bigint, qvec array<float>, cells array<int>")

    def _decoded(self):
        """Vectors that codes stand for: the centroid of the cell and the code centres."""
        m = self.params["pq_m"]
        c, books = self._small("centroids"), self._small("codebooks").reshape(m, -1, self.dim // m)

        def run(codes: np.ndarray, rows: int, cell: int) -> np.ndarray:
            return c[cell] + books[np.arange(m), codes.reshape(rows, m)].reshape(rows, -1)

        return run

    def save_manifest(self, by: Provider) -> None:
        sinks.write_text(self.spark, f"{self.path}/embedding.json", json.dumps({"version": 1, "provider": by.name, "model": by.model, "dimension": by.dim}, indent=2, sort_keys=True) + "\n")

    def check_manifest(self, by: Provider) -> None:
        """ValueError if the index was built with another provider, model or dimension; without a manifest anything goes."""
        raw = sinks.read_text(self.spark, f"{self.path}/embedding.json")
        if raw is None:
            return
        has = json.loads(raw)
        if (has.get("provider"), has.get("model"), has.get("dimension")) != (by.name, by.model, by.dim):
            raise ValueError(f"the index was built with {has.get('provider')}, {has.get('model')}, {has.get('dimension')}; queries use {by.name}, {by.model}, {by.dim}")


def clustered_vectors(spark: SparkSession, n: int, dim: int, jitter: float = 0.15, seed: int = 0) -> DataFrame:
    """(id, vec): unit vectors around n / 500 random centres."""
    centres = np.random.default_rng(seed).standard_normal((max(1, n // 500), dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            x = np.array([centres[np.random.default_rng([seed, i]).integers(len(centres))] + jitter * np.random.default_rng([seed, i, 1]).standard_normal(dim) for i in ids])
            x = x.reshape(-1, dim) / np.maximum(np.linalg.norm(x.reshape(-1, dim), axis=1, keepdims=True), 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32()))], ["id", "vec"])

    return spark.range(n).mapInArrow(run, "id bigint, vec array<float>")
