"""Embedding providers: hashed tokens natively, others over HTTP or as a local model."""

from __future__ import annotations

import hashlib
import json
import re
import urllib.request
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions.cut import cut


def bucket(term: Column, dim: int) -> tuple[Column, Column]:
    """Axis and sign of a term by its digest."""
    digest = F.md5(term.cast("binary"))
    number = lambda at, n: F.conv(F.substring(digest, at, n), 16, 10).cast("bigint")
    return F.pmod(number(1, 8), F.lit(dim)).cast("int"), F.when(number(9, 1) % 2 == 0, 1.0).otherwise(-1.0)


def axis_of(term: str, dim: int) -> tuple[int, int]:
    """bucket of one term."""
    d = hashlib.md5(term.encode()).hexdigest()
    return int(d[:8], 16) % dim, 1 if int(d[8], 16) % 2 == 0 else -1


def hashed_terms(terms: DataFrame, key: str, dim: int = 256) -> DataFrame:
    """(key, axis, weight): unit vectors of hashed terms (key, term, tf), axes other than zero only; where terms cancel out there are no rows."""
    axis, sign = bucket(F.col("term"), dim)
    sums = terms.groupBy(key, axis.alias("axis")).agg(F.sum(sign * F.col("tf")).alias("v")).where("v <> 0")
    norms = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return sums.join(norms, key).select(key, "axis", (F.col("v") / F.col("norm")).alias("weight"))


def sparse_vectors(rows: DataFrame, key: str, text: str = "text", dim: int = 256) -> DataFrame:
    """hashed_terms of texts; each term of a text is hashed once."""
    terms = rows.select(key, F.explode(T.tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    return hashed_terms(terms, key, dim)


def hashed_lists(docs: DataFrame, dim: int = 256) -> DataFrame:
    """(axis, ids, weights): hashed_terms of documents (id, text), a list per axis of a batch; no rows are brought together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Axes(dim)
        for b in batches:
            found, doc = cut(b.column(1))
            coded = found.dictionary_encode()
            axes, signs = np.array([known[t] for t in coded.dictionary.to_pylist()], np.int64).reshape(-1, 2).T
            term = coded.indices.to_numpy()
            v = np.bincount(doc * dim + axes[term], signs[term], b.num_rows * dim).reshape(-1, dim)
            norms = np.sqrt((v * v).sum(axis=1))
            axis, at = np.nonzero(v.T)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(axis, minlength=dim))]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (b.column(0).take(pa.array(at)), pa.array(v[at, axis] / norms[at]))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), *lists], ["axis", "ids", "weights"])

    rows = docs.select("id", F.lower(F.coalesce("text", F.lit(""))))
    return rows.mapInArrow(run, f"axis int, ids array<{docs.schema['id'].dataType.simpleString()}>, weights array<double>").where(F.size("ids") > 0)


def sparse_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) of the k best by inner product; vectors (id, axis, weight), queries (query_id, axis, weight)."""
    met = vectors.join(queries.select("query_id", "axis", F.col("weight").alias("q")), "axis")
    scored = met.groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") * F.col("q")), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


class Axes(dict):
    """axis_of by term; what is remembered is bounded, and workers begin with nothing."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, term: str) -> tuple[int, int]:
        if len(self) >= 1 << 17:
            self.clear()
        found = self[term] = axis_of(term, self.dim)
        return found

    def __reduce__(self):
        return Axes, (self.dim,)


class Provider:
    """Contract: name, model, dim, batch size, and `embed(texts, query)` that returns one row of numbers per text.

    A row of zeros is an error, unless the provider `cancels`: then the text has no vector.
    """

    name, model, dim, batch, cancels = "", "", 0, 64, False

    def embed(self, texts: list[str], query: bool) -> list[list[float]]:
        raise NotImplementedError


class Hashing(Provider):
    """The vectors of sparse_vectors, as dense rows; terms may cancel out."""

    name, model, cancels = "hashing", "hashed-tokens", True

    def __init__(self, dim: int = 256):
        self.dim, self.axes = dim, Axes(dim)

    def embed(self, texts, query):
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w, n in Counter(re.findall(T.TOKEN, t.lower())).items():
                axis, sign = self.axes[w]
                out[i, axis] += sign * n
        return out


def post_json(url: str, body: dict, timeout: float = 60) -> object:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
        return json.load(answer)


class Endpoint(Provider):
    """A server with a route /embed that takes {"inputs": [...]}."""

    name, batch = "endpoint", 8

    def __init__(self, url: str, model: str, dim: int, send: Callable = post_json):
        self.url, self.model, self.dim, self.send = url.rstrip("/"), model, dim, send

    def embed(self, texts, query):
        return self.send(f"{self.url}/embed", {"inputs": texts})


class Managed(Provider):
    """A managed model behind invoke(model, body) -> answer: with texts in batches and a task type, or, `single`, one text a call from threads in order."""

    def __init__(self, invoke: Callable, model: str, dim: int, single: bool, threads: int = 2):
        allowed = (256, 512, 1024) if single else (256, 512, 1024, 1536)
        if dim not in allowed:
            raise ValueError(f"dimension must be one of {allowed}")
        self.invoke, self.model, self.dim, self.single, self.threads = invoke, model, dim, single, threads
        self.name, self.batch = "managed", 96

    def embed(self, texts, query):
        if not self.single:
            return self.invoke(self.model, {"texts": texts, "input_type": "search_query" if query else "search_document", "output_dimension": self.dim})["embeddings"]
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(self.threads) as pool:
            return [x["embedding"] for x in pool.map(lambda t: self.invoke(self.model, {"inputText": t, "dimensions": self.dim, "normalize": True}), texts)]


class Local(Provider):
    """A model of the sentence-transformers package, loaded once per worker."""

    name = "local"

    def __init__(self, model: str, dim: int):
        self.model, self.dim, self._loaded = model, dim, None

    def embed(self, texts, query):
        if self._loaded is None:
            from sentence_transformers import SentenceTransformer

            self._loaded = SentenceTransformer(self.model)
        return self._loaded.encode(texts).tolist()


def provider(kind: str, model: str = "", dim: int = 256, **how) -> Provider:
    """By name; of managed models those that begin with amazon.titan take one text a call."""
    if kind == "hashing":
        return Hashing(dim)
    if kind == "endpoint":
        return Endpoint(how.pop("url"), model, dim, **how)
    if kind == "managed":
        return Managed(how.pop("invoke"), model, dim, model.startswith("amazon.titan"), **how)
    if kind == "local":
        return Local(model, dim)
    raise ValueError(f"unknown embedding provider {kind}")


def normalised(raw: list[list[float]], rows: int, dim: int) -> np.ndarray:
    """Unit rows; raises, without content, for a wrong shape, numbers that are not finite, and zero rows."""
    m = np.asarray(raw, np.float32)
    if m.shape != (rows, dim):
        raise ValueError(f"expected shape {(rows, dim)}, got {m.shape}")
    if not np.isfinite(m).all():
        raise ValueError("an embedding is not finite")
    n = np.linalg.norm(m, axis=1, keepdims=True)
    if (n == 0).any():
        raise ValueError("an embedding is zero")
    return np.ascontiguousarray(m / n)


def with_embedding(rows: DataFrame, by: Provider, text: str = "text", out: str = "embedding", query: bool = False) -> DataFrame:
    """rows with the unit vector of a text, null where a provider's numbers cancel out; the provider travels to the workers, and texts go to it in its batches."""
    schema = rows.withColumn(out, F.lit(None).cast("array<float>")).schema

    def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw, has = by.embed(texts, query), np.ones(len(texts), bool)
        if by.cancels:
            raw = np.asarray(raw)
            has = raw.any(axis=1)
            raw = raw[has]
        return normalised(raw, int(has.sum()), by.dim), has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column(b.schema.get_field_index(text)).to_pylist()]
            parts = [vectors(texts[i : i + by.batch]) for i in range(0, len(texts), by.batch)]
            values, has = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros((0, by.dim), np.float32), np.ones(0, bool))
            ends = np.concatenate([[0], np.cumsum(has) * by.dim])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.ravel(), pa.float32()), mask=pa.array(~has))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, out])

    return rows.mapInArrow(run, schema)
