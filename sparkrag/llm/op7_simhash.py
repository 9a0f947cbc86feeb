"""SimHash near-dedup by covering locality-sensitive hashing.

A fingerprint has 64 bits; two of them link at RADIUS or fewer differing bits. Bit positions are dealt over the
non-zero vectors v of {0,1}^(RADIUS+1); the mask of a vector u keeps the positions whose v has odd inner product
with u. Any RADIUS positions are orthogonal to some u, so a linked pair agrees on all kept bits of some mask:
each of the 2^(RADIUS+1)-1 tables is a mask, and no linked pair is missed.
Inside a bucket no pairs are formed: fingerprints at distance 2 or less share a value at distance 1 or less from
both, so each fingerprint that has a bucket partner names those values (itself and one flip of each free bit), and
equal values link. A value has at most 65 neighbours, whatever the corpus.

Null and empty texts have fingerprint zero; repeated rows share a fingerprint and so a component; a null doc_id
is a member but never names a component unless it is alone (then null); an empty table gives no rows; further
columns are ignored. Texts are processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, lean, stored, table

RADIUS = 2
BLOCK = 1 << 15


def fingerprint(text: bytes | None) -> int:
    """Unsigned SimHash of the 3-word shingles of the lower-cased text."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    grams = map(b" ".join, zip(w, w[1:], w[2:])) if len(w) > 2 else [b" ".join(w)]
    n, ones, h = 0, np.zeros(64, np.int64), []

    def count(h: list[int]) -> np.ndarray:
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return bits.sum(0, dtype=np.int64)

    for g in grams:
        h.append(xxhash.xxh64_intdigest(g, 42))
        if len(h) == BLOCK:
            n, ones, h = n + len(h), ones + count(h), []
    if h:
        n, ones = n + len(h), ones + count(h)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(x.as_py()) for x in b.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp holds the unsigned fingerprint in a signed long."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(lean(_fingerprints), "doc_id bigint, fp bigint")


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """Covering masks: position i belongs to vector 1 + i mod (2^(radius+1)-1)."""
    top = 2 ** (radius + 1)
    return [sum(1 << i for i in range(bits) if ((1 + i % (top - 1)) & u).bit_count() % 2) for u in range(1, top)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b), a > b as signed longs, whose components are those of all links between distinct fps (fp)."""
    m = masks()
    tables = F.array(*[F.struct(F.lit(i).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(signed(x))).alias("key")) for i, x in enumerate(m)])
    entries = fps.select("fp", F.explode(tables).alias("e")).select("fp", "e.t", "e.key")
    full = entries.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    free = F.element_at(F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(64) if not x >> i & 1]) for x in m]), F.col("t") + 1)
    near = entries.join(full, ["t", "key"]).select("fp", F.explode(F.transform(free, lambda f: F.col("fp").bitwiseXOR(f))).alias("z"))
    met = near.groupBy("z").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return met.select(F.explode(F.filter("fps", lambda x: x != F.array_min("fps"))).alias("a"), F.array_min("fps").alias("b")).distinct()


def _seen(edges: DataFrame):
    """Number of edges and a sum of their hashes, to tell whether a round changed any."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): alternating large and small stars, each round stored in the shared folder.

    The least neighbour of a node of many edges is broadcast to them (`join_hot`), so a large component is no single task.
    """
    edges = stored(edges, "edges")
    before = _seen(edges)
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = stored(join_hot(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "stars")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_hot(large, low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = stored(small, "edges")
        after = _seen(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs."""
    rows = stored(fingerprints(docs), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(fps.select("fp")))
    placed = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stored(placed.select("fp", "root").join(named, "root").select("fp", "component_id"), "classes")
    return join_hot(rows, classes, "fp")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
