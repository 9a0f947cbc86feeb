"""Commands: ingest a folder, ask, evaluate, measure index types."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import functions as F

from .config import Settings
from .embed import provider
from .generate import Engine
from .index.vectors import VectorIndex, clustered_vectors
from .operators import chunking, evaluation
from .session import session
from .sources import evalsets, files


def engine(spark, settings: Settings) -> Engine:
    return Engine(spark, settings.index_dir, provider(settings.embedding_provider, settings.embedding_model, settings.embedding_dim), settings=settings)


def ingest(spark, settings: Settings) -> dict:
    docs = files.load_documents(spark, settings.data_dir, settings)
    chunks = chunking.chunk_documents(docs, settings.chunk_size, settings.chunk_overlap)
    made = Engine.ingest(spark, settings.index_dir, chunks, provider(settings.embedding_provider, settings.embedding_model, settings.embedding_dim), settings)
    return made.health()


def evaluate(spark, settings: Settings, path: str, k: int = 5) -> list[dict]:
    """Mean metrics of dense and hybrid retrieval by source."""
    queries = evalsets.load(spark, path, "source").withColumn("query_id", F.col("ordinal").cast("long"))
    out = []
    for mode in ("dense", "hybrid"):
        e = engine(spark, Settings.load(**(settings.__dict__ | {"retrieval_mode": mode})))
        chunks = e.index.chunks()
        found = e.retrieve(queries, k).join(chunks.select(F.col("ordinal").alias("id"), "source"), "id").join(queries.select("query_id", "labels"), "query_id")
        totals = queries.select("query_id", F.explode("labels").alias("source")).join(chunks.groupBy("source").agg(F.count("*").alias("n")), "source", "left").groupBy("query_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("total"))
        per = evaluation.metrics(found.select("query_id", F.array_contains("labels", F.col("source")).alias("rel"), "rank"), totals, k)
        out.append({"mode": mode} | evaluation.mean_metrics(per).first().asDict())
    return out


def benchmark(spark, settings: Settings, n: int = 5000, dim: int = 64, k: int = 10) -> list[dict]:
    """Recall against exact search and seconds of each index type over clustered vectors."""
    rows = clustered_vectors(spark, n, dim).cache()
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    base = rows.select(F.col("id").alias("ordinal"), F.col("id").cast("string").alias("chunk_id"), F.lit("").alias("text"), F.lit("").alias("source"), F.col("vec").alias("embedding"))
    out, truth = [], None
    for kind in ("flat", "ivf", "hnsw", "ivfpq"):
        index = VectorIndex.create(spark, f"{settings.index_dir}/bench-{kind}", dim, kind, **({"pq_m": dim // 8} if kind == "ivfpq" else {}))
        index.add(base)
        start = time.perf_counter()
        found = index.search(queries, k).collect()
        took = time.perf_counter() - start
        found = spark.createDataFrame(found)
        truth = truth or found
        out.append({"index_type": kind, "seconds": round(took, 3), "recall": evaluation.ann_recall(truth, found, k).first()["recall"]})
    return out


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="sparkrag")
    p.add_argument("command", choices=("ingest", "ask", "eval", "benchmark", "smoke"))
    p.add_argument("what", nargs="?", default="")
    p.add_argument("--data-dir")
    p.add_argument("--index-dir")
    p.add_argument("--top-k", type=int)
    a = p.parse_args(argv)
    settings = Settings.load(**{k: v for k, v in (("data_dir", a.data_dir), ("index_dir", a.index_dir)) if v})
    spark = session()
    out = {"ingest": lambda: ingest(spark, settings), "ask": lambda: engine(spark, settings).query(a.what, a.top_k), "eval": lambda: evaluate(spark, settings, a.what), "benchmark": lambda: benchmark(spark, settings), "smoke": lambda: engine(spark, settings).health()}[a.command]()
    print(json.dumps(out, ensure_ascii=False, indent=2, default=str))


if __name__ == "__main__":
    main()
