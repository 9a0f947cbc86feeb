"""Queries: lexical and vector search, fusion, reranking, indexes, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..embed import hashed_lists, sparse_top_k, sparse_vectors
from ..functions import text as T
from ..index import lexical
from ..index.vectors import VectorIndex
from ..operators import evaluation as E
from ..operators import ranking as R
from ..sinks import scratch
from .registry import query, table

QUERY = "the of and on that the"
#: Axes of hashed vectors.
DIM = 256
_indexes: dict[tuple, str] = {}


def lexical_index(spark, sf_dir: str) -> str:
    """The stored index over documents, built once per session and table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        path = scratch(spark, "postings")
        lexical.build(table(spark, sf_dir, "documents"), path)
        _indexes[key] = path
    return _indexes[key]


def asked(spark, question: str = QUERY) -> DataFrame:
    return spark.createDataFrame([(0, question)], "query_id bigint, question string")


@query("SELECT t AS term, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS t FROM documents) GROUP BY t")
def tokenize_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


BM25_SQL = """
WITH tok AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok), p AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM tok),
tf AS (SELECT id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, st GROUP BY term, n),
q AS (SELECT term, count(*) AS qn FROM (SELECT unnest(string_split('the of and on that the', ' ')) AS term) GROUP BY term),
idf AS (SELECT term, qn, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw JOIN q USING (term)),
sc AS (SELECT id, round(sum(qn * idf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))), 6) AS score FROM tf JOIN idf USING (term), st GROUP BY id),
bm AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sc)
"""


@query(BM25_SQL + "SELECT id, score, rank::INT AS rank FROM bm WHERE rank <= 20 AND score > 0")
def bm25_topk(spark, sf_dir):
    return lexical.search(spark, lexical_index(spark, sf_dir), asked(spark), 20).select("id", "score", "rank")


BM25_MANY = BM25_SQL.replace("q AS (SELECT term, count(*) AS qn FROM (SELECT unnest(string_split('the of and on that the', ' ')) AS term) GROUP BY term)", "q AS (SELECT query_id, term, count(*) AS qn FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL)").replace("SELECT term, qn, CASE", "SELECT query_id, term, qn, CASE").replace("sc AS (SELECT id,", "sc AS (SELECT query_id, id,").replace("GROUP BY id)", "GROUP BY query_id, id)").replace("bm AS (SELECT id, score, row_number() OVER (ORDER", "bm AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER")


@query(BM25_MANY + "SELECT query_id, id, score, rank::INT AS rank FROM bm WHERE rank <= 10 AND score > 0")
def bm25_benchmark(spark, sf_dir):
    """Every benchmark item as a query against all documents."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return lexical.search(spark, lexical_index(spark, sf_dir), items, 10)


DENSE_SQL = """
WITH q AS (SELECT vec_id AS query_id, embedding AS qvec, label AS ql FROM embeddings WHERE vec_id < 10),
s AS (SELECT query_id, vec_id AS id, label = ql AS rel, round(list_dot_product(embedding::DOUBLE[], qvec::DOUBLE[]), 6) AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
"""
#: The whole search: every row whose id is divisible by 100 against all rows.
ALL_SQL = DENSE_SQL.replace("vec_id < 10", "vec_id % 100 = 0")


def _dense(spark, sf_dir, k, which):
    e = table(spark, sf_dir, "embeddings")
    return R.dense_top_k(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), e.where(which).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), k)


@query(DENSE_SQL + "SELECT query_id, id, score, rank::INT AS rank FROM r WHERE rank <= 20")
def dense_topk_batch(spark, sf_dir):
    # The query set is the feature: ten stated vectors.
    return _dense(spark, sf_dir, 20, "vec_id < 10")


@query(ALL_SQL + "SELECT query_id, id, score, rank::INT AS rank FROM r WHERE rank <= 20")
def dense_topk_hundredth(spark, sf_dir):
    return _dense(spark, sf_dir, 20, "vec_id % 100 = 0")


def _judged(labels, found):
    """(query_id, rel, rank) of found without the query itself, and (query_id, ql)."""
    top = found.where("id <> query_id")
    ql = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))
    ranked = top.join(labels, top["id"] == labels["vec_id"]).join(ql, "query_id").select("query_id", (F.col("label") == F.col("ql")).alias("rel"), F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("rank"))
    return ranked, ql


def _metrics(spark, sf_dir, which):
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    ranked, ql = _judged(labels, _dense(spark, sf_dir, 6, which.replace("query_id", "vec_id")))
    totals = ql.where(which).join(labels.groupBy("label").agg((F.count("*") - 1).alias("total")), F.col("ql") == F.col("label")).select("query_id", "total")
    return E.metrics(ranked, totals, 5)


METRICS = """, top AS (SELECT * FROM r WHERE rank <= 5 + 1 AND id <> query_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rk FROM top),
t AS (SELECT query_id, count(*) FILTER (rel AND id <> query_id) AS total FROM s GROUP BY query_id)
SELECT query_id, max((rk <= 1 AND rel)::INT) AS hit1, max((rk <= 3 AND rel)::INT) AS hit3, round(coalesce(1.0::DOUBLE / min(rk) FILTER (rel), 0), 6) AS rr, round((count(*) FILTER (rel))::DOUBLE / any_value(total), 6) AS recall,
round(sum(CASE WHEN rel THEN 1 / log2(rk + 1.0::DOUBLE) ELSE 0 END) / list_sum(list_transform(range(1, least(5, any_value(total)) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))), 6) AS ndcg
FROM k JOIN t USING (query_id) WHERE rk <= 5 AND total > 0 GROUP BY query_id"""


@query(DENSE_SQL + METRICS)
def metrics_hit_mrr_recall_ndcg(spark, sf_dir):
    return _metrics(spark, sf_dir, "query_id < 10")


@query(ALL_SQL + METRICS)
def metrics_hundredth(spark, sf_dir):
    return _metrics(spark, sf_dir, "query_id % 100 = 0")


MEANS = METRICS.replace("\nSELECT query_id, max", ", per AS (SELECT query_id, max", 1) + ") SELECT round(avg(hit1), 6) AS hit1, round(avg(hit3), 6) AS hit3, round(avg(rr), 6) AS rr, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg FROM per"


@query(ALL_SQL + MEANS)
def metrics_mean(spark, sf_dir):
    return E.mean_metrics(_metrics(spark, sf_dir, "query_id % 100 = 0"))


POSTS = ALL_SQL + """, l AS (SELECT q.query_id, e.vec_id AS id FROM q JOIN embeddings e ON e.label = q.ql AND e.vec_id % 7 = 3),
h AS (SELECT l.query_id, r.rank FROM l LEFT JOIN r ON r.query_id = l.query_id AND r.id = l.id AND r.rank <= 20)
SELECT query_id, round(count(*) FILTER (rank <= 5) / count(*)::DOUBLE, 6) AS recall_5, round(count(*) FILTER (rank <= 10) / count(*)::DOUBLE, 6) AS recall_10, round(coalesce(1.0::DOUBLE / min(rank) FILTER (rank <= 10), 0), 6) AS rr FROM h GROUP BY query_id"""


@query(POSTS)
def post_recall_mrr(spark, sf_dir):
    """Recall at 5 and 10 and reciprocal rank at 10; the labels of a query are a stated part of its class."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    marks = e.where("vec_id % 7 = 3").groupBy("label").agg(F.collect_list("vec_id").alias("labels"))
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label").join(marks, "label")
    return E.post_metrics(queries, _dense(spark, sf_dir, 20, "vec_id % 100 = 0").select("query_id", "id", "rank"))


@query(ALL_SQL + ", f AS (SELECT query_id, min(rank) FILTER (rel) AS r FROM r WHERE rank <= 5 GROUP BY query_id) SELECT query_id, coalesce((r <= 1)::INT, 0) AS hit1, coalesce((r <= 3)::INT, 0) AS hit3, round(coalesce(1.0::DOUBLE / r, 0), 4) AS rr FROM f")
def title_hits(spark, sf_dir):
    """Hits by the class of results, with repeats: the query itself is one of them."""
    e = table(spark, sf_dir, "embeddings")
    name = F.col("label").cast("string")
    found = _dense(spark, sf_dir, 5, "vec_id % 100 = 0").join(e.select(F.col("vec_id").alias("id"), name.alias("title")), "id")
    return E.title_metrics(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.array(name).alias("labels")), found)


HASHED = """, hv AS (SELECT id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 256 AS axis, sum(tf * CASE WHEN ('0x' || substr(md5(term), 9, 1))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM tf GROUP BY ALL HAVING v <> 0),
hn AS (SELECT id, axis, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS w FROM hv),
qv AS (SELECT ('0x' || substr(md5(term), 1, 8))::BIGINT % 256 AS axis, sum(qn * CASE WHEN ('0x' || substr(md5(term), 9, 1))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM q GROUP BY ALL HAVING v <> 0),
qw AS (SELECT axis, v / sqrt(sum(v * v) OVER ()) AS w FROM qv),
ds AS (SELECT id, round(sum(hn.w * qw.w), 6) AS score FROM hn JOIN qw USING (axis) GROUP BY id),
de AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ds)
"""


def hashed_index(spark, sf_dir: str) -> str:
    """Stored hashed vectors of the documents, built once per session and table."""
    key = (spark.sparkContext.applicationId, sf_dir, "hashed")
    if key not in _indexes:
        path = scratch(spark, "hashed")
        own, others = lexical.split_repeated(table(spark, sf_dir, "documents"), "doc_id", "text")
        rows = hashed_lists(own, DIM)
        if others is not None:
            rows = rows.union(sparse_vectors(others, "id", "text", DIM).select("axis", F.array("id"), F.array("weight")))
        rows = rows.withColumn("part", F.col("axis") % 32)
        rows.sortWithinPartitions("part", "axis").write.partitionBy("part").parquet(path)
        _indexes[key] = path
    return _indexes[key]


def _hashed(spark, sf_dir, k):
    wanted = sparse_vectors(asked(spark), "query_id", "question", DIM)
    at = wanted.select((F.col("axis") % 32).alias("part"), "axis").distinct()
    met = spark.read.parquet(hashed_index(spark, sf_dir)).join(F.broadcast(at), ["part", "axis"])
    return sparse_top_k(met.select("axis", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("weights").alias("weight")))), F.broadcast(wanted), k)


@query(BM25_SQL + HASHED + "SELECT id, score, rank::INT AS rank FROM de WHERE rank <= 20")
def hashed_dense_topk(spark, sf_dir):
    """Dense retrieval over hashed vectors of the texts."""
    return _hashed(spark, sf_dir, 20).select("id", "score", "rank")


HYBRID = BM25_SQL + HASHED + """, c AS (SELECT 0 AS li, id, rank - 1 AS rank FROM de WHERE rank <= 20 UNION ALL SELECT 1, id, rank - 1 FROM bm WHERE rank <= 20 AND score > 0),
fu AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS s, min(li * 1000 + rank) AS seen FROM c GROUP BY id),
hy AS (SELECT id, round(s, 6) AS score, row_number() OVER (ORDER BY round(s, 12) DESC, seen) AS rank FROM fu)
"""


def _lists(spark, sf_dir):
    dense = _hashed(spark, sf_dir, 20).select("query_id", F.lit(0).alias("list_idx"), "id", (F.col("rank") - 1).alias("rank"))
    sparse = lexical.search(spark, lexical_index(spark, sf_dir), asked(spark), 20).select("query_id", F.lit(1).alias("list_idx"), "id", (F.col("rank") - 1).alias("rank"))
    return dense.union(sparse)


@query(HYBRID + "SELECT id, score, rank::INT AS rank FROM hy WHERE rank <= 10")
def rrf_hybrid(spark, sf_dir):
    """Dense and lexical candidates, 20 each, fused; the ten best."""
    return R.fuse_lists(_lists(spark, sf_dir), 60, 10).select("id", F.round("score", 6).alias("score"), "rank")


@query(HYBRID + "SELECT string_agg('[' || rank || '] (source: ' || coalesce(source, 'unknown') || ')\n' || substr(text, 1, 200), chr(10) || chr(10) ORDER BY rank) AS context FROM hy JOIN documents ON doc_id = id WHERE rank <= 4")
def hybrid_context(spark, sf_dir):
    """The four best passages as numbered context; of each its first 200 characters, as a preview shows them."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.first_filled(F.col("source")).alias("source"), F.substring("text", 1, 200).alias("text"))
    best = R.fuse_lists(_lists(spark, sf_dir), 60, 4).join(docs, "id")
    return best.agg(F.sort_array(F.collect_list(F.struct("rank", "source", "text"))).alias("p")).select(T.context(F.col("p")).alias("context"))


@query(HYBRID + """, ov AS (SELECT id, hy.rank, len(list_intersect(['the', 'of', 'and', 'on', 'that'], list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')))) / 5.0::DOUBLE AS s FROM hy JOIN documents ON doc_id = id)
SELECT id, round(s, 6) AS score, (row_number() OVER (ORDER BY s DESC, rank))::INT AS rank FROM ov QUALIFY row_number() OVER (ORDER BY s DESC, rank) <= 10""")
def rerank_overlap(spark, sf_dir):
    """All fused candidates by the share of the question's tokens in their text; the ten best."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = R.fuse_lists(_lists(spark, sf_dir)).join(asked(spark), "query_id").join(docs, "id")
    return R.rerank(found, top_k=10).select("id", F.round("score", 6).alias("score"), "rank")


@query(HYBRID + "SELECT id, max(de.rank)::INT AS dense, max(bm.rank)::INT AS bm25, max(hy.rank)::INT AS hybrid FROM hy LEFT JOIN (SELECT * FROM de WHERE rank <= 20) de USING (id) LEFT JOIN (SELECT * FROM bm WHERE rank <= 20 AND score > 0) bm USING (id) GROUP BY id")
def side_by_side(spark, sf_dir):
    """Ranks of each candidate in the three lists."""
    lists = _lists(spark, sf_dir)
    named = lists.select("query_id", F.when(F.col("list_idx") == 0, "dense").otherwise("bm25").alias("name"), "id", (F.col("rank") + 1).alias("rank"))
    fused = R.fuse_lists(lists).select("query_id", F.lit("hybrid").alias("name"), "id", "rank")
    return R.side_by_side(named.union(fused), ["dense", "bm25", "hybrid"]).drop("query_id")


TWO = """WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents), b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars, doc_id DESC) AS rank FROM documents),
c AS (SELECT 0 AS li, id, rank FROM a WHERE rank <= 50 UNION ALL SELECT 1, id, rank FROM b WHERE rank <= 40 UNION ALL SELECT 1, id, rank + 40 FROM a WHERE rank BETWEEN 10 AND 30 UNION ALL SELECT 1, id, rank + 100 FROM a WHERE rank BETWEEN 5 AND 15),
"""


def _two_lists(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    best = lambda by, k: docs.orderBy(*by).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*by)))
    a, b = best((F.desc("n_chars"), "id"), 50), best(("n_chars", F.desc("id")), 40)
    part = lambda rows, i, more=0: rows.select(F.lit(0).alias("query_id"), F.lit(i).alias("list_idx"), "id", (F.col("rank") + more).alias("rank"))
    return part(a, 0).union(part(b, 1)).union(part(a.where("rank BETWEEN 10 AND 30"), 1, 40)).union(part(a.where("rank BETWEEN 5 AND 15"), 1, 100))


@query(TWO + "f AS (SELECT li, id, min(rank) AS rank FROM c GROUP BY ALL), g AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS s, min(rank) AS best FROM f GROUP BY id) SELECT id, round(s, 6) AS score, best::INT AS best_rank, (row_number() OVER (ORDER BY round(s, 12) DESC, best, id))::INT AS rank FROM g")
def rrf_ids_one_based(spark, sf_dir):
    """Two id lists with repeats inside one of them, fused by rank from 1."""
    return R.fuse_ids(_two_lists(spark, sf_dir)).select("id", F.round("score", 6).alias("score"), F.col("best_rank").cast("int").alias("best_rank"), "rank")


@query(TWO + "g AS (SELECT id, sum(1.0::DOUBLE / (60 + rank - 1)) AS s, min(li * 100000 + rank) AS seen FROM c GROUP BY id) SELECT id, round(s, 6) AS score, (row_number() OVER (ORDER BY round(s, 12) DESC, seen))::INT AS rank FROM g")
def rrf_lists_zero_based(spark, sf_dir):
    """The same lists, by rank from 0, repeats counted, ties in order of first sight."""
    return R.fuse_lists(_two_lists(spark, sf_dir).withColumn("rank", F.col("rank") - 1)).select("id", F.round("score", 6).alias("score"), "rank")


@query("WITH a AS (SELECT source, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents), b AS (SELECT source, min(rank) AS r FROM a WHERE source IS NOT NULL GROUP BY source) SELECT source, (row_number() OVER (ORDER BY r, source))::INT AS rank FROM b")
def chunk_to_post_collapse(spark, sf_dir):
    """Documents by length as chunks, their sources as posts."""
    from ..operators.cells import numbered

    docs = table(spark, sf_dir, "documents").withColumn("minus", -F.col("n_chars"))
    ranked = numbered(docs.select("doc_id", "minus"), "minus", "rank", ["doc_id"]).select(F.lit(0).alias("query_id"), F.col("doc_id").alias("id"), "rank")
    parents = docs.where("source IS NOT NULL").select(F.col("doc_id").alias("id"), "source")
    return R.collapse(ranked, parents, "source").drop("query_id")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ordinal"), F.col("vec_id").cast("string").alias("chunk_id"), F.concat(F.lit("vector "), "vec_id").alias("text"), F.col("label").cast("string").alias("source"), "embedding")


def _index(spark, sf_dir, kind, **params):
    index = VectorIndex.create(spark, scratch(spark, f"index-{kind}"), 64, kind, **params)
    index.add(_vectors(spark, sf_dir))
    return index


def _searched(spark, sf_dir, index, k):
    e = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    # Ordinals number the rows from 0 in order of vec_id; the chunk id is the vec_id.
    ids = index.chunks().select(F.col("ordinal").alias("id"), F.col("chunk_id").cast("bigint").alias("vec"))
    return index.search(e, k).join(ids, "id").select("query_id", F.col("vec").alias("id"), "score", "rank")


@query(ALL_SQL + "SELECT query_id, id, score, rank::INT AS rank FROM r WHERE rank <= 20")
def ivf_probe_all(spark, sf_dir):
    """Inverted lists with every cell probed give the exact search."""
    return _searched(spark, sf_dir, _index(spark, sf_dir, "ivf", nlist=16, nprobe=16), 20)


def _recall(spark, sf_dir, truth, kind, **params):
    return E.ann_recall(truth, _searched(spark, sf_dir, _index(spark, sf_dir, kind, **params), 20), 20).select(F.lit(kind).alias("index_type"), "recall")


@query()
def ann_recall(spark, sf_dir):
    """Recall at 20 of each approximate type against exact search."""
    path = scratch(spark, "truth")
    dense_topk_hundredth(spark, sf_dir).write.parquet(path)
    truth = spark.read.parquet(path)
    parts = [_recall(spark, sf_dir, truth, "ivf", nlist=16, nprobe=8), _recall(spark, sf_dir, truth, "hnsw"), _recall(spark, sf_dir, truth, "ivfpq", nlist=16, nprobe=16, pq_m=16)]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS ordinal, vec_id::VARCHAR AS chunk_id, 'vector ' || vec_id AS text, label::VARCHAR AS source FROM embeddings")
def stored_chunks(spark, sf_dir):
    """A flat index written and scanned again, without its vectors."""
    return _index(spark, sf_dir, "flat").chunks().select("ordinal", "chunk_id", "text", "source")


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")
def vector_norms(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(T.norm(T.checked_vector(F.col("embedding"), 64)), 5).alias("norm"))


@query("SELECT round(max(abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1)), 4) AS error FROM embeddings")
def norm_error(spark, sf_dir):
    from ..functions.stats import norm_error as worst

    return table(spark, sf_dir, "embeddings").agg(F.round(worst(T.norm(F.col("embedding"))), 4).alias("error"))

