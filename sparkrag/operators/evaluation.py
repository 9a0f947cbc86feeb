"""Retrieval metrics, label checks, answer candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import int_or_zero, tokens
from ..index import lexical


def metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query of relevant (query_id, total): hit1, hit3, rr, recall, ndcg of ranked (query_id, rel, rank from 1). A query without results scores 0."""
    top = ranked.where(F.col("rank") <= k)
    per = top.groupBy("query_id").agg(
        F.max(F.when((F.col("rank") <= 1) & F.col("rel"), 1).otherwise(0)).alias("hit1"), F.max(F.when((F.col("rank") <= 3) & F.col("rel"), 1).otherwise(0)).alias("hit3"),
        F.coalesce(1.0 / F.min(F.when(F.col("rel"), F.col("rank"))), F.lit(0.0)).alias("rr"), F.count_if("rel").alias("got"),
        F.sum(F.when(F.col("rel"), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("total")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = relevant.where("total > 0").join(per, "query_id", "left")
    return out.select("query_id", z("hit1").alias("hit1"), z("hit3").alias("hit3"), F.round(z("rr"), 6).alias("rr"), F.round(z("got") / F.col("total"), 6).alias("recall"), F.round(z("dcg") / ideal, 6).alias("ndcg"))


def mean_metrics(per_query: DataFrame, *by: str) -> DataFrame:
    names = [c for c in per_query.columns if c not in {"query_id", *by}]
    return per_query.groupBy(*by).agg(*[F.round(F.avg(c), 6).alias(c) for c in names])


def post_metrics(queries: DataFrame, ranked: DataFrame, recall_at=(5, 10), mrr_depth: int = 10) -> DataFrame:
    """Per query (query_id, labels array) recall at each depth and reciprocal rank, of ranked (query_id, id, rank); repeated ids count at their first place, and places close up."""
    first = ranked.groupBy("query_id", "id").agg(F.min("rank").alias("_at"))
    placed = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_at")))
    labels = queries.select("query_id", F.explode(F.array_distinct("labels")).alias("id"))
    hits = labels.join(placed, ["query_id", "id"], "left")
    total = F.count("*")
    recalls = [F.round(F.count_if(F.col("rank") <= k) / total, 6).alias(f"recall_{k}") for k in recall_at]
    rr = F.round(F.coalesce(1.0 / F.min(F.when(F.col("rank") <= mrr_depth, F.col("rank"))), F.lit(0.0)), 6)
    return hits.groupBy("query_id").agg(*recalls, rr.alias("rr"))


def title_metrics(queries: DataFrame, ranked: DataFrame, depth: int = 5) -> DataFrame:
    """Per query (query_id, labels of titles) hit1, hit3, rr to four places, of ranked (query_id, title, rank) with repeats left in."""
    rel = ranked.where(F.col("rank") <= depth).join(queries.select("query_id", "labels"), "query_id").where(F.array_contains("labels", F.col("title")))
    first = queries.select("query_id").join(rel.groupBy("query_id").agg(F.min("rank").alias("r")), "query_id", "left")
    hit = lambda k: F.coalesce((F.col("r") <= k).cast("int"), F.lit(0))
    return first.select("query_id", hit(1).alias("hit1"), hit(3).alias("hit3"), F.round(F.coalesce(1.0 / F.col("r"), F.lit(0.0)), 4).alias("rr"))


def ann_recall(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """One row: the share of the k best ids of truth (query_id, id, rank) that found has among its k best."""
    a, b = (x.where(F.col("rank") <= k).select("query_id", "id") for x in (truth, found))
    n = a.count()
    return a.join(b, ["query_id", "id"]).agg(F.round(F.count("*") / F.lit(max(n, 1)), 6).alias("recall"))


def matrix(per_query: DataFrame, config: str, value: str, names: list[str]) -> DataFrame:
    """A row per query, a column per configuration."""
    return per_query.groupBy("query_id").pivot(config, names).agg(F.first(value))


def leaderboard(means: DataFrame, *by: str) -> DataFrame:
    return means.orderBy(*[F.desc(c) for c in by], *[c for c in means.columns if c not in by])


def rank_candidates(queries: DataFrame, posts: DataFrame, top_k: int = 8, early_replies: int = 3) -> DataFrame:
    """(query_id, post_id, review_score, candidate_reason, place): the best replies by BM25 within their topic and the earliest ones.

    queries (query_id, topic_id, question, source_ids) stand against the posts (topic_id, post_id, post_number, posted_at,
    text) of their topic without source_ids, whose own statistics count. Zero scores stay.
    """
    if top_k < 1 or early_replies < 0:
        raise ValueError("top_k must be positive and early_replies not negative")
    asked = queries.select("query_id", F.col("topic_id").alias("_topic"), "source_ids")
    replies = posts.join(asked, F.col("topic_id") == F.col("_topic")).where(~F.array_contains("source_ids", F.col("post_id")))
    tok = replies.select("query_id", "post_id", int_or_zero(F.col("post_number")).alias("post_number"), F.coalesce(F.col("posted_at").cast("string"), F.lit("")).alias("posted_at"), tokens(F.col("text")).alias("t"))
    stats = tok.groupBy("query_id").agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))
    tf = tok.select("query_id", "post_id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("query_id", "post_id", "dl", "term").agg(F.count("*").alias("tf"))
    raw = tf.groupBy("query_id", "term").agg(F.count("*").alias("df")).join(stats, "query_id").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("query_id").agg(F.avg("raw").alias("mean"))
    idf = raw.join(mean, "query_id").select("query_id", "term", "avgdl", F.when(F.col("raw") < 0, lexical.EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    wanted = lexical.query_terms(queries)
    k1, b = lexical.K1, lexical.B
    part = F.col("qn") * F.col("idf") * (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))))
    scores = tf.join(wanted, ["query_id", "term"]).join(idf, ["query_id", "term"]).groupBy("query_id", "post_id").agg(F.sum(part).alias("s"))
    rows = tok.drop("t").join(scores, ["query_id", "post_id"], "left").withColumn("review_score", F.round(F.coalesce("s", F.lit(0.0)), 6)).drop("s")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("review_score"), "post_number", "post_id"))
    early = F.row_number().over(Window.partitionBy("query_id").orderBy("post_number", "posted_at", "post_id"))
    rows = rows.withColumn("_best", best).withColumn("_early", early).where((F.col("_best") <= top_k) | (F.col("_early") <= early_replies))
    reason = F.when(F.col("_best") <= top_k, "bm25").otherwise("early_reply")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("review_score"), "post_number", "post_id"))
    return rows.select("query_id", "post_id", "review_score", reason.alias("candidate_reason"), place.alias("place"))


def review_status(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, status): queries (query_id) against labels (query_id, post_ids): no row or an empty list is pending, null is excluded, else reviewed."""
    marked = labels.select("query_id", "post_ids", F.lit(True).alias("_has"))
    status = F.when(F.col("_has").isNull() | (F.size("post_ids") == 0), "pending").when(F.col("post_ids").isNull(), "excluded").otherwise("reviewed")
    return queries.select("query_id").join(marked, "query_id", "left").select("query_id", status.alias("status"))


def label_problems(queries: DataFrame, labels: DataFrame, posts: DataFrame) -> DataFrame:
    """(problem, query_id, post_id) of labels (query_id, post_ids): unknown query, duplicate, missing post, wrong topic."""
    known = queries.select("query_id", F.col("topic_id").alias("_topic"))
    unknown = labels.join(known, "query_id", "left_anti").select(F.lit("unknown_query").alias("problem"), "query_id", F.lit(None).cast("string").alias("post_id"))
    each = labels.select("query_id", F.explode("post_ids").alias("post_id")).join(known, "query_id")
    again = each.groupBy("query_id", "post_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("problem"), "query_id", "post_id")
    missing = each.join(posts.select("post_id"), "post_id", "left_anti").select(F.lit("missing_post").alias("problem"), "query_id", "post_id")
    other = each.distinct().join(posts.select("post_id", "topic_id"), "post_id").where("topic_id <> _topic").select(F.lit("wrong_topic").alias("problem"), "query_id", "post_id")
    return unknown.union(again).union(missing).union(other)


def reviewed_set(queries: DataFrame, labels: DataFrame, posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reviewed, excluded) queries of a complete review; raises ValueError, naming ids only, in the order unknown, duplicate, missing, wrong topic, pending, nothing reviewed."""
    problems = label_problems(queries, labels, posts).limit(1000).collect()
    for kind in ("unknown_query", "duplicate", "missing_post", "wrong_topic"):
        ids = sorted({(r["query_id"], r["post_id"] or "") for r in problems if r["problem"] == kind})
        if ids:
            raise ValueError(f"{kind}: {ids[:20]}")
    status = review_status(queries, labels)
    counts = {r["status"]: r["n"] for r in status.groupBy("status").agg(F.count("*").alias("n")).collect()}
    if counts.get("pending"):
        raise ValueError(f"review is incomplete: {counts['pending']} pending queries")
    if not counts.get("reviewed"):
        raise ValueError("no query has a labelled answer")
    rows = queries.join(status, "query_id").join(labels, "query_id", "left")
    reviewed = rows.where("status = 'reviewed'").withColumnRenamed("labels", "source_problem_post_ids").withColumnRenamed("post_ids", "relevant_post_ids").drop("status")
    return reviewed, rows.where("status = 'excluded'").select("query_id", F.lit("no_verified_answer_in_thread").alias("reason"))


def missing_labels(labels: DataFrame, corpus: DataFrame, key: str = "id") -> DataFrame:
    """Labels that a corpus lacks."""
    return labels.select(key).distinct().join(corpus.select(key), key, "left_anti")


def coverage(labels: Column, top: Column) -> Column:
    """Number of distinct labels among the first ids of a ranking."""
    return F.size(F.array_intersect(labels, top))
