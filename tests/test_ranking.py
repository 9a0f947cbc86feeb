import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkrag import embed
from sparkrag.functions import stats
from sparkrag.index import lexical
from sparkrag.operators import evaluation, ranking
from sparkrag.sinks import scratch

LISTS = "query_id int, list_idx int, id string, rank int"


def ranks(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def test_list_fusion_keeps_first_sight_order(spark):
    rows = spark.createDataFrame([(1, 0, "b", 0), (1, 1, "a", 0)], LISTS)
    assert ranks(ranking.fuse_lists(rows)) == ["b", "a"]
    rows = spark.createDataFrame([(1, 0, "a", 0), (1, 0, "b", 1), (1, 1, "c", 0), (1, 1, "b", 1)], LISTS)
    got = ranking.fuse_lists(rows).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["b", "a", "c"] and abs(got[0]["score"] - 2 / 61) < 1e-12
    twice = spark.createDataFrame([(1, 0, "a", 0), (1, 0, "b", 1), (1, 0, "b", 2)], LISTS)
    assert ranks(ranking.fuse_lists(twice)) == ["b", "a"]


def test_id_fusion_ignores_repeats(spark):
    rows = spark.createDataFrame([(1, 0, "dense", 1), (1, 0, "both", 2), (1, 1, "both", 1), (1, 1, "bm", 2), (1, 1, "bm", 3), (1, 1, "bm", 4)], LISTS)
    assert ranks(ranking.fuse_ids(rows)) == ["both", "dense", "bm"]
    assert ranks(ranking.fuse_ids(spark.createDataFrame([(1, 0, "b", 1), (1, 1, "a", 1)], LISTS), top_k=1)) == ["a"]
    with pytest.raises(ValueError):
        ranking.fuse_ids(rows, 0)


def test_collapse_and_rerank(spark):
    found = spark.createDataFrame([(1, "c1", 1), (1, "c2", 2), (1, "c3", 3)], "query_id int, id string, rank int")
    parents = spark.createDataFrame([("c1", "p"), ("c2", "p"), ("c3", "q")], "id string, post_id string")
    assert [(r["post_id"], r["rank"]) for r in ranking.collapse(found, parents).orderBy("rank").collect()] == [("p", 1), ("q", 2)]
    assert ranking.missing_parents(found, parents.where("id <> 'c3'")).first()["id"] == "c3"
    rows = spark.createDataFrame([(1, "red cat", "a", "blue dog", 1), (1, "red cat", "b", "a cat, red", 2), (1, "red cat", "c", "red", 3)], "query_id int, question string, id string, text string, rank int")
    assert ranks(ranking.rerank(rows, top_k=2)) == ["b", "c"]
    assert ranks(ranking.rerank(rows, lambda q, t: [len(x) for x in t])) == ["b", "a", "c"]


def plain_bm25(docs, query):
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}
    return [sum(idf.get(q, 0) * (d.count(q) * 2.5 / (d.count(q) + 1.5 * (0.25 + 0.75 * len(d) / avg))) for q in query) for d in docs]


def test_bm25_equals_plain_python(spark):
    rnd = random.Random(3)
    docs = [[rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 12))] for _ in range(30)] + [[]]
    queries = {0: "a a b", 1: "h zz", 2: "zz"}
    path = scratch(spark, "postings")
    lexical.build(spark.createDataFrame([(i, " ".join(d) or None) for i, d in enumerate(docs)], "doc_id int, text string"), path)
    got = lexical.search(spark, path, spark.createDataFrame(list(queries.items()), "query_id int, question string"), 12).collect()
    for q, text in queries.items():
        scores = [round(x, 6) for x in plain_bm25(docs, text.split())]
        holds = [i for i, d in enumerate(docs) if set(d) & set(text.split())]
        best = sorted(holds, key=lambda i: (-scores[i], i))[:12]
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [i for i in best if scores[i] > 0]


def test_index_is_built_without_a_shuffle_of_rows_per_term(spark):
    docs = spark.createDataFrame([(i, f"red cat {i}") for i in range(9)], "doc_id int, text string")
    for rows in (lexical.postings(docs), embed.hashed_lists(docs.withColumnRenamed("doc_id", "id"))):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_many_queries_over_odd_ids_equal_their_sql(spark, tmp_path):
    import duckdb

    from sparkrag.plans import queries

    # Ids that repeat, with equal and other lengths, signs beyond ASCII, texts without tokens; more queries than a block has.
    texts = ["Red cat, the DOG", "red red cat", "ÄÖ red\u212a cat", "", None, "...", "the the cat dog x9", "dog cat red"]
    spark.createDataFrame([(i % 30, texts[i % 7] if i % 11 else texts[i % 8]) for i in range(44)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, ["cat dog", "red", "the x9 the", "zz", None][i % 5]) for i in range(300)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("bm25_benchmark", "hashed_dense_topk"):
        df, got = queries.QUERIES[name](spark, str(tmp_path)), con.execute(queries.SQL[name])
        names = [d[0] for d in got.description]
        assert sorted(map(tuple, df.select(*names).collect())) == sorted(got.fetchall()), name


def test_dense_search_takes_every_hundredth_row(spark, tmp_path):
    from sparkrag.plans import queries

    rnd = random.Random(2)
    rows = [(i, [rnd.choice([-1.0, 0.5, 1.0]) for _ in range(4)], i % 3) for i in range(5200)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in queries.QUERIES["dense_topk_hundredth"](spark, str(tmp_path)).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert sorted(got) == list(range(0, 5200, 100))
    for q, ids in got.items():
        best = sorted(range(5200), key=lambda i: (-dot(rows[q][1], rows[i][1]), i))[:20]
        assert [ids[i] for i in range(1, 21)] == best
    assert queries.QUERIES["metrics_hundredth"](spark, str(tmp_path)).count() == 52


def test_metrics_count_queries_without_results(spark):
    ranked = spark.createDataFrame([(1, True, 2), (1, False, 1)], "query_id int, rel boolean, rank int")
    got = {r["query_id"]: r for r in evaluation.metrics(ranked, spark.createDataFrame([(1, 1), (2, 3)], "query_id int, total int"), 5).collect()}
    assert got[1]["rr"] == 0.5 and got[1]["hit1"] == 0 and got[1]["hit3"] == 1 and got[2]["rr"] == got[2]["ndcg"] == 0.0
    queries = spark.createDataFrame([(1, ["a", "b"]), (2, ["z"])], "query_id int, labels array<string>")
    found = spark.createDataFrame([(1, x, i) for i, x in enumerate("xxxxxa", 1)], "query_id int, id string, rank int")
    got = {r["query_id"]: r for r in evaluation.post_metrics(queries, found).collect()}
    assert (got[1]["recall_5"], got[1]["rr"], got[2]["recall_10"], got[2]["rr"]) == (0.5, 0.5, 0.0, 0.0)


def test_percentiles(spark):
    import statistics

    rnd = random.Random(5)
    data = {"a": [40.0, 10.0, 30.0, 20.0], "b": [rnd.gauss(0, 30) for _ in range(200)], "c": [7.0]}
    rows = spark.createDataFrame([(g, v) for g, vs in data.items() for v in [*vs, None]], "g string, v double")
    got = {r["g"]: r for r in stats.percentiles(rows, "g", "v", [50, 95], span=3.0).collect()}
    assert (got["a"]["linear50"], got["a"]["nearest50"], got["a"]["linear95"], got["a"]["nearest95"]) == (25.0, 20.0, pytest.approx(38.5), 40.0)
    assert got["b"]["exclusive95"] == pytest.approx(statistics.quantiles(data["b"], n=20)[18]) and got["b"]["n"] == 200 and got["c"]["linear95"] == 7.0
    m = {r["g"]: r["median"] for r in stats.upper_median(rows, "g", "v", 3.0).collect()}
    assert m["a"] == 30.0 and m["b"] == sorted(data["b"])[100]


def test_label_review(spark):
    queries = spark.createDataFrame([("q1", "t1", "?", ["s"]), ("q2", "t1", "?", ["s"])], "query_id string, topic_id string, question string, labels array<string>")
    posts = spark.createDataFrame([("p1", "t1"), ("p2", "t2")], "post_id string, topic_id string")
    labels = lambda rows: spark.createDataFrame(rows, "query_id string, post_ids array<string>")
    for rows, says in (
        ([("q9", ["p1"])], "unknown_query"), ([("q1", ["p1", "p1"])], "duplicate"), ([("q1", ["p7"])], "missing_post"), ([("q1", ["p2"])], "wrong_topic"),
        ([("q1", ["p1"]), ("q2", [])], "pending"), ([("q1", ["p1"])], "pending"), ([("q1", None), ("q2", None)], "no query"),
    ):
        with pytest.raises(ValueError, match=says):
            evaluation.reviewed_set(queries, labels(rows), posts)
    reviewed, excluded = evaluation.reviewed_set(queries, labels([("q1", ["p1"]), ("q2", None)]), posts)
    assert [(r["query_id"], r["relevant_post_ids"], r["source_problem_post_ids"]) for r in reviewed.collect()] == [("q1", ["p1"], ["s"])]
    assert excluded.first()["reason"] == "no_verified_answer_in_thread"


def test_answer_candidates(spark):
    posts = spark.createDataFrame([("t", str(i), i, "", text) for i, text in enumerate(["my car fails", "try this", "car fails often: fix the pump", "thanks", "car"])], "topic_id string, post_id string, post_number int, posted_at string, text string")
    q = spark.createDataFrame([("q", "t", "car fails", ["0"])], "query_id string, topic_id string, question string, source_ids array<string>")
    got = evaluation.rank_candidates(q, posts, top_k=1, early_replies=2).orderBy("place").collect()
    assert [(r["post_id"], r["candidate_reason"]) for r in got][0][1] == "bm25" and {r["post_id"] for r in got} >= {"1", "2"}
    assert evaluation.rank_candidates(q, posts.where("post_id = '0'")).count() == 0
    with pytest.raises(ValueError):
        evaluation.rank_candidates(q, posts, top_k=0)
