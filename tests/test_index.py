import sys
import urllib.error

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sparkrag import embed, generate
from sparkrag.config import Settings
from sparkrag.index.vectors import VectorIndex, clustered_vectors
from sparkrag.operators.evaluation import ann_recall
from sparkrag.sinks import scratch

# Models of this file travel to workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
CHUNK = "ordinal long, chunk_id string, text string, source string, embedding array<float>"


@pytest.fixture(scope="module")
def vectors(spark):
    rows = clustered_vectors(spark, 1200, 16).persist()
    return rows, rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))


def chunks(rows):
    return rows.select(F.col("id").alias("ordinal"), F.col("id").cast("string").alias("chunk_id"), F.lit("t").alias("text"), F.lit("s").alias("source"), F.col("vec").alias("embedding"))


def built(spark, rows, kind, **params):
    index = VectorIndex.create(spark, scratch(spark, kind), 16, kind, **params)
    index.add(chunks(rows))
    return VectorIndex.load(spark, index.path, 16)


def test_types_against_exact_search(spark, vectors):
    rows, queries = vectors
    flat = built(spark, rows, "flat").search(queries, 10)
    whole = built(spark, rows, "ivf", nlist=12, nprobe=12).search(queries, 10)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, flat.collect()))
    assert all(r["query_id"] == r["id"] for r in flat.where("rank = 1").collect())
    for kind, params, least in (("ivf", {"nlist": 12, "nprobe": 4}, 0.9), ("hnsw", {}, 0.9), ("ivfpq", {"nlist": 12, "nprobe": 12, "pq_m": 8}, 0.5)):
        assert ann_recall(flat, built(spark, rows, kind, **params).search(queries, 10), 10).first()["recall"] >= least, kind


def test_search_makes_no_row_per_pair(spark, vectors):
    rows, queries = vectors
    for kind, params in (("ivf", {"nlist": 12, "nprobe": 12}), ("ivfpq", {"nlist": 12, "nprobe": 12, "pq_m": 8}), ("hnsw", {})):
        plan = built(spark, rows, kind, **params).search(queries, 10)._jdf.queryExecution().executedPlan().toString()
        assert "qcells" in plan, kind


def test_index_contract(spark, vectors):
    rows, queries = vectors
    path = scratch(spark, "i")
    with pytest.raises(FileNotFoundError):
        VectorIndex.load(spark, path)
    with pytest.raises(TypeError, match="odd"):
        VectorIndex.create(spark, path, 16, odd=1)
    with pytest.raises(NotImplementedError):
        VectorIndex.create(spark, path, 16, "tree")
    with pytest.raises(ValueError, match="backend"):
        VectorIndex.create(spark, path, 16, backend="other")
    with pytest.raises(ValueError, match="divide"):
        VectorIndex.create(spark, path, 16, "ivfpq", pq_m=5)
    index = VectorIndex.create(spark, path, 3)
    asked = spark.createDataFrame([(1, [0.9, 0.1, 0.0])], "query_id long, qvec array<float>")
    assert index.size == 0 and index.search(asked, 5).count() == 0
    unit = spark.createDataFrame([(0, "a", "x", "s", [1.0, 0.0, 0.0]), (1, "a", "y", "s", [0.0, 1.0, 0.0])], CHUNK)
    assert index.add(unit) == 2 and index.add(spark.createDataFrame([(0, "c", "z", "s", [0.0, 0.0, 1.0])], CHUNK)) == 3
    assert [(r["ordinal"], r["chunk_id"]) for r in index.chunks().orderBy("ordinal").collect()] == [(0, "a"), (1, "a"), (2, "c")]
    assert [r["id"] for r in index.search(asked, 9).orderBy("rank").collect()] == [0, 1, 2] and index.search(asked, 0).count() == 0
    with pytest.raises(Exception, match="does not have 3 dimensions") as e:
        index.add(spark.createDataFrame([(0, "secret", "secret", "s", [1.0])], CHUNK))
    assert "secret" not in str(e.value).split("JVM stacktrace")[0]
    with pytest.raises(ValueError, match="3 dimensions, not 4"):
        VectorIndex.load(spark, path, 4)
    index.check_manifest(embed.Hashing(3))
    index.save_manifest(embed.Hashing(3))
    index.check_manifest(embed.Hashing(3))
    with pytest.raises(ValueError, match="built with hashing"):
        index.check_manifest(embed.Endpoint("http://x", "m", 3))


def test_providers(spark):
    texts = spark.createDataFrame([("Red cat",), ("red CAT!",), ("dog",)], "text string")
    got = [r["embedding"] for r in embed.with_embedding(texts, embed.Hashing(64)).collect()]
    assert got[0] == got[1] != got[2] and abs(np.linalg.norm(got[0]) - 1) < 1e-6
    sparse = {r["axis"]: r["weight"] for r in embed.sparse_vectors(spark.createDataFrame([(1, "Red cat")], "id int, text string"), "id", dim=64).collect()}
    assert all(abs(got[0][i] - w) < 1e-6 for i, w in sparse.items()) and len(sparse) == sum(x != 0 for x in got[0])
    calls = []
    e = embed.Endpoint("http://x/", "m", 3, lambda url, body: calls.append((url, len(body["inputs"]))) or [[3.0, 4.0, 0.0]] * len(body["inputs"]))
    assert e.embed(["a"], False) == [[3.0, 4.0, 0.0]] and calls == [("http://x/embed", 1)]
    single = embed.provider("managed", "amazon.titan-x", 256, invoke=lambda m, body: {"embedding": [float(len(body["inputText"]))]})
    assert single.embed(["a", "bbb"], True) == [[1.0], [3.0]]
    batch = embed.provider("managed", "other", 1536, invoke=lambda m, body: {"embeddings": [[1.0 if body["input_type"] == "search_query" else 2.0]] * len(body["texts"])})
    assert batch.embed(["a"], True) == [[1.0]] and batch.embed(["a"], False) == [[2.0]]
    for bad in (lambda: embed.provider("odd"), lambda: embed.provider("managed", "amazon.titan-x", 1536, invoke=None), lambda: embed.normalised([[0.0]], 1, 1), lambda: embed.normalised([[float("inf")]], 1, 1), lambda: embed.normalised([[1.0]], 2, 1)):
        with pytest.raises(ValueError):
            bad()


def test_terms_that_cancel_out(spark):
    # Two tokens on one axis with opposite signs: no vector, but a text that is kept and found by its tokens.
    words = {}
    for i in range(1000):
        axis, sign = embed.axis_of(f"w{i}", 64)
        if (axis, -sign) in words:
            text = f"{words[axis, -sign]} w{i}"
            break
        words.setdefault((axis, sign), f"w{i}")
    rows = spark.createDataFrame([(0, "c0", text, "s0"), (1, "c1", "the pump", "s1"), (2, "c2", "the lamp", "s2")], "ordinal long, chunk_id string, text string, source string")
    got = [r["embedding"] for r in embed.with_embedding(rows, embed.Hashing(64)).orderBy("ordinal").collect()]
    assert got[0] is None and len(got[1]) == len(got[2]) == 64
    for kind in ("flat", "ivf", "hnsw", "ivfpq"):
        index = VectorIndex.create(spark, scratch(spark, kind), 64, kind, nlist=2, nprobe=2, pq_m=16, hnsw_ef_search=128)
        assert index.add(embed.with_embedding(rows, embed.Hashing(64))) == 3
        asked = spark.createDataFrame([(1, got[1]), (2, None)], "query_id long, qvec array<float>")
        assert sorted((r["query_id"], r["id"]) for r in index.search(asked, 3).collect()) == [(1, 1), (1, 2)], kind
    e = generate.Engine.ingest(spark, scratch(spark, "engine"), rows, embed.Hashing(64), Settings(retrieval_mode="hybrid"))
    assert e.query(text)["citations"][0]["source"] == "s0" and e.query("pump")["citations"][0]["source"] == "s1"


class Fixed:
    def __init__(self, answer, model="fixed"):
        self.answer, self.model = answer, model

    def generate(self, system, prompt, max_tokens):
        if isinstance(self.answer, Exception):
            raise self.answer
        return self.answer


def test_router():
    r = generate.Router(Fixed(generate.Unavailable("x"), "a"), Fixed("yes", "b"))
    assert r.model == "a" and r.generate("", "", 1) == "yes" and r.model == "b"
    with pytest.raises(generate.BadRequest):
        generate.Router(Fixed(generate.BadRequest("x")), Fixed("yes")).generate("", "", 1)
    one = Fixed("x")
    with pytest.raises(ValueError):
        generate.Router(one, one)

    def fails(error):
        def send(url, body):
            raise error

        return generate.Http("http://x", "m", send)

    for code, kind in ((408, generate.Unavailable), (429, generate.Unavailable), (503, generate.Unavailable), (404, generate.BadRequest)):
        with pytest.raises(kind):
            fails(urllib.error.HTTPError("u", code, "", {}, None)).generate("", "", 1)
    with pytest.raises(generate.Unavailable):
        fails(TimeoutError()).generate("", "", 1)
    with pytest.raises(generate.BadRequest):
        generate.Http("http://x", "m", lambda u, b: {}).generate("", "", 1)
    assert generate.Http("http://x", "m", lambda u, b: {"choices": [{"message": {"content": "hi"}}]}).generate("", "", 1) == "hi"


def test_engine(spark):
    texts = ["The pump feeds oil. It is red.", "The lamp gives light.", "Brakes stop the car."]
    rows = spark.createDataFrame([(i, f"c{i}", t, f"s{i}") for i, t in enumerate(texts)], "ordinal long, chunk_id string, text string, source string")
    path = scratch(spark, "engine")
    e = generate.Engine.ingest(spark, path, rows, embed.Hashing(64), Settings(retrieval_mode="hybrid"))
    r = e.query("what feeds oil to the pump", 2)
    assert r["answer"] == "The pump feeds oil [1]" and r["grounded"] and r["citations"][0]["marker"] == 1 and r["citations"][0]["source"] == "s0" and r["model"] == "extractive"
    assert e.health()["index_size"] == 3
    for bad in (("", None), ("x", 0), ("x", 21)):
        with pytest.raises(ValueError):
            e.query(*bad)
    for answer, cited, grounded in (("so [1, 2, 9]", [1, 2], True), ("no [3]", [], True), ("INSUFFICIENT_CONTEXT [1]", [], False)):
        got = generate.Engine(spark, path, embed.Hashing(64), Fixed(answer), Settings(rerank=True, retrieval_mode="hybrid")).query("pump lamp", 2)
        assert [c["marker"] for c in got["citations"]] == cited and got["grounded"] == grounded
    nothing = generate.Engine(spark, path, embed.Hashing(64), Fixed(RuntimeError("not asked")), Settings())
    nothing.retrieve = lambda q, k=None: spark.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
    assert nothing.query("pump")["answer"] == "INSUFFICIENT_CONTEXT"
    with pytest.raises(ValueError):
        generate.Engine(spark, path, embed.Endpoint("http://x", "m", 64))
