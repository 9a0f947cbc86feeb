"""What workers hold: nothing of an earlier stage, and few rows of the latent space."""

import tracemalloc

import numpy as np
import pyarrow as pa

from sparkrag.llm import op3_tokens
from sparkrag.llm import op10_decontaminate as op10
from sparkrag.llm.common import lean


def peak_mb(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_workers_of_other_stages_drop_the_encoder(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('some words ', id) as text")

    def kept(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [op3_tokens.encoder_of.cache_info().currsize]})

    assert op3_tokens.encode_and_read(docs, op3_tokens.default_tokenizer()).count() == 4000
    op10.leaks(docs, spark.createDataFrame([(0, "some words that no document has")], "item_id bigint, text string")).count()
    assert {r[0] for r in spark.range(64).repartition(16).mapInArrow(kept, "n bigint").collect()} == {0}
    op3_tokens.encoder_of(op3_tokens.default_tokenizer())
    assert list(lean(lambda batches: batches)(iter([1, 2]))) == [1, 2]
    assert op3_tokens.encoder_of.cache_info().currsize == 0


def test_product_and_search_hold_few_rows():
    rng, terms, sizes = np.random.default_rng(3), 500, [1, 64, 65, 0, 60000, 900, 69000]
    ids = rng.integers(-1, terms, sum(sizes)).astype(np.int32)
    starts = np.cumsum([0, *sizes])
    idf, g = rng.random(terms) + 0.1, rng.standard_normal((terms, op10.RANK))
    rough = (g * idf[:, None]).astype(np.float32)
    out = np.zeros((terms, op10.RANK))
    assert peak_mb(lambda: op10.add_product(out, starts, ids, idf, rough)) < 30
    passages = [ids[i : min(i + op10.PASSAGE, end)] for start, end in zip(starts, starts[1:]) for i in range(start, end, op10.PASSAGE)]
    a = np.array([np.bincount(x[x >= 0], minlength=terms) * idf for x in passages])
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)
    assert np.allclose(out, a.T @ (a @ g), rtol=1e-3, atol=1e-3)

    names = {f"w{i}".encode(): i for i in range(terms)}
    items = [op10.Item(j, " ".join(f"w{i}" for i in rng.integers(0, terms, 600)), names) for j in range(5)]
    text = np.concatenate([np.array(x.words, np.int32) for _ in range(20) for x in items])
    found: list = []
    searcher = op10.Searcher(items, np.bincount(text, minlength=terms), rough)
    assert peak_mb(lambda: found.extend(searcher.search(np.array([0, len(text)]), text))) < 100
    assert sorted(found) == [(0, j, 1.0) for j in range(5)]
