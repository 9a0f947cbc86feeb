import random

import numpy as np
import pytest

from sparkrag.llm import op10_decontaminate as op10

DOCS = "doc_id bigint, text string, item_id string, score string"


@pytest.fixture(scope="module")
def language():
    rnd = random.Random(7)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 8))) for _ in range(4000)]
    weights = [1 / (i + 3) for i in range(len(words))]
    return rnd, lambda n: rnd.choices(words, weights, k=n)


def worded(rnd, item, replaced, draw):
    return [draw(1)[0] if rnd.random() < replaced else w for w in item]


def test_paraphrases_are_found_and_clean_documents_are_not(spark, language):
    rnd, draw = language
    items = [draw(rnd.randint(15, 60)) for _ in range(40)]
    planted, rows = {}, []
    for rate in (0.0, 0.1, 0.2):
        for j, item in enumerate(items):
            planted[len(rows)] = (rate, j)
            rows.append(" ".join(draw(rnd.randint(0, 200)) + worded(rnd, item, rate, draw) + draw(rnd.randint(0, 200))))
    rows += [" ".join(draw(rnd.randint(1, 600))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(rows)], DOCS)
    bench = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in op10.leaks(docs, bench).collect()}
    caught = {rate: sum((i, j) in found for i, (r, j) in planted.items() if r == rate) / len(items) for rate in (0.0, 0.1, 0.2)}
    assert caught[0.0] == 1 and min(caught.values()) >= 0.9, caught
    assert found <= {(i, j) for i, (_, j) in planted.items()}


def test_gate_loses_nothing_that_the_last_check_keeps(language):
    rnd, draw = language
    terms = {}
    items = [op10.Item(j, " ".join(draw(rnd.randint(4, 40))), terms) for j in range(25)]
    texts = []
    for x in items:
        back = {i: w for w, i in terms.items()}
        plain = [back[i].decode() for i in x.words]
        texts += [" ".join(draw(30) + worded(rnd, plain, rate, draw) + draw(30)) for rate in (0.0, 0.2, 0.4, 0.5)]
    rows = [np.array([terms.get(w, -1) for w in op10.split_words(t.encode())], np.int32) for t in texts]
    starts, ids = np.cumsum([0, *map(len, rows)]), np.concatenate(rows)
    df = np.bincount(ids[ids >= 0], minlength=len(terms)).astype(float)
    space = np.random.default_rng(1).standard_normal((len(terms), op10.RANK)).astype(np.float32)
    got = {(d, i) for d, i, _ in op10.Searcher(items, df, space, cosine=-2.0).search(starts, ids)}
    want = set()
    for d, row in enumerate(rows):
        for x in items:
            n, step = len(x.words), max(1, len(x.words) // 4)
            regions = [row[max(0, s - step) : s + n + step].tolist() for s in range(0, len(row), step)]
            if any(x.score(r) > 0 for r in regions):
                want.add((d, x.item_id))
    assert got == want and len(want) >= 50


def test_small_equal_and_empty_items(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat today", None, None), (1, "the cat sat on the mat today", None, None), (None, "x the cat sat on the mat y", None, None), (3, None, None, None), (4, "", None, None)], DOCS)
    bench = spark.createDataFrame([(1, "the"), (2, "cat sat on the mat"), (3, "cat sat on the mat"), (4, None), (5, ""), (6, "mat the on sat cat")], "item_id bigint, text string")
    found = sorted((r["doc_id"] or 0, r["item_id"]) for r in op10.leaks(docs, bench).collect())
    assert found == [(0, 2), (0, 3), (1, 2), (1, 2), (1, 3), (1, 3)]
    assert op10.leaks(docs, bench.limit(0)).count() == 0
