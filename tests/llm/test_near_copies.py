import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sparkrag.llm import near_copies, op7_simhash

DOCS = "doc_id bigint, text string, source string"


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}


def classes(texts):
    """The component of each text, all pairs compared."""
    sets, part = [grams(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                part = [part[j] if x == part[i] else x for x in part]
    return part


def planted():
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnop", k=4)) for _ in range(500)]
    line = " ".join(rnd.choices(vocabulary, k=14))
    texts = []
    for n in (1, 3, 5, 8, 12, 20, 30, 45, 60, 120, 300, 900):
        for _ in range(4):
            w = rnd.choices(vocabulary, k=n)
            texts.append(" ".join(w))
            for changes in (1, n // 60 + 1, n // 45 + 1, n // 30 + 1):
                c = list(w)
                for _ in range(changes):
                    c[rnd.randrange(n)] = rnd.choice(vocabulary)
                texts.append(" ".join([*c, line] if rnd.random() < 0.2 else c))
            texts.append(" ".join(w[: n - n // 10]).upper())
    return texts + ["", None, " \n"]


def test_near_copies_equal_brute_force(spark):
    texts = planted()
    part = classes(texts)
    first = {c: i for i, c in reversed(list(enumerate(part)))}
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS), "").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(first.values())
    assert len(first) < len({t for t in texts}) - 50


def test_hot_group_equals_brute_force(spark):
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnop", k=4)) for _ in range(500)]
    base, texts = rnd.choices(vocabulary, k=80), []
    for _ in range(300):
        c = list(base)
        for _ in range(rnd.randint(1, 5)):
            c[rnd.randrange(80)] = rnd.choice(vocabulary)
        texts.append(" ".join(c))
    got = near_copies.keep_one(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS))
    assert got.count() == len(set(classes(texts)))


def test_linked_sets_share_a_key():
    rnd = np.random.default_rng(5)
    for n in [*range(1, 70), 100, 150, 225, 340, 700, 2000, 9000]:
        for _ in range(30 if n < 400 else 5):
            a = np.unique(rnd.integers(0, 1 << 64, n, dtype=np.uint64))
            m = int(rnd.integers(-(-4 * n // 5), 5 * n // 4 + 1))
            common = -(-4 * (n + m) // 9)
            if common > min(n, m):
                continue
            b = np.unique(np.r_[rnd.permutation(a)[:common], rnd.integers(0, 1 << 64, m - common, dtype=np.uint64)])
            assert set(near_copies.keys_of(a)) & set(near_copies.keys_of(b)), (n, m)


def test_empty(spark):
    assert near_copies.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_null_and_repeated_ids_stay(spark, tmp_path):
    rnd = random.Random(13)
    text = lambda: " ".join("".join(rnd.choices("abcdefghijklmnop", k=5)) for _ in range(60))
    leak = text()
    rows = [(None, text(), "s"), (None, text(), "s"), (7, text(), "s"), (7, text(), "s"), (7, text() + " " + leak, "s")]
    docs = spark.createDataFrame([*rows, rows[0], rows[2]], DOCS)
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.distinct().collect()))
    clean = corpus_pipeline.decontaminate(spark, kept, str(tmp_path))
    assert {r["text"] for r in clean.collect()} == {t for _, t, _ in rows[:4]}
    mixed = [r["text"] for r in corpus_pipeline.mix(spark, clean, "").collect()]
    assert {t: mixed.count(t) for t in set(mixed)} == {t: 2 for _, t, _ in rows[:4]} or len(mixed) == 6 and max(map(mixed.count, mixed)) <= 2


def test_links_of_fingerprints(spark, monkeypatch):
    """op7's links are what the stage begins with: without any covering class they alone merge the near copies within its radius, after the exact check."""
    rnd = random.Random(14)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnop", k=4)) for _ in range(500)]
    texts = []
    for _ in range(8):
        w = rnd.choices(vocabulary, k=500)
        texts.append(" ".join(w))
        for i in (1, 250, 499):
            texts.append(" ".join([*w[:i], rnd.choice(vocabulary), *w[i + 1 :]]))
    # Equal fingerprints, for 3-word shingles in one order and another, but few five-word shingles in common.
    lead = rnd.choices(vocabulary, k=2)
    loops = [[*lead, *rnd.choices(vocabulary, k=1)] for _ in range(12)]
    texts += [" ".join(x for loop in order for x in loop) + " " + " ".join(lead) for order in (loops, rnd.sample(loops, 12))]
    prints, part = [op7_simhash.fingerprint(t.encode()) for t in texts], classes(texts)
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= op7_simhash.RADIUS]
    assert prints[-1] == prints[-2] and part[-1] != part[-2] and len(near) > 8
    group = list(range(len(texts)))
    for i, j in near:
        if part[i] == part[j]:
            group = [group[j] if x == group[i] else x for x in group]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    keyed = docs.select(F.col("doc_id").alias("k"), "text")
    pairs = {(r["a"], r["b"]) for r in near_copies.printed(keyed).collect()}
    assert pairs <= set(near)
    assert near_copies.keep_one(docs).count() == len(set(part))
    monkeypatch.setattr(near_copies, "members", lambda texts: spark.createDataFrame([], "key bigint, k bigint, low bigint"))
    assert near_copies.keep_one(docs).count() == len(set(group)) < len(texts)
