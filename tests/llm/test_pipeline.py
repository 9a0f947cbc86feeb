import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkrag.llm import op3_tokens
from sparkrag.llm.common import mark, release

from .test_near_copies import classes

#: Names that stages use for themselves are columns of the input here.
EXTRA = ("copies", "n_words", "kept", "ledger", "row", "k", "_k", "rank", "size", "key", "part", "id")
DOCS = "doc_id bigint, text string, source string, " + ", ".join(f"{x} string" for x in EXTRA)


@pytest.fixture(scope="module")
def world(tmp_path_factory, spark):
    rnd = random.Random(21)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(3, 7))) for _ in range(1500)]
    draw = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    items = [draw(30) for _ in range(3)]
    rows = [(i, draw(rnd.randint(55, 200)), f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "s0") for i in range(5)]
    for i in range(5, 10):
        words = rows[i][1].split()
        words[len(words) // 2] = "changed"
        rows.append((100 + i, " ".join(words), "s1"))
    rows += [(200 + j, f"{draw(60)} {x} {draw(60)}", "s2") for j, x in enumerate(items)]
    rows += [(300, "few words", "s0"), (301, "same three words " * 40, "s0"), (302, draw(60) + " ### $$$ %%% &&& *** |||" * 4, "s1"), (303, None, "s1"), (304, "", None)]
    rows += [(None, draw(80), "s0"), (None, draw(90), None), (7, draw(70), "s2"), (305, draw(20000), "s2")]
    folder = str(tmp_path_factory.mktemp("sf"))
    full = [(*r, *["x"] * len(EXTRA)) for r in rows]
    spark.createDataFrame(full, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items, folder


def rejected(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    again = {i + o for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for o in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip()]
    dup, chars, symbols = len(lines) - len(set(lines)), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or "")
    return len(w) < 50 or 100 * len(again) > 50 * len(w) or 5 * symbols > len(w) and symbols >= 20 or chars > 25 * len(w) or chars < 2 * len(w) or dup > 5 and 100 * dup > 5 * len(w)


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")


def test_stages_equal_plain_versions(spark, world):
    rows, items, folder = world
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    quality = steps["quality_rules"](spark, docs, folder)
    assert quality.columns == docs.columns
    kept = sorted(quality.collect(), key=key)
    assert sorted(str(r[:2]) for r in kept) == sorted(str(r[:2]) for r in rows if not rejected(r[1]))

    near = steps["near_duplicates"](spark, quality, folder)
    part = classes([r["text"] for r in kept])
    want = {}
    for r, c in zip(kept, part):
        want.setdefault(c, r)
    got = sorted(near.collect(), key=key)
    assert [(r["doc_id"], r["text"]) for r in got] == sorted(((r["doc_id"], r["text"]) for r in want.values()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    assert near.columns == docs.columns and all(r["copies"] == r["k"] == "x" for r in got)

    clean = steps["decontamination"](spark, near, folder)
    left = sorted(clean.collect(), key=key)
    assert [r["text"] for r in left] == [r["text"] for r in got if not any(x in r["text"] for x in items)]

    mixed = steps["mixing"](spark, clean, folder)
    out = mixed.collect()
    assert mixed.columns == docs.columns
    counts = Counter((r["doc_id"], r["text"]) for r in out)
    assert max(counts.values()) <= 2 and set(counts) <= {(r["doc_id"], r["text"]) for r in left}
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in left:
        n = len(r["text"].split())
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    for r in out:
        taken[r["source"]] += len(r["text"].split())
    for source, target in targets(sizes).items():
        assert abs(taken[source] - target) <= 2 * largest[source], source

    tokens = steps["token_output"](spark, mixed, folder).orderBy("start").collect()
    t, at = Tokenizer.from_file(op3_tokens.default_tokenizer()), 0
    want = Counter((d, len(ids), zlib.crc32(ids.tobytes())) for (d, text), n in counts.items() for ids in [np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")] for _ in range(n))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokens) == want
    for r in tokens:
        assert r["start"] == at
        at += r["n_tokens"]


def targets(sizes):
    """Targets by giving out what is over until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        for s in over or open_:
            out[s] = 2 * sizes[s] if over else weight[s] * level
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over or open_
    return out


def test_run_equals_its_stages_and_leaves_one_folder(spark, world):
    _, _, folder = world
    start = mark()
    out = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(map(str, out.drop("start").collect())) == sorted(map(str, docs.drop("start").collect()))
    assert mark() > start
    release(spark, start, "")


def test_empty_table(spark, world, tmp_path):
    _, _, folder = world
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_repeated_rows_in_a_later_stage(spark, world):
    _, _, folder = world
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 20")
    twice = docs.union(docs)
    assert corpus_pipeline.decontaminate(spark, twice, folder).count() == 2 * corpus_pipeline.decontaminate(spark, docs, folder).count()
    mixed = Counter(r["text"] for r in corpus_pipeline.mix(spark, twice, folder).collect())
    assert max(mixed.values()) <= 4
