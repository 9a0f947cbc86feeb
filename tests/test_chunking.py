import random

import pytest
from pyspark.sql import functions as F

from sparkrag.config import ForumChunks
from sparkrag.functions import text as T
from sparkrag.operators import chunking

POSTS = "topic_id string, topic_title string, post_id string, post_number int, posted_at string, text string"


def dump(parts=180):
    return "VCDS FULL SCAN\nAddress 09: Cent\nASAM Dataset: x\n" + "\n".join(f"IDE{i:05d}-ENG{i:06d}-value {i}: " + "word " * 20 for i in range(parts)) + "\nElapsed Time: 5"


def test_splits_keep_budget_overlap_and_text():
    rnd = random.Random(3)
    for _ in range(60):
        words = ["".join(rnd.choices("abcdé", k=rnd.randint(1, 8))) + rnd.choice(["", "", ",", ".", ". ", "!", "\n\n", ";"]) for _ in range(rnd.randint(0, 200))]
        text = " ".join(words)
        budget = rnd.randint(4, 40)
        overlap = rnd.randint(0, budget - 1)
        parts = chunking.split(text, budget, overlap)
        assert all(chunking.count(p) <= budget for p in parts)
        tokens = chunking.TOKEN.findall(text)
        at = 0
        for p in parts:
            own = chunking.TOKEN.findall(p)
            start = next(s for s in range(max(0, at - overlap), at + 1) if tokens[s : s + len(own)] == own and s + len(own) > at)
            at = start + len(own)
        assert at == len(tokens)
    assert chunking.split(None, 5) == chunking.split("  \n", 5) == []
    assert chunking.split("One two. Three four. Five six.", 3) == ["One two.", "Three four.", "Five six."]
    assert [chunking.count(p) for p in chunking.split("!" * 10, 4)] == [4, 4, 2]
    with pytest.raises(ValueError):
        chunking.split("x", 5, 5)


def test_token_counts_agree(spark):
    texts = ["a b,c", "é_1 ß-x", "", "日本 x!?", "a\tb\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.token_count(F.col("t")).alias("n")).collect()
    assert all(r["n"] == chunking.count(r["t"]) for r in rows)


def test_forum_strategies(spark):
    long = " ".join(f"Step {i}: do this now." for i in range(400))
    rows = [("1", "T", "a", 1, "", "short one"), ("1", "T", "b", 2, "", "word " * 100), ("1", "T", "c", 3, "", "thanks"), ("1", "T", "d", 4, "", long), ("1", "T", "e", 5, "", "ok then"), ("2", "U", "f", 1, "", dump())]
    got = chunking.forum_chunks(spark.createDataFrame(rows, POSTS)).collect()
    by = {}
    for r in got:
        by.setdefault(r["post_id"], []).append(r)
    kinds = {k: v[0]["strategy"] for k, v in by.items()}
    assert kinds == {"a": "short_without_previous", "b": "whole_post", "c": "short_with_previous", "d": "long_post_split", "e": "short_with_previous", "f": "diagnostic_dump_split"}
    assert by["c"][0]["text"] == "Topic: T\n\nPrevious post #2:\n" + ("word " * 100).strip() + "\n\nCurrent post #3:\nthanks" and by["c"][0]["source_post_ids"] == ["b", "c"]
    last = chunking.split(long, 300)[-1]
    assert f"Previous post #4:\n{last}\n\nCurrent" in by["e"][0]["text"]
    parts = sorted(by["d"], key=lambda r: r["chunk_index"])
    assert [r["chunk_index"] for r in parts] == list(range(len(parts))) and all(r["token_count"] <= 700 and r["index_dense"] for r in parts)
    assert parts[0]["text"].startswith(f"Topic: T\n\nPost #4, part 1 of {len(parts)}:\nStep 0") and parts[0]["chunk_id"] == "forum:1:d:0"
    dumped = sorted(by["f"], key=lambda r: r["chunk_index"])
    n = len(dumped)
    assert [r["chunk_index"] for r in dumped if r["index_dense"]] == sorted({round(i * (n - 1) / 7) for i in range(8)}) and n > 8 and all(r["index_lexical"] for r in dumped)
    m = chunking.chunk_manifest(spark.createDataFrame(got)).first()
    assert m["dump_posts"] == 1 and m["dump_avoided"] == n - 8 and m["chunks"] == m["chunk_ids"] == len(got)
    d = chunking.dump_posts(spark.createDataFrame(got)).first()
    assert (d["kept"], d["embedded"], d["avoided"]) == (n, 8, n - 8)
    assert chunking.preview(spark.createDataFrame(got), 1).count() == 5


def test_a_long_guide_is_no_dump(spark):
    guide = "VCDS\n" + "\n".join(f"Step {i}: " + "turn the bolt " * 30 for i in range(120))
    texts = spark.createDataFrame([(guide,), (dump(),), (dump(10),), (None,)], "t string")
    assert [r[0] for r in texts.select(T.is_diagnostic(F.col("t"))).collect()] == [False, True, False, False]


def test_generic_chunks(spark):
    rows = [("d", "word. " * 300, "chat", {"chat": "c", "start_time": "s", "end_time": "e", "participants": "a,b", "file_name": "f"}), ("e", "short", "file", {"source_url": "", "file_name": "", "title": "t"}), ("g", "", "file", None)]
    got = chunking.chunk_documents(spark.createDataFrame(rows, "doc_id string, text string, source_type string, metadata map<string,string>"), 100, 10).orderBy("chunk_id").collect()
    assert got[0]["text"].startswith("Chat: c\nWindow: s to e\nParticipants: a, b\nword.") and got[0]["source"] == "f" and got[0]["chunk_id"] == "d:0"
    assert [r["source"] for r in got if r["doc_id"] == "e"] == ["t"] and not [r for r in got if r["doc_id"] == "g"]


def test_config_rules():
    for bad in ({"max_tokens": 63}, {"overlap_tokens": 700}, {"short_post_tokens": 0}, {"previous_context_tokens": 700}, {"dump_min_tokens": 699}, {"dump_min_lines": 9}, {"dump_dense_chunks": 0}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            ForumChunks(**bad)
