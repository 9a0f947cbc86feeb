import json
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from sparkrag.llm import op1_mix, op2_quality, op3_tokens, op4_extract, op5_warc, op6_shards, op7_simhash, op8_rules, op9_licenses, op10_decontaminate
from sparkrag.llm.common import shared_dir

DOCS = "doc_id bigint, text string, source string, slot string, key string"


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice("abcdefghij") * rnd.randint(1, 4) for _ in range(rnd.randint(1, 120))), f"s{i % 3}", "x", "y") for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "s0", "x", "y"), (102, "  \n ", "s1", "x", "y"), (None, "lone words here", "s1", "x", "y"), (103, rows[0][1], "s2", "x", "y"), (103, rows[0][1], "s2", "x", "y"), (104, "word " * 30000, "s2", "x", "y")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_mix(docs, none):
    rows = op1_mix.mix(docs).collect()
    assert len(rows) == docs.count() and op1_mix.mix(none).count() == 0
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], [r["target"], r["source_size"]])
    total = sum(x[1] for x in by.values())
    assert abs(sum(x[0] for x in by.values()) - 1.5 * total) < 1e-6 * total and all(t <= 2 * s for t, s in by.values())


def test_rules_and_ledger(docs, none):
    rows = op8_rules.ledger(docs).collect()
    for r in rows:
        w = (r["text"] or "").split()
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {i + o for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for o in range(3)}
        assert (r["ledger"]["n_words"], r["ledger"]["n_repeat_words"]) == (len(w), len(hit))
    assert op8_rules.ledger(none).count() == 0
    assert op8_rules.ablation(op8_rules.ledger(docs)).first()["fails_few_words"] == sum(r["ledger"]["n_words"] < 50 for r in rows)


def test_simhash_components(spark, docs, none):
    rows = op7_simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count() and op7_simhash.near_duplicates(none).count() == 0
    rnd = random.Random(3)
    fps = {rnd.getrandbits(64) for _ in range(40)}
    for x in list(fps):
        for _ in range(4):
            x ^= 1 << rnd.randrange(64) | 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(op7_simhash.signed(x) for x in fps)
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if ((x ^ y) & (1 << 64) - 1).bit_count() <= 2:
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in op7_simhash.components(op7_simhash.links(spark.createDataFrame([(x,) for x in fps], "fp bigint"))).collect()}
    assert all(got.get(x, x) == root(x) for x in fps)


def test_masks_cover_radius():
    m = op7_simhash.masks()
    assert all(any(not x >> i & 1 and not x >> j & 1 for x in m) for i in range(64) for j in range(i))


def test_token_shards(spark, docs, none):
    from tokenizers import Tokenizer

    name = op3_tokens.default_tokenizer()
    t, at = Tokenizer.from_file(name), 0
    rows = op3_tokens.encode_and_read(docs, name).orderBy("start").collect()
    exp = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    for r, (d, text) in zip(rows, exp, strict=True):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert tuple(r) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert op3_tokens.encode_and_read(none, name).count() == 0
    folder = shared_dir(spark, "t")
    files = [r["file"] for r in op3_tokens.write_shards(docs, folder, name, 2).collect()]
    found = 0
    for f in files:
        with pafs.FileSystem.from_uri(folder)[0].open_input_file(f) as h:
            found += op3_tokens.Reader(h).get(7) is not None
            assert op3_tokens.Reader(h).get(99999) is None
    assert found == 1


def test_encoder_equals_whole_texts():
    e = op3_tokens.Encoder(op3_tokens.default_tokenizer())
    assert e.by_word and not e.exact({**json.loads(e.encoder.to_str()), "normalizer": None, "pre_tokenizer": {"type": "Whitespace"}})
    rnd = random.Random(4)
    alphabet = ["a", "B", "0", "10", "&&&", "$", "#", ";", "|>", "'s", "'", "é", "e\u0301", "\u0301", "Σ", "ς", "İ", "\u00a0", "\u2028", "\t", "\r", "\x0b", " ", "\n", "  ", "7", "漢", "😀", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "<|endof", "text|>", ".", ",", "!", "Qu", "\u212a",  "\u200d", "\x00", "?!", "\uac00", "\u11a8"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(20000)] + ["x" * 5000 + " " + "x" * 5000]
    assert e.encode(pa.array(texts)) == [x + b"\1\0\0\0" for x in e.whole(texts)]
    # Texts where no special token could begin are cut at marks.
    alphabet = [x for x in alphabet if "<" not in x] + ["-", "_", "<", "É", "×", "÷", "ÿ", "ß", "ñ", "\u0338", "²", "—"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))).replace("<|", "<") for _ in range(20000)]
    texts = [x for x in texts if x[:1] != "|"]
    assert not any("<|" in x for x in texts)
    assert e.encode(pa.array(texts)) == [x + b"\1\0\0\0" for x in e.whole(texts)]
    cased = json.loads(e.encoder.to_str())
    cased["normalizer"]["normalizers"] = [x for x in cased["normalizer"]["normalizers"] if x["type"] != "Lowercase"]
    assert not e.exact(cased)


def test_shards_balance(docs, none):
    rows = op6_shards.shard(docs, 5).collect()
    assert len(rows) == docs.count() and op6_shards.shard(none).count() == 0
    for s in range(5):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert len({r["shard"] for r in rows if r["doc_id"] == 103}) == 1


def test_cells_in_a_tree_balance(spark, monkeypatch):
    monkeypatch.setattr(op6_shards, "FAN", 3)
    rnd = random.Random(6)
    sizes = {f"g{i}": rnd.randint(16, 4000) for i in range(3000)} | {"huge": 10**6}
    got = {r["gid"]: r["shard"] for r in op6_shards.balance(spark.createDataFrame(list(sizes.items()), "gid string, bytes bigint"), 8, 150).collect()}
    assert got.keys() == sizes.keys()
    totals = Counter()
    for g, s in got.items():
        totals[s] += sizes[g]
    rest = [x for s, x in totals.items() if s != got["huge"]]
    assert len(totals) == 8 and totals[got["huge"]] == 10**6 and max(rest) - min(rest) < 200, totals


def test_difference_places():
    rnd = random.Random(1)
    sizes = [rnd.randint(1, 1000) for _ in range(500)]
    sums, places = op6_shards.difference([[x] + [0] * 7 for x in sizes])
    again = [0] * 8
    for x, p in zip(sizes, places):
        again[p[0]] += x
    assert again == sums and max(sums) - min(sums) < 20


def test_warc_round_trip(spark):
    big = "<p>é</p>" * 300
    pages = spark.createDataFrame([(1, "http://a/1", big), (2, "http://a/2", big), (3, None, None), (4, "u\r\nx", "small"), (5, "u", "small")], "page_id bigint, url string, html string")
    folder = shared_dir(spark, "w")
    index = spark.createDataFrame(op5_warc.write_archives(op5_warc.plan_records(pages), folder).collect(), op5_warc.INDEX)
    got = {r["page_id"]: r for r in op5_warc.read_records(index, folder).collect()}
    assert got[1]["record_type"] == "revisit" and got[1]["refers_to"] == 2 and got[2]["payload"].decode() == big
    assert got[3]["payload_bytes"] == 0 and got[4]["record_type"] == got[5]["record_type"] == "response"


def test_licenses(docs, none):
    s = op9_licenses.Scanner()
    got = s.scan(b"Under the MIT License. under the mit license; GNU General Public License, version 3. CC-BY-NC")
    assert (got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == (3, 0, 14, "cc-by-nc,mit")
    assert "gpl-3" in got["labels"].split(",") and s.scan(None)["score"] == 0.0
    assert op9_licenses.scan(docs).count() == docs.count() and op9_licenses.scan(none).count() == 0


def test_leaks(spark, docs, none):
    rnd = random.Random(9)
    item = " ".join("".join(rnd.choices("abcdefghijklmnop", k=5)) for _ in range(40))
    more = spark.createDataFrame([(500, "x y z " * 50 + item + " q r s" * 70)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id bigint, text string")
    assert [tuple(r)[:2] for r in op10_decontaminate.leaks(docs.select("doc_id", "text").union(more), bench).collect()] == [(500, 1)]
    assert op10_decontaminate.leaks(none, bench).count() == 0


def test_quality(spark, docs, none):
    labels = docs.where("doc_id < 60").select("doc_id", F.when(F.length("text") > 150, 1).otherwise(0).alias("quality"))
    model = op2_quality.train(docs, labels)
    rows = op2_quality.score(docs, model).join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) > 0.8 * len(rows)
    assert op2_quality.score(none, op2_quality.train(none, labels)).count() == 0
