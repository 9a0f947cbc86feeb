"""Independent plain versions of what the queries of the operators without SQL return, on the tables of sf0.001."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
import xxhash

from sparkrag.llm import op2_quality, op5_warc, op6_shards, op7_simhash
from sparkrag.llm.common import join_hot, shared_dir, stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def test_shards(spark, documents):
    got = {r["doc_id"]: r for r in op6_shards.query(spark, SF).collect()}
    assert got.keys() == {r["doc_id"] for r in documents}
    totals, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in documents:
        raw, x = (r["text"] or "").encode(), got[r["doc_id"]]
        assert (x["size"], x["text_crc32"], x["law"], x["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        totals[x["shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
        homes[raw].add(x["shard"])
    assert all(len(h) == 1 for h in homes.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(totals) <= set(range(40))
    groups = Counter()
    for r in documents:
        groups[(r["text"] or "")] += len((r["text"] or "").encode()) + 16
    assert max(totals.values()) <= max(sum(groups.values()) / 40 * 1.05, max(groups.values()))


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark, documents):
    got = {r["doc_id"]: r for r in op7_simhash.query(spark, SF).collect()}
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in documents}
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{f:016x}" for d, f in fps.items()}
    parent = {d: d for d in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert {d: r["component_id"] for d, r in got.items()} == {d: root(d) for d in fps}


def test_a_hot_fingerprint(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else f"text number {i} of many") for i in range(600)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in op7_simhash.near_duplicates(rows).collect()}
    assert len(got) == 600 and {got[i] for i in range(1, 600, 2)} == {1}


def test_hot_join_equals_plain_join(spark):
    rows = stored(spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}") for i in range(1000)] + [(-1, None)], "i bigint, key string"), "rows")
    classes = stored(spark.createDataFrame([("hot", 1), *[(f"k{j}", j) for j in range(5)]], "key string, c int"), "classes")
    assert sorted(map(str, join_hot(rows, classes, "key").collect())) == sorted(map(str, rows.join(classes, "key").collect()))


PAGES = "page_id bigint, url string, html string, digest string"


def test_archives(spark):
    big, other = "<p>é</p>" * 300, "y" * 1000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (2, "http://a/2", big), (None, "n", big), (3, None, None), (4, "u\r\nx", "small"), (5, "u", "small"), (6, "u", other), (7, "u", "z" * 999), (8, "u", "z" * 999)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], PAGES)
    for copies in (1, 80):
        many = rows + [(1000 + i, "v", other) for i in range(copies * 2)]
        pages = spark.createDataFrame([(*r, "clash") for r in many], PAGES)
        folder = shared_dir(spark, "w")
        index = stored(op5_warc.write_archives(op5_warc.plan_records(pages), folder), "index")
        got = op5_warc.read_records(index, folder).collect()
        last = {}
        for p, _, h in many:
            if p is not None:
                last[h or ""] = max(p, last.get(h or "", p))
        want = Counter()
        for p, _, h in many:
            raw = (h or "").encode()
            revisit = len(raw) >= 1000 and p != last[h]
            want[(p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last[h] if revisit else None, None if revisit else raw)] += 1
        assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["record_type"] == "revisit" else bytes(r["payload"])) for r in got) == want
    none = spark.createDataFrame([], PAGES)
    folder = shared_dir(spark, "w")
    assert op5_warc.read_records(stored(op5_warc.write_archives(op5_warc.plan_records(none), folder), "index"), folder).count() == 0


def test_quality_on_held_out_labels(spark, documents):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in op2_quality.query(spark, sf).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for d, r in rows.items())
    labels = [x for x in pq.read_table(f"{sf}/labels.parquet").to_pylist() if zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0 and x["quality"] is not None]
    right = sum(rows[x["doc_id"]]["predicted"] == x["quality"] for x in labels)
    assert len(labels) > 40 and right / len(labels) >= 0.95


def test_quality_labels_at_the_edges(spark):
    docs = spark.createDataFrame([(i % 5, f"word {i} " * (i + 1), "x", "y") for i in range(40)] + [(None, None, "x", "y"), (9, "", "x", "y")], "doc_id bigint, text string, score string, _s string")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id bigint, quality int")
    for rows, value in (([], 0.5), ([(1, None)], 0.5), ([(1, 1), (2, 1), (3, 1)], None)):
        scores = {round(r["score"], 6) for r in op2_quality.score(docs, op2_quality.train(docs, labels(rows))).collect()}
        assert len(scores) == 1 and (value is None or scores == {value})
    seen = []
    fit = op2_quality.fit
    try:
        op2_quality.fit = lambda x, y: seen.append(len(y)) or fit(x, y)
        op2_quality.train(docs, labels([(i, i % 2) for i in range(5)]), sample=3)
    finally:
        op2_quality.fit = fit
    assert seen == [3]

