import random
import re

from sparkrag.llm import op9_licenses

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def plain(text):
    """The base columns by a plain walk over the words."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_columns_equal_a_plain_walk(spark):
    rnd = random.Random(8)
    parts = ["under", "the", "MIT", "mit", "License", "apache", "license,", "version", "2", "2.0", "cc", "BY-", "nc", "by", "é", "İ", " ", "-", "x", "cc by nc cc by nc"]
    texts = ["".join(rnd.choice(parts) + rnd.choice([" ", "", "\n", "-"]) for _ in range(rnd.randint(0, 60))) for _ in range(400)] + [None, "", " "]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in op9_licenses.scan(rows).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_keywords_are_in_their_signatures():
    rules = op9_licenses.rules()
    assert len(rules) > 200
    for _, _, _, keys, pattern in rules:
        assert all(re.search(rf"(?<![a-z]){re.escape(k.split()[0])}", pattern.pattern) for k in keys), pattern.pattern


def test_prefilter_loses_nothing():
    s, rnd = op9_licenses.Scanner(), random.Random(2)
    examples = ["GPL v2 or later", "licensed under the GNU General Public License version 3", "CC BY-NC-SA 4.0", "Redistribution and use in source and binary forms, with or without modification, are permitted", "two-clause BSD license", "released into the public domain", "Mozilla Public License, v2.0", "all rights reserved", "SPDX-License-Identifier: Apache-2.0", "GPLv3", "Expat license"]
    for _ in range(200):
        text = " lorem ".join(rnd.choices(examples, k=4)).encode()
        line = " " + " ".join(x.decode() for x in text.lower().translate(op9_licenses.SPACES).split()) + " "
        active = {k for _, k in s.filter.iter(line)}
        for _, _, label, keys, pattern in s.rules:
            assert not pattern.search(line) or active.issuperset(keys), (label, keys, line)


def test_containment_equals_all_pairs():
    rnd = random.Random(3)
    for _ in range(300):
        kept, plain_kept = op9_licenses.Kept(), []
        for _ in range(40):
            a = rnd.randint(0, 50)
            b = a + rnd.randint(1, 20)
            inside = any(x <= a and b <= y for x, y in plain_kept)
            assert kept.add(a, b) != inside
            plain_kept += [] if inside else [(a, b)]


def test_priority_comes_before_length():
    s = op9_licenses.Scanner()
    got = s.scan(b"Licensed under the GNU Lesser General Public License version 2.1 or later")
    assert "lgpl-2.1" in got["labels"] and "gpl-2" not in got["labels"].split(",")
    assert s.scan(b"CC BY-NC 4.0")["labels"] == "cc-by-nc,cc-by-nc-4"
