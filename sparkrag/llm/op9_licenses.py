"""License scan by ordered signature rules.

A text is reduced to its lower-case words joined by one space; the signatures of op9_signatures.py are regexes over that
form. Each has keywords, and runs only on texts that hold all of them. Detections are intervals of words; in order of
priority, then length, then place, a detection that lies within one already kept is suppressed. The fixed base phrases are all counted,
overlaps included, and their labels always stay.
Null and empty texts have no words, no detections and score 0; repeated rows are scanned alike; an empty table
gives no rows; further columns are ignored. Texts are scanned whole, in time that grows with their length.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .op9_signatures import SIGNATURES

#: Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

def rules() -> list[tuple[int, float, str, tuple[str, ...], re.Pattern]]:
    """(priority, weight, label, keywords, pattern) of every signature, by falling priority."""
    out = []
    for line in SIGNATURES.strip().splitlines():
        head, keys, pattern = line.split(" :: ", 2)
        priority, weight, label = head.split()
        out.append((int(priority), float(weight), label, tuple(keys.split("+")), re.compile(f"(?<= )(?:{pattern})(?= )")))
    return sorted(out, key=lambda x: -x[0])


class Kept:
    """Intervals kept so far that lie in no other: starts and ends both ascend."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        """Whether the interval lies in none kept before; then it is kept."""
        i = bisect.bisect_right(self.starts, start)
        if i and self.ends[i - 1] >= end:
            return False
        j = bisect.bisect_right(self.ends, end)
        i = bisect.bisect_left(self.starts, start)
        self.starts[i : max(i, j)], self.ends[i : max(i, j)] = [start], [end]
        return True


NOT_WORD = bytes(x for x in range(128) if not chr(x).isalnum())
SPACES = bytes.maketrans(NOT_WORD, b" " * len(NOT_WORD))


class Scanner:
    def __init__(self):
        self.rules = rules()
        self.filter = ahocorasick.Automaton()
        for key in {k for r in self.rules for k in r[3]}:
            self.filter.add_word(key, key)
        self.filter.make_automaton()

    def scan(self, text: bytes | None) -> dict:
        w = (text or b"").lower().translate(SPACES).split()
        line = " " + b" ".join(w).decode("utf-8", "replace") + " "
        base = []
        for phrase, label in BASE:
            at = line.find(f" {phrase} ")
            while at >= 0:
                base.append((at + 1, label))
                at = line.find(f" {phrase} ", at + 1)
        keys = {key for _, key in self.filter.iter(line)}
        active = [r for r in self.rules if keys.issuperset(r[3])] if keys else ()
        found = [(-priority, m.start() - m.end(), m.start(), weight, label) for priority, weight, label, _, pattern in active for m in pattern.finditer(line)]
        kept, spans = Kept(), []
        # Places in the line become numbers of words by the places where words begin.
        begins = list(itertools.accumulate((len(x) + 1 for x in line.split(" ")[1:-1]), initial=1)) if found or base else []
        word_at = lambda i: bisect.bisect_left(begins, i)
        for _, size, start, weight, label in sorted(found):
            if kept.add(start, start - size):
                spans.append({"label": label, "first": word_at(start), "end": word_at(start - size + 1), "weight": weight})
        spans.sort(key=lambda x: (x["first"], x["end"]))
        starts = [word_at(i) for i, _ in base]
        score = max([1.0] * bool(base) + [x["weight"] for x in spans], default=0.0)
        names = {label for _, label in base}
        return {"n_words": len(w), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted(names)), "labels": ",".join(sorted(names | {x["label"] for x in spans})), "score": score, "spans": spans}


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label: string, first: bigint, end: bigint, weight: double>>"


def scan(docs: DataFrame) -> DataFrame:
    """One row of SCHEMA for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())])
        schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")], ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])
        for b in batches:
            rows = [{"doc_id": d} | scanner.scan(t.as_py()) for d, t in zip(b.column(0).to_pylist(), b.column(1))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")
