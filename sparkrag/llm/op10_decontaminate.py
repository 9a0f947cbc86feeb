"""Benchmark decontamination by latent semantic retrieval.

Texts become arrays of term numbers, stored once; terms are the words of the benchmark, other words are OTHER. Passages
of all documents (PASSAGE words each) are TF-IDF rows over the terms. A randomised SVD of that matrix A is distributed:
document frequencies and the product Y = A'(A G) are summed over partitions, term by term, and the driver sees only
RANK numbers per term, from which Y, G'Y give singular vectors and values. Windows of documents, as long as an item and a
quarter apart, and the benchmark items are put in the latent space, its axes evened out by the root of their singular
values; pairs of cosine COSINE or more are candidates. A candidate leaks if the longest common subsequence of words covers
SAME of the item, or PARAPHRASE of it with ANSWER of its answer (its last sentence).
The subsequence can miss few of an item's words, so of its rarest words some must be near the window; windows without
them are passed over, which loses nothing that the last check would keep (a test holds that).

The benchmark is the stated small side: the driver holds it, of LIMIT bytes at most (else ValueError; split it and union
the results), and documents are searched in blocks of ITEMS items. Items of fewer than SHORT words must be found word for
word, those of fewer than LEAST words say too little and are never found.
Null and empty texts hold nothing and null or empty items are never found; repeated documents are found alike; equal
items are found under each id; an empty table gives no rows; further columns are ignored. Texts are searched whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, stored, table

RANK, PASSAGE, OTHER = 32, 64, -1
COSINE, SAME, PARAPHRASE, ANSWER = 0.4, 0.6, 0.5, 0.8
SHORT, LEAST, LIMIT = 8, 4, 1 << 28
ITEMS = 4000
#: Words that are worked on at once; a document is never cut.
CHUNK = 1 << 17
#: Rows of the latent space held at once.
ROWS = 1 << 14
NOT_WORD = bytes(x for x in range(128) if not chr(x).isalnum())
SPACES = bytes.maketrans(NOT_WORD, b" " * len(NOT_WORD))


def split_words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(SPACES).split()


def lcs(a: list, b: list) -> int:
    """Length of a longest common subsequence, bit-parallel over a."""
    if not a:
        return 0
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Item:
    """A benchmark item in term numbers; terms grows by its words."""

    def __init__(self, item_id, text: str | None, terms: dict[bytes, int]):
        number = lambda s: [terms.setdefault(w, len(terms)) for w in split_words(s.encode())]
        self.item_id, self.words = item_id, number(text or "")
        self.bag = Counter(self.words)
        self.answer = next((x for x in map(number, reversed(re.split(r"[.!?\n]+", text or ""))) if x), [])

    def score(self, region: list[int]) -> float:
        """Share of the item found in a region; 0 if it does not leak."""
        n, bag = len(self.words), Counter(region)
        if sum(min(c, bag[w]) for w, c in self.bag.items()) < PARAPHRASE * n:
            return 0.0
        share = lcs(self.words, region) / n
        if n < SHORT:
            return float(any(region[i : i + n] == self.words for i in range(len(region) - n + 1)))
        if share >= SAME or share >= PARAPHRASE and lcs(self.answer, region) >= ANSWER * len(self.answer):
            return share
        return 0.0


def numbered(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(doc_id, ids) of every document with words: ids holds a term number per word, as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = lambda w: terms.get(w, OTHER)
        for b in batches:
            ids = []
            for t in b.column(1):
                w = split_words(t.as_py())
                ids.append(np.fromiter(map(get, w), np.int32, len(w)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), "doc_id bigint, ids binary").where("length(ids) > 0")


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc_ids, where each document starts and the last ends, term numbers) of about CHUNK words, whole documents."""
    names, parts, n = [], [], 0
    for b in batches:
        for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            names.append(name)
            parts.append(np.frombuffer(raw, np.int32))
            n += len(parts[-1])
            if n >= CHUNK:
                yield names, np.cumsum([0, *map(len, parts)]), np.concatenate(parts)
                names, parts, n = [], [], 0
    if parts:
        yield names, np.cumsum([0, *map(len, parts)]), np.concatenate(parts)


def cells(starts: np.ndarray, ids: np.ndarray, terms: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of passages, and per passage and term in it: passage, term, count; ordered by passage."""
    sizes = np.diff(starts)
    passages = -(-sizes // PASSAGE)
    first = np.cumsum(passages) - passages
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = first[doc] + (np.arange(len(ids)) - starts[doc]) // PASSAGE
    known = ids >= 0
    cell, tf = np.unique(at[known] * terms + ids[known], return_counts=True)
    return int(passages.sum()), cell // terms, cell % terms, tf


def pieces(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of sizes that add up to ROWS at most, or one that is larger."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + ROWS, "right")))
        yield slice(lo, hi)
        lo = hi


def add_product(out: np.ndarray, starts: np.ndarray, ids: np.ndarray, idf: np.ndarray, rough: np.ndarray) -> None:
    """Adds A'(A G) to out, for the passages A of some documents; rough is G times idf."""
    _, at, term, tf = cells(starts, ids, len(idf))
    if not len(at):
        return
    begins = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    sizes = np.diff(np.r_[begins, len(at)])
    for some in pieces(sizes):
        first = begins[some] - begins[some][0]
        mine = slice(begins[some][0], begins[some][0] + sizes[some].sum())
        t, n, row = term[mine], tf[mine], np.repeat(np.arange(len(first)), sizes[some])
        weight = n * idf[t]
        norm = np.sqrt(np.add.reduceat(weight**2, first))[row]
        rows = np.add.reduceat(rough[t] * (n / norm)[:, None].astype(np.float32), first)
        order = np.argsort(t, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(t[order]) != 0])
        out[t[order[first]]] += np.add.reduceat(rows[row[order]] * (weight / norm)[order, None].astype(np.float32), first)


def term_space(numbers: DataFrame, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Document frequency of the terms, and per term RANK numbers: its idf times its place in the latent space."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms + 1, np.int64)
        for _, starts, ids in chunks(batches):
            n, _, term, _ = cells(starts, ids, terms)
            df[:terms] += np.bincount(term, minlength=terms)
            df[terms] += n
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(df[some], pa.int64())], ["term", "n"])

    df = np.zeros(terms + 1)
    for term, c in numbers.select("doc_id", "ids").mapInArrow(lean(count), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[term] = c
    idf = np.log((df[terms] + 1) / (df[:terms] + 1)) + 0.1
    g = np.random.default_rng(42).standard_normal((terms, RANK))
    rough = (g * idf[:, None]).astype(np.float32)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((terms, RANK))
        for _, starts, ids in chunks(batches):
            add_product(out, starts, ids, idf, rough)
        some = np.flatnonzero(np.abs(out).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(list(out[some].astype(np.float32)), pa.list_(pa.float32()))], ["term", "row"])

    y = np.zeros((terms, RANK))
    sums = [F.sum(F.col("row")[i].cast("double")).alias(f"x{i}") for i in range(RANK)]
    for r in numbers.select("doc_id", "ids").mapInArrow(lean(multiply), "term int, row array<float>").groupBy("term").agg(*sums).collect():
        y[r[0]] = r[1:]
    # A'A is about Y (G'Y)^-1 Y', so the left singular vectors of Y (G'Y)^-1/2 are right ones of A, with its singular values.
    small, turn = np.linalg.eigh((g.T @ y + y.T @ g) / 2)
    good = small > 1e-9 * max(small.max(initial=0), 1e-30)
    vectors, values, _ = np.linalg.svd(y @ (turn[:, good] / np.sqrt(small[good])), full_matrices=False)
    axes = np.zeros((terms, RANK))
    axes[:, : len(values)] = vectors / np.sqrt(np.maximum(values, 1e-9))
    return df[:terms], (axes * idf[:, None]).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... counts[k] numbers, for every k."""
    ends = np.cumsum(counts)
    return np.arange(counts.sum()) + np.repeat(first - (ends - counts), counts)


class Searcher:
    def __init__(self, items: list[Item], df: np.ndarray, space: np.ndarray, cosine: float = COSINE):
        self.items, self.space, self.cosine = [x for x in items if len(x.words) >= LEAST], space, cosine
        self.length = np.array([len(x.words) for x in self.items], np.int64)
        self.step = np.maximum(1, self.length // 4)
        self.vectors = unit(np.array([space[x.words].sum(0) for x in self.items]).reshape(len(self.items), space.shape[1]))
        # A subsequence misses at most `missed` words, so of the missed + need rarest words of an item need are hit.
        missed = self.length - np.ceil(PARAPHRASE * self.length).astype(np.int64)
        self.need = np.minimum(self.length - missed, np.maximum(1, self.length // 6))
        owners = [(w, j) for j, x in enumerate(self.items) for w in sorted(set(sorted(x.words, key=lambda w: (df[w], w))[: missed[j] + self.need[j]]))]
        owners.sort()
        self.owner = np.array([j for _, j in owners], np.int64)
        self.count = np.bincount(np.array([w for w, _ in owners], np.int64), minlength=len(df))
        self.first = np.cumsum(self.count) - self.count

    def windows(self, starts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, document, number of the window) of the windows with enough rare words of the item within a step."""
        pos = np.flatnonzero(ids >= 0)
        counts = self.count[ids[pos]]
        item = self.owner[ranges(self.first[ids[pos]], counts)]
        pos = np.repeat(pos, counts)
        order = np.argsort(item, kind="stable")
        item, pos = item[order], pos[order]
        doc = np.searchsorted(starts, pos, "right") - 1
        last = np.arange(len(item)) + self.need[item] - 1
        ok = last < len(item)
        last = np.minimum(last, max(0, len(item) - 1))
        step, length = self.step[item], self.length[item]
        ok &= (item[last] == item) & (doc[last] == doc) & (pos[last] - pos < length + 2 * step)
        item, doc, lo, hi, step, length = item[ok], doc[ok], pos[ok], pos[last[ok]], step[ok], length[ok]
        lo, hi = lo - starts[doc], hi - starts[doc]
        begin = np.maximum(0, -(-(hi - length - step + 1) // step))
        counts = np.maximum(0, (lo + step) // step - begin + 1)
        found = np.unique(np.stack([np.repeat(item, counts), np.repeat(doc, counts), ranges(begin, counts)]), axis=1)
        return tuple(found[:, found[2] * self.step[found[0]] < np.diff(starts)[found[1]]])

    def search(self, starts: np.ndarray, ids: np.ndarray) -> list[tuple[int, int, float]]:
        """(document, item, score) of the items that documents leak."""
        best: dict[tuple[int, int], float] = {}
        item, doc, at = self.windows(starts, ids) if self.items else (np.zeros(0, np.int64),) * 3
        for some in pieces(self.length[item]):
            j, d = item[some], doc[some]
            step = self.step[j]
            s = starts[d] + at[some] * step
            e = np.minimum(s + self.length[j], starts[d + 1])
            near = ids[ranges(s, e - s)]
            rows = np.add.reduceat(np.where((near >= 0)[:, None], self.space[near], np.float32(0)), np.cumsum(e - s) - (e - s))
            close = np.flatnonzero((unit(rows) * self.vectors[j]).sum(1) >= self.cosine)
            for k in close:
                key = (int(d[k]), int(j[k]))
                if best.get(key, 0.0) < 1:
                    score = self.items[key[1]].score(ids[max(starts[d[k]], s[k] - step[k]) : min(e[k] + step[k], starts[d[k] + 1])].tolist())
                    if score > best.get(key, 0.0):
                        best[key] = score
        return [(d, self.items[j].item_id, x) for (d, j), x in best.items()]


FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64())])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score) of every document that leaks a benchmark item."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > LIMIT:
        raise ValueError(f"the benchmark has {size} bytes of text, more than {LIMIT}")
    terms: dict[bytes, int] = {}
    items = [Item(*r, terms) for r in benchmark.select("item_id", "text").collect()]
    numbers = stored(numbered(docs, terms), "term-numbers")
    df, space = term_space(numbers, len(terms)) if terms else (np.zeros(0), np.zeros((0, RANK), np.float32))

    def block(part: list[Item]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = Searcher(part, df, space)
            for names, starts, ids in chunks(batches):
                cols = list(zip(*[(names[d], item, x) for d, item, x in s.search(starts, ids)])) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, FOUND.types)], schema=FOUND)

        return numbers.mapInArrow(lean(run), "doc_id bigint, item_id bigint, score double")

    return reduce(DataFrame.union, [block(items[lo : lo + ITEMS]) for lo in range(0, max(1, len(items)), ITEMS)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
