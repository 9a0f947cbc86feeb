"""Near copies for the pipeline: op7's SimHash links, covering classes for what lies beyond its radius, and an exact check.

Two texts link when the Jaccard similarity of their sets of SHINGLE-word shingles (lower-cased) is 0.8 or more. First
op7 links texts by the covering masks of their fingerprints; of these links the exact check keeps the ones at 0.8 or more.

Fingerprints bound no similarity (those of linked texts were seen 2 to 11 bits apart; a radius of 11 would take 4,095
tables). So for the rest covering masks are laid over the shingle sets themselves, which differ, with n and m shingles, in
at most (n + m) / 9 of them: a mask keeps the shingles of one class of hash values. With one class more than sets can differ
in, a linked pair agrees on all shingles of some class, whose sum is a key of both. Sets are large, so fewer classes do: as
many as leave a pair at 0.8 COVER classes untouched on average, so that about one in 10^7 at exactly 0.8 is missed; small sets, where a
class may be empty, take classes under several hash functions (of pairs of 4 and 5 shingles up to two in 10^5 are missed), unless
their fingerprints link them. Class counts belong to ranges of sizes, RATIO wide; a text in
reach of the next range has keys there too.

Texts of a key are nearly always near copies. With op7's links, every text is checked against the least text of that key it shares most
keys with. Then keys that hold several components are compared in blocks, by a parity bitmap of the whole set: bitmaps
differ in no more bits than sets in shingles, so texts farther apart than 0.8 allows go without loss, and no row is made of
them. Of each text the nearest of another component is checked, and, across the components which that gives, all that are
left. A key's most frequent component is not compared with itself, and a key of any size is spread over blocks.

Equal texts are one text with one key (64-bit hash). A text of fewer words is one shingle; null, empty and blank texts are
one text. Of a component the row of least (doc_id, key) stays, null last; null and repeated ids with differing texts are
rows of their own. An empty table gives no rows; further columns are kept, whatever their names. Texts are processed whole.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, lean, stored
from .op7_simhash import components, fingerprints
from .op7_simhash import links as near_prints

SHINGLE = 5
#: Words remembered by a worker.
MEMORY = 1 << 16
#: Rows hashed at once, to spare memory.
ROWS = 500
#: Width of a range of sizes; classes left untouched on average between sets at similarity 0.8.
RATIO, COVER = 1.5, 16
#: 64-bit words of a parity bitmap; texts in a block.
BITS, BLOCK = 8, 1024
MIX = [np.uint64(xxhash.xxh64_intdigest(bytes([i]), 7) | 1) for i in range(SHINGLE)]


class Words(dict):
    """Hash of a word; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def mixed(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * by
    return x ^ x >> np.uint64(29)


def shingles(text: bytes | None, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    w = (text or b"").lower().split() or [b""]
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    size = min(SHINGLE, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out += h[i : i + n] * MIX[i]
    return np.unique(mixed(out, MIX[0]))


def differ(n: int, m: int) -> int:
    """Shingles in one only of two sets of n and m, at most, at similarity 0.8."""
    return (n + m) // 9


def range_of(n: int) -> int:
    """Number of the range of sizes that n is in."""
    return int(math.log(n) / math.log(RATIO) + 1e-9)


@functools.cache
def classes(r: int) -> tuple[np.ndarray, int]:
    """Upper ends of the classes of hash values in a range of sizes, and under how many hash functions they are laid."""
    top = math.ceil(RATIO ** (r + 1))
    most = differ(top, top)
    count = next((p for p in range(1, most + 1) if p * math.exp(-most / p) >= COVER), most + 1)
    ends = [np.uint64((1 << 64) * (i + 1) // count - 1) for i in range(count)]
    return np.array(ends, np.uint64), 4 if top <= 60 else 2 if top <= 200 else 1


def keys_of(s: np.ndarray) -> np.ndarray:
    """Keys of a set: the sums of its classes, in its own range of sizes and, if a linked set can be there, the next."""
    n, out = len(s), []
    for r in sorted({range_of(n), range_of(max(n, 5 * n // 4))}):
        ends, functions = classes(r)
        for f in range(functions):
            h = s if f == 0 else np.sort(mixed(s, MIX[f]))
            at = np.searchsorted(h, ends, "right")
            total = np.cumsum(np.r_[np.uint64(0), h], dtype=np.uint64)[np.r_[0, at]]
            full = np.flatnonzero(np.diff(np.r_[0, at]))
            names = (full + (r << 40) + (f << 32)).astype(np.uint64) * MIX[1]
            out.append(mixed(np.diff(total)[full] + names, MIX[2]))
    return np.concatenate(out).view(np.int64)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of the runs of equal values."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return first, np.diff(np.r_[first, len(key)])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(deal, key, k, low): the first text of a key in a slice of rows is dealt by key; the others, with it as low, anywhere."""
    words = Words()
    for b in sliced(batches):
        names = np.array(b.column(0).to_pylist(), np.int64)
        sets = [keys_of(shingles(x.as_py(), words)) for x in b.column(1)]
        key = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        k = np.repeat(names, [len(x) for x in sets])
        order = np.lexsort((k, key))
        key, k = key[order], k[order]
        first, n = runs(key)
        low = np.repeat(k[first], n)
        lead = np.zeros(len(key), bool)
        lead[first] = True
        # A leader with followers is marked by a low of its own.
        follows = np.repeat(n > 1, n)
        deal = np.where(lead, key, key ^ k)
        yield pa.RecordBatch.from_arrays([pa.array(deal, pa.int64()), pa.array(key, pa.int64()), pa.array(k, pa.int64()), pa.array(low, pa.int64(), mask=~follows)], ["deal", "key", "k", "low"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, k, low) of rows (key, k, low) in order of (key, k) that meet another of their key here, or have a low already."""
    last: tuple | None = None  # (key, least k, whether its first row is still to be given out)
    for b in batches:
        key, k = b.column(0).to_numpy(), b.column(1).to_numpy()
        null = b.column(2).is_null().to_numpy(zero_copy_only=False)
        low = np.where(null, k, b.column(2).fill_null(0).to_numpy())
        follower = ~null & (low != k)
        out = [(key[follower], k[follower], low[follower])]
        key, k, led = key[~follower], k[~follower], (~null)[~follower]
        if len(key):
            first, n = runs(key)
            least, whole = k[first], n > 1
            if last and last[0] == key[0]:
                least[0], whole[0] = last[1], True
                if last[2]:
                    out.append((np.array([last[0]]), np.array([last[1]]), np.array([last[1]])))
            given = np.repeat(whole, n) | led
            out.append((key[given], k[given], np.repeat(least, n)[given]))
            last = (key[-1], least[-1], not given[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], ["key", "k", "low"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, n, bits, hashes): the whole sets and their parity bitmaps."""
    words = Words()
    for b in sliced(batches):
        sets, bits = [], []
        for x in b.column(1):
            sets.append(shingles(x.as_py(), words))
            flags = np.bincount((sets[-1] % np.uint64(64 * BITS)).astype(np.int64), minlength=64 * BITS) & 1 == 1
            bits.append(np.packbits(flags).tobytes())
        sizes = [len(s) for s in sets]
        values = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64), pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), lists], ["k", "n", "bits", "hashes"])


def text_key() -> Column:
    blank = F.coalesce("text", F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    return F.xxhash64(F.when(blank, F.lit("")).otherwise(F.col("text")))


def members(texts: DataFrame) -> DataFrame:
    """(key, k, low) of the keys that several texts (k, text) have; low is a text of the key, mostly the least."""
    raw = texts.select("k", F.col("text").cast("binary").alias("text")).mapInArrow(lean(_keys), "deal bigint, key bigint, k bigint, low bigint")
    dealt = raw.repartition("deal").sortWithinPartitions("key", "k")
    return dealt.select("key", "k", "low").mapInArrow(lean(_members), "key bigint, k bigint, low bigint")


def _near(nearest: bool):
    """Pairs (a, b), a > b, of blocks (ms, os) of members (k, n, r, bits) that may be linked and differ in r; nearest: of each member of ms the nearest only."""

    def unpack(x) -> tuple:
        k, n, r = (x.values.field(c).to_numpy() for c in ("k", "n", "r"))
        return k, n, r, np.frombuffer(b"".join(x.values.field("bits").to_pylist()), np.uint64).reshape(-1, BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 16):
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x, y in zip(b.column(0), b.column(1)):
                (k, n, r, bits), (ok, on, other, obits) = unpack(x), unpack(y)
                for i in range(0, len(k), 128):
                    mine = slice(i, i + 128)
                    apart = abs(n[mine, None] - on[None, :])
                    counted = np.zeros_like(apart)
                    for w in range(BITS):
                        counted += np.bitwise_count(bits[mine, None, w] ^ obits[None, :, w])
                    apart = np.maximum(apart, counted)
                    meet = (9 * apart <= n[mine, None] + on[None, :]) & (r[mine, None] != other[None, :])
                    if nearest:
                        at = np.where(meet, apart, 1 << 40).argmin(1)
                        p = np.flatnonzero(meet[np.arange(len(at)), at])
                        q = at[p]
                    else:
                        p, q = np.nonzero(meet)
                    left.append(np.maximum(k[i + p], ok[q]))
                    right.append(np.minimum(k[i + p], ok[q]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in (left, right)], ["a", "b"])

    return run


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) at similarity 0.8 or more."""
    side = lambda c: sets.select(F.col("k").alias(c), F.col("n").alias(f"n{c}"), F.col("hashes").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def across(met: DataFrame, sets: DataFrame, at: DataFrame, nearest: bool) -> DataFrame:
    """Pairs (a, b) that may be linked, among the texts of a key and in different components (node, root)."""
    placed = sets.select("k", "n", "bits").join(at, F.col("k") == F.col("node"), "left").select("k", "n", "bits", F.coalesce("root", "k").alias("r"))
    rooted = met.select("key", "k").join(placed.select("k", "r"), "k")
    sizes = rooted.groupBy("key", "r").agg(F.count("*").alias("c"))
    split = sizes.groupBy("key").agg(F.sum("c").alias("c"), F.count("*").alias("roots"), F.max(F.struct("c", "r")).alias("main")).where("roots > 1").select("key", "c", F.col("main.c").alias("mc"), F.col("main.r").alias("mr"))
    rows = stored(rooted.join(split, "key"), "across")
    full = rows.join(placed.drop("r"), "k").withColumn("m", F.struct("k", "n", "r", "bits"))
    block = lambda n: F.pmod(F.xxhash64("k"), F.ceil(n / BLOCK))
    rest = full.where("r <> mr").groupBy("key", block(F.col("c") - F.col("mc")).alias("i")).agg(F.collect_list("m").alias("ms"))
    every = full.groupBy("key", block(F.col("c")).alias("j")).agg(F.collect_list("m").alias("os"))
    return rest.join(every, "key").select("ms", "os").mapInArrow(lean(_near(nearest)), "a bigint, b bigint").distinct()


def printed(texts: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, of texts (k, text) that op7 links: texts of one fingerprint with the least of them, and the least ones of linked fingerprints."""
    rows = stored(fingerprints(texts.select(F.col("k").alias("doc_id"), "text")), "fingerprints")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    same = join_hot(rows, least, "fp").where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    side = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"k{c}"))
    apart = near_prints(least.select("fp")).join(side("a"), "a").join(side("b"), "b").select(F.greatest("ka", "kb").alias("a"), F.least("ka", "kb").alias("b"))
    return stored(same.union(apart), "printed")


def roots(texts: DataFrame) -> DataFrame:
    """(node, root), a > b linked transitively, of the texts (k, text) that have a near copy; k is unique."""
    prints, met = printed(texts), stored(members(texts), "members")
    some = met.select("k").union(prints.select("a")).union(prints.select("b")).distinct()
    sets = stored(texts.join(some, "k").select("k", F.col("text").cast("binary").alias("text")).mapInArrow(lean(_sets), "k bigint, n bigint, bits binary, hashes array<bigint>"), "sets")
    first = met.where("k <> low").groupBy("k", "low").agg(F.count("*").alias("c")).groupBy("k").agg(F.max(F.struct("c", F.col("low").alias("o"))).alias("best"))
    pairs = first.select(F.greatest("k", "best.o").alias("a"), F.least("k", "best.o").alias("b")).union(prints).distinct()
    links = stored(checked(pairs, sets), "links")
    for nearest in (True, False):
        more = stored(across(met, sets, components(links), nearest), "candidates")
        links = stored(links.union(checked(more, sets)), "links")
    return components(links)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of docs."""
    doc_id = F.coalesce(F.col("doc_id"), F.lit(0))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_key().alias("k"), F.col("doc_id").isNull().alias("n"), doc_id.alias("d"), "text")
    named = rows.groupBy("k").agg(F.min(F.struct("n", "d")).alias("id"))
    texts = rows.groupBy("k").agg(F.min("text").alias("text"))
    placed = named.join(roots(stored(texts, "texts")), F.col("k") == F.col("node"), "left")
    best = placed.groupBy(F.coalesce("root", "k")).agg(F.min(F.struct("id", "k")).alias("best")).select("best.k", "best.id.n", "best.id.d")
    by = ["k", "n", "d"]
    return rows.drop("text").join(best, by).dropDuplicates(by).select("row.*")
