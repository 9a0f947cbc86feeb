"""Token ids in sorted-string-table shards.

Documents are dealt by range of doc_id, so shards in order hold ascending ids. A shard file has data blocks of
entries (shared key prefix, key rest, value), each compressed, then a sparse index (last key, offset and length
of every block), a Bloom filter over all keys and a fixed footer. A lookup asks the filter, bisects the index and
reads one block. Keys are doc_ids as big-endian bytes in ascending order (null below all), values are token ids as
little-endian unsigned 32-bit integers.
Null texts are empty (the end id alone), rows with equal doc_id are entries of their own in order of a hash of their
text and may span shards, an empty table gives shards without entries and no rows, further columns are ignored, texts
are encoded whole. Shards have about SHARD_BYTES of text at most, so the keys that a writer notes stay few.
"""

from __future__ import annotations

import bisect
import functools
import gc
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forgetting, give_back, lean, shared_dir, stored, table

MAGIC = b"SSTTOK01"
BLOCK_BYTES = 1 << 18
BITS_PER_KEY, PROBES = 10, 7
END = 1
#: Fixed value: a pre-tokenizer pattern that matches no white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What special tokens begin with; a digit, and so a token of its own; new words encoded at once.
SPECIAL, PARTING, JOINED = b"<|", b"0", 64
#: Bytes of text encoded at once, or one text if it is longer.
BYTES = 1 << 22
#: Text bytes of a shard at most, and at least if there are fewer shards than shuffle partitions.
SHARD_BYTES, LEAST_BYTES = 1 << 27, 1 << 22
#: Encoded words are remembered, none longer than LONG bytes; with CACHED of them, those not met again among as many more are forgotten.
CACHED, LONG = 3 << 17, 64
SPACED = bytes(32 if x == 10 else x for x in range(256))
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in SPACED)
#: A letter or digit, then a run of ASCII marks up to the end: two parts for the tokenizer.
MARKED = re.compile(rb"(?s)(.*[a-z0-9])([!-/:-@\[-`{-~]+)").fullmatch
#: Whether a byte ends a letter or digit of ASCII, is the second one of a letter of Latin-1 (all but the two signs), is an ASCII mark.
BASIC = bytes(chr(x).isalnum() and x < 128 for x in range(256))
LATIN = bytes(128 <= x < 192 and x not in (0x97, 0xB7) for x in range(256))
MARK = bytes(32 < x < 127 and not chr(x).isalnum() for x in range(256))


def part_marks(flat: bytes, starts: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Texts, end to end, with a space between a letter or digit and a mark, where the tokenizer parts them anyway; and their starts then."""
    flags = [np.frombuffer(flat.translate(x), bool) for x in (BASIC, LATIN, MARK)]
    raw = np.frombuffer(flat, np.uint8)
    ends = flags[0].copy()
    ends[1:] |= flags[1][1:] & (raw[:-1] == 0xC3)
    at = np.flatnonzero(ends[:-1] & flags[2][1:]) + 1
    return np.insert(raw, at, 32).tobytes(), starts + np.searchsorted(at, starts)


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def doc_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _probes(digests: bytes, bits: int) -> np.ndarray:
    """PROBES bit numbers for each digest of 16 bytes."""
    a, b = np.frombuffer(digests, "<u8").reshape(-1, 2).T
    return (a[:, None] + np.arange(PROBES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


class Writer:
    """Writes entries with ascending keys to an open stream."""

    def __init__(self, out):
        self.out, self.at, self.rows, self.index = out, 0, 0, []
        self.digests = bytearray()
        self.block, self.last = bytearray(), b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += struct.pack("<BBI", shared, len(key) - shared, len(value)) + key[shared:] + value
        if not self.rows or key != self.last:
            self.digests += _digest(key)
        self.last, self.rows = key, self.rows + 1
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            raw = zstandard.compress(bytes(self.block), 1)
            self.index.append([self.last.hex(), self.at, len(raw)])
            self.out.write(raw)
            self.at, self.block = self.at + len(raw), bytearray()

    def finish(self) -> None:
        self.flush()
        bits = max(64, BITS_PER_KEY * (len(self.digests) // 16))
        flags = np.zeros(bits, bool)
        for lo in range(0, len(self.digests), 1 << 20):
            flags[_probes(bytes(self.digests[lo : lo + (1 << 20)]), bits)] = True
        bloom = np.packbits(flags, bitorder="little")
        index = zstandard.compress(json.dumps(self.index).encode())
        self.out.write(index + bloom.tobytes())
        self.out.write(struct.pack("<QQQQQ", self.at, len(index), len(bloom), bits, self.rows) + MAGIC)


class Reader:
    """Reads a shard file through an open random-access file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        foot = file.read_at(48, size - 48)
        if foot[40:] != MAGIC:
            raise ValueError("not a token shard")
        at, n_index, n_bloom, self.bits, self.rows = struct.unpack("<QQQQQ", foot[:40])
        self.index = json.loads(zstandard.decompress(file.read_at(n_index, at)))
        self.last = [bytes.fromhex(x[0]) for x in self.index]
        self.bloom = file.read_at(n_bloom, at + n_index)

    def entries(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        raw = zstandard.decompress(self.file.read_at(self.index[i][2], self.index[i][1]))
        at, key = 0, b""
        while at < len(raw):
            shared, rest, n = struct.unpack_from("<BBI", raw, at)
            at += 6
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self.entries(i)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """Token ids of a document, or None."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(_digest(key), self.bits)[0].tolist()):
            return None
        i = bisect.bisect_left(self.last, key)
        for k, v in self.entries(i) if i < len(self.index) else ():
            if k == key:
                return np.frombuffer(v, "<u4")
        return None


class Seen(dict):
    """Ids of words; takes those that it lacks from `old`, an earlier one of its kind, and notes in `new` what that lacks too."""

    def __init__(self, old: dict[bytes, bytes]):
        super().__init__({b"": b""})
        self.old, self.new = old, []

    def __missing__(self, word: bytes) -> bytes | None:
        ids = self.old.get(word)
        if ids is None:
            self.new.append(word)
        else:
            self[word] = ids
        return ids


class Encoder:
    """Token ids of whole texts as bytes, each followed by END.

    Texts are cut at spaces and line feeds, across which the tokenizer must neither join, change nor emit anything;
    `exact` finds that in a tokenizer's definition. Frequent words are encoded once, without case (but where a special
    token could begin) and without the marks at their end, which are encoded apart. New words are encoded JOINED at
    a time, parted by a digit that is one token for itself; words that hold it are encoded alone. Where no special token
    could begin, marks are cut from words beforehand. Other tokenizers get texts whole.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(tokenizer)
        parting = self.encoder.encode(PARTING.decode(), add_special_tokens=False).ids
        self.by_word = len(parting) == 1 and self.exact(json.loads(self.encoder.to_str()))
        self.parting = np.uint32(parting[0] if parting else 0)
        self.seen = Seen({})

    @staticmethod
    def exact(definition: dict) -> bool:
        """Whether the tokenizer ignores case and splits as SPLIT does, with parts that do not look across white space."""
        norm, pre = definition.get("normalizer") or {}, definition.get("pre_tokenizer") or {}
        split, *rest = pre.get("pretokenizers") or [{}]
        return (
            all(x["type"] in {"NFC", "Lowercase"} or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in norm.get("normalizers", []))
            and any(x["type"] == "Lowercase" for x in norm.get("normalizers", []))
            and (split.get("type"), split.get("pattern"), split.get("behavior"), split.get("invert")) == ("Split", {"Regex": SPLIT}, "Removed", True)
            and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in rest)
            and all(x["content"].startswith(SPECIAL.decode()) and not x["lstrip"] and not x["rstrip"] and not any(map(str.isspace, x["content"])) for x in definition["added_tokens"])
            and not definition["model"].get("dropout")
        )

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, words: list[bytes]) -> list[bytes]:
        """As whole, of words without PARTING."""
        out = []
        texts = [b" ".join(x for w in words[i : i + JOINED] for x in (w, PARTING)).decode() for i in range(0, len(words), JOINED)]
        for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            raw, at = ids.tobytes(), 0
            for end in (4 * np.flatnonzero(ids == self.parting)).tolist():
                out.append(raw[at:end])
                at = end + 4
        return out

    def learn(self, words: set[bytes]) -> list[bytes]:
        """Puts the ids of words in seen; returns those that need not stay: words with marks at the end, whose parts are known, and long ones."""
        seen = self.seen
        marked = {w: m.groups() for w in words if (m := MARKED(w)) and SPECIAL not in w}
        parts = {x for pair in marked.values() for x in pair}
        plain = [w for w in words.difference(marked) | parts if w not in seen and w not in seen.old]
        alone = [w for w in plain if PARTING in w]
        rest = [w for w in plain if PARTING not in w]
        for some, encode in ((alone, lambda x: self.whole([w.decode() for w in x])), (rest, self.joined)):
            for lo in range(0, len(some), 2048):
                seen.update(zip(some[lo : lo + 2048], encode(some[lo : lo + 2048]), strict=True))
        for w, (stem, marks) in marked.items():
            seen[w] = seen[stem] + seen[marks]
        return [*(w for w in plain if len(w) > LONG), *marked]

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        if len(self.seen) > CACHED:
            self.seen.old = {}
            self.seen = Seen(self.seen)
        seen = self.seen
        ids = list(map(seen.__getitem__, words))
        if seen.new:
            passing = self.learn(set(seen.new))
            seen.new.clear()
            for i, x in enumerate(ids):
                if x is None:
                    ids[i] = seen[words[i]]
            for w in passing:
                del seen[w]
        return ids

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text of a string array without nulls."""
        end = np.array([END], "<u4").tobytes()
        if not self.by_word:
            return [x + end for x in self.whole(texts.to_pylist())]
        if not len(texts):
            return []
        raw = b"".join(texts.cast(pa.binary()).to_pylist())
        starts = np.r_[0, np.cumsum(pc.binary_length(texts).to_numpy())]
        # With the spaces, offsets must still fit 32 bits.
        if SPECIAL in raw or len(raw) > 1 << 30:
            flat = raw.translate(LOWER if SPECIAL not in raw else SPACED)
        else:
            flat, starts = part_marks(raw.translate(LOWER), starts)
        cut = pc.split_pattern(pa.StringArray.from_buffers(len(texts), pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(flat)), " ")
        known = cut.values.dictionary_encode()
        each = [*self.ids_of(known.dictionary.cast(pa.binary()).to_pylist()), end]
        # The ids of every word and, after the last word of a text, END, gathered out of those of the distinct words.
        at = np.insert(known.indices.to_numpy(), cut.offsets.to_numpy()[1:], len(each) - 1)
        size = np.fromiter(map(len, each), np.int32, len(each)) // 4
        first = np.cumsum(size, dtype=np.int32) - size
        n = size[at]
        to = np.cumsum(n, dtype=np.int64)
        shift = np.repeat((first[at] - (to - n)).astype(np.int32), n)
        shift += np.arange(len(shift), dtype=np.int32)
        ids = np.frombuffer(b"".join(each), "<u4")[shift].tobytes()
        ends = [0, *(4 * to[cut.offsets.to_numpy()[1:] + np.arange(len(texts))]).tolist()]
        return [ids[i:j] for i, j in zip(ends, ends[1:])]


@functools.lru_cache(1)
def encoder_of(tokenizer: str) -> Encoder:
    """One encoder for all tasks of a worker process, until it works for another stage."""
    return Encoder(tokenizer)


forgetting.append(encoder_of.cache_clear)


def portions(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about BYTES bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < b.num_rows:
        done = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + BYTES, "right")))
        yield b.slice(lo, hi - lo)
        lo = hi


def write_shards(docs: DataFrame, folder: str, tokenizer: str, shards: int | None = None) -> DataFrame:
    """(shard, file, n_rows, n_ids) of the shards written; a retried task writes a file of another name."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        # Nothing here makes cycles, and the collector would walk the remembered words again and again.
        gc.disable()
        encoder = encoder_of(tokenizer)
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base)
        file, ids = f"{base}/{uuid.uuid4().hex}.sst", 0
        shard = TaskContext.get().partitionId()
        with fs.open_output_stream(file, compression=None) as out:
            w = Writer(out)
            for b in batches:
                for part in portions(b):
                    for doc, value in zip(part.column(0).to_pylist(), encoder.encode(pc.fill_null(part.column(1), ""))):
                        ids += len(value) // 4
                        w.add(key_of(doc), value)
            w.finish()
        gc.enable()
        give_back()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [file], "n_rows": pa.array([w.rows], pa.int64()), "n_ids": pa.array([ids], pa.int64())}, schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_rows", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select("doc_id", "text")
    if shards is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shards = max(1, -(-size // SHARD_BYTES), min(tasks, -(-size // LEAST_BYTES)))
    # Rows of one doc_id are parted by their text, so that a frequent one may span shards.
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = rows.repartitionByRange(shards, *by).sortWithinPartitions(*by)
    return dealt.select("doc_id", "text").mapInArrow(write, "shard int, file string, n_rows bigint, n_ids bigint")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every entry of the shards in a manifest with one row per file."""
    # One row per shard file; the window over them is small.
    starts = manifest.withColumn("start", F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for b in batches:
            for file, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                done: list[tuple] = []
                with fs.open_input_file(file) as f:
                    for key, value in Reader(f):
                        done.append((doc_of(key), at, len(value) // 4, zlib.crc32(value)))
                        at += len(value) // 4
                        if len(done) == 10000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)], schema=schema)
                            done = []
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)], schema=schema)

    # A task reads one file, or a few.
    n = manifest.count()
    return starts.select("file", "start").repartition(max(1, n)).mapInArrow(lean(read), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def encode_and_read(docs: DataFrame, tokenizer: str) -> DataFrame:
    folder = shared_dir(docs.sparkSession, "tokens")
    return read_shards(stored(write_shards(docs, folder, tokenizer), "token-manifest"), folder)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(table(spark, sf_dir, "documents"), default_tokenizer())
