"""Token ids in binary shards with a minimal perfect hash index.

A shard file holds, little-endian: a header; the raw ids of its documents, in ascending key
order; the end of each document's ids; the keys; and an index.  The index is a minimal
perfect hash of the keys (levels of bit arrays: a key rests at the first level where no other
falls on its bit, and its slot is the number of bits set before) and, for each slot, a
32-bit fingerprint and the document's number, so that a key reaches its ids in constant time
and a key that is not there is refused, but for one in 2**32.

Documents are dealt to shards by ranges of the key, so that the shards follow one another in
key order; ``start`` counts the ids of all documents before.  There is a shard for each
``shard_bytes`` of stored text, and one for each shuffle partition at least.  Rows of one key are ordered by their place in the table, so that a key with many rows may lie in several shards.  Each task writes a file
under a name of its own, in the folder that the cluster shares, as Spark's file systems resolve
it; only files named in the returned manifest count, so that a lost task leaves nothing that is
read.

Defined results: a null or empty text has only the end id; rows with equal keys are told apart
by a repeat number, which runs on over shards; null keys sort first and are no number; keys
that are no whole numbers are refused; an empty table gives no shards and no rows; extra columns
are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lumenfold.llm.arrow import blocks_of, held, release
from lumenfold.llm.names import col
from lumenfold.operators.lineage import shared_path

MAGIC = b"LFTOKID2"
_HEAD = struct.Struct("<8sQQQQQQQI")  # magic, documents, null keys, ids, places of ends, keys, index; length of the index; bytes of an id
_U = np.uint64
#: ``base``: rows of the shard's first key in the shards before it.
MANIFEST = "shard int, path string, documents long, tokens long, nulls long, first_key long, last_key long, base long"
#: Bytes of stored text that a shard is for.
SHARD_BYTES = 1 << 28


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _codes(keys: np.ndarray, repeats: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    return _mix(_mix(keys.astype(np.int64).view(np.uint64), 1) + repeats.astype(np.uint64), 2) ^ (nulls.astype(np.uint64) * _U(0xA0761D6478BD642F))


def _repeats(keys: np.ndarray, nulls: int) -> np.ndarray:
    """How many rows of its key stand before each row; the first ``nulls`` keys are null."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64)
    at = np.arange(len(keys))
    new = np.r_[True, keys[1:] != keys[:-1]]
    new[1:nulls] = False
    if 0 < nulls < len(keys):
        new[nulls] = True
    return at - np.maximum.accumulate(np.where(new, at, 0))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit codes."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = []
        total = 0
        for bits in levels:
            counts = np.bitwise_count(bits).astype(np.int64)
            self.before.append(total + np.r_[0, np.cumsum(counts)[:-1]])
            total += int(counts.sum())
        self.size = total

    @classmethod
    def build(cls, codes: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        levels, left = [], codes
        while len(left):
            words = max(1, -(-int(gamma * len(left)) // 64))
            at = _mix(left, 16 + len(levels)) % _U(words * 64)
            counts = np.bincount(at.astype(np.int64), minlength=words * 64)
            levels.append(np.packbits(counts == 1, bitorder="little").view("<u8"))
            left = left[counts[at.astype(np.int64)] > 1]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def slots(self, codes: np.ndarray) -> np.ndarray:
        """Slot of each code, or -1 where the levels end without one."""
        out = np.full(len(codes), -1, dtype=np.int64)
        left = np.arange(len(codes))
        for level, (bits, before) in enumerate(zip(self.levels, self.before, strict=True)):
            at = _mix(codes[left], 16 + level) % _U(len(bits) * 64)
            word, bit = (at >> _U(6)).astype(np.int64), at & _U(63)
            hit = (bits[word] >> bit) & _U(1) == 1
            below = np.bitwise_count(bits[word] & ((_U(1) << bit) - _U(1))).astype(np.int64)
            out[left[hit]] = before[word[hit]] + below[hit]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<Q", len(b)) for b in self.levels) + b"".join(b.tobytes() for b in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[PerfectHash, int]:
        n = struct.unpack_from("<I", data)[0]
        sizes = struct.unpack_from(f"<{n}Q", data, 4)
        at, levels = 4 + 8 * n, []
        for size in sizes:
            levels.append(np.frombuffer(data, dtype="<u8", count=size, offset=at))
            at += 8 * size
        return cls(levels), at


def qualified(spark: SparkSession, path: str) -> str:
    """A folder as Spark's file systems name it, made if need be; a path without a scheme is not
    taken for a local one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    given = jvm.org.apache.hadoop.fs.Path(path)
    fs = given.getFileSystem(conf)
    fs.mkdirs(given)
    return fs.makeQualified(given).toString()


def _filesystem(uri: str):
    """pyarrow's file system and path of a qualified name."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


class ShardWriter:
    """Writes a shard: ids stream to the file, the rest follows when it is closed."""

    def __init__(self, uri: str, id_bytes: int):
        fs, path = _filesystem(uri)
        self.out, self.id_bytes = fs.open_output_stream(path), id_bytes
        self.keys, self.ends = array("q"), array("q")
        self.nulls = 0
        self.tokens = 0
        self.written = 0

    def add(self, key: int | None, ids: bytes) -> None:
        """The next document; keys ascend, nulls first."""
        self.nulls += key is None
        self.keys.append(key or 0)
        self.tokens += len(ids) // self.id_bytes
        self.ends.append(self.tokens)
        self.out.write(ids)
        self.written += len(ids)

    def close(self) -> None:
        keys = np.frombuffer(self.keys, dtype=np.int64).astype("<i8")
        at = np.arange(len(keys))
        codes = _codes(keys, _repeats(keys, self.nulls), at < self.nulls)
        table = PerfectHash.build(codes)
        slots = table.slots(codes)
        numbers, prints = np.zeros(len(keys), dtype="<u4"), np.zeros(len(keys), dtype="<u4")
        numbers[slots] = at
        prints[slots] = (_mix(codes, 3) >> _U(32)).astype("<u4")
        index = table.to_bytes() + prints.tobytes() + numbers.tobytes()
        ends = np.frombuffer(self.ends, dtype=np.int64).astype("<u8").tobytes()
        places = np.cumsum([self.written, len(ends), keys.nbytes])
        self.out.write(ends + keys.tobytes() + index)
        # A trailer, not a header: an object store takes a file in one go.
        self.out.write(_HEAD.pack(MAGIC, len(keys), self.nulls, self.tokens, *map(int, places), len(index), self.id_bytes))
        self.out.close()


class ShardReader:
    """Keyed access to a shard: the index is read once, ids where they lie."""

    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, self.documents, self.nulls, self.tokens, ends, keys, index, length, self.id_bytes = _HEAD.unpack(self.file.read_at(_HEAD.size, size - _HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a shard of token ids")
        self.ends = np.frombuffer(self.file.read_at(keys - ends, ends), dtype="<u8").astype(np.int64)
        self._keys_at = keys
        data = self.file.read_at(length, index)
        self.table, at = PerfectHash.from_bytes(data)
        self.prints = np.frombuffer(data, dtype="<u4", count=self.documents, offset=at)
        self.numbers = np.frombuffer(data, dtype="<u4", count=self.documents, offset=at + 4 * self.documents)

    def keys(self) -> np.ndarray:
        """Keys of the documents; those of the first ``nulls`` stand for null."""
        return np.frombuffer(self.file.read_at(8 * self.documents, self._keys_at), dtype="<i8")

    def find(self, keys: np.ndarray, repeats: np.ndarray, nulls: np.ndarray) -> np.ndarray:
        """Number of the document of each key, or -1."""
        codes = _codes(keys, repeats, nulls)
        slots = self.table.slots(codes)
        there = slots >= 0
        there[there] = self.prints[slots[there]] == (_mix(codes[there], 3) >> _U(32)).astype(np.uint32)
        return np.where(there, self.numbers[np.where(there, slots, 0)].astype(np.int64) if self.documents else 0, -1)

    def ids(self, number: int) -> np.ndarray:
        first = int(self.ends[number - 1]) if number else 0
        count = int(self.ends[number]) - first
        return np.frombuffer(self.file.read_at(count * self.id_bytes, first * self.id_bytes), dtype=f"<u{self.id_bytes}")

    def several(self, numbers: np.ndarray, most: int = 1 << 22) -> Iterator[np.ndarray]:
        """Ids of several documents; those that lie one after another are read together, ``most`` ids at a time."""
        at = 0
        while at < len(numbers):
            first = int(numbers[at])
            before = int(self.ends[first - 1]) if first else 0
            end = at + 1
            while end < len(numbers) and numbers[end] == numbers[end - 1] + 1 and self.ends[numbers[end]] - before <= most:
                end += 1
            ends = (self.ends[numbers[at:end]] - before).tolist()
            raw = np.frombuffer(self.file.read_at(ends[-1] * self.id_bytes, before * self.id_bytes), dtype=f"<u{self.id_bytes}")
            yield from (raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True))
            at = end

    def get(self, key: int | None, repeat: int = 0) -> np.ndarray | None:
        number = int(self.find(np.array([key or 0]), np.array([repeat]), np.array([key is None]))[0])
        return None if number < 0 else self.ids(number)

    def close(self) -> None:
        self.file.close()


# The pattern of the pre-tokenizer whose texts may be encoded by parts.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIGNS = r"!-&(-@\[-`{-~"  # ASCII digits and punctuation without the apostrophe, which may begin a contraction
#: Parts that no token crosses: letters up to a sign or space, signs up to a letter or space, or
#: all up to the next space.
_PARTS = re.compile(f"[{_LETTERS}]++(?=[{_SIGNS} \n]|\\Z)|[{_SIGNS}]++(?=[{_LETTERS} \n]|\\Z)|[^ \n]+")
#: Parts of one word for the pre-tokenizer, whose last token alone ends a word; each digit is one.
_WORD = re.compile(rf"[{_LETTERS}]+|(?:(?![0-9])[{_SIGNS}])+")
#: Words that are encoded as one text.
TOGETHER = 256


class WordEncoder:
    """Encodes texts with the tokenizers library; parts of texts are remembered.

    Parts are cut only for a tokenizer with WORD_PATTERN, and not in texts that may hold an added
    token; others are encoded whole.  The first text of every block is also encoded whole and
    must agree.
    """

    def __init__(self, path: str, end_id: int, remembered: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.id_bytes = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.id_bytes == 2 else "I"
        self.end = self._raw([end_id])
        self.memory: dict[str, bytes] = {}
        self.remembered = remembered
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        squeezed = any(s.get("type") == "Replace" and (s["pattern"].get("Regex"), s["content"]) == ("\\s+", " ") for s in steps)
        plain = squeezed and all(s.get("type") in ("NFC", "Replace", "Lowercase") for s in steps)
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        worded = [s.get("type") for s in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"].get("Regex") == WORD_PATTERN and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.parted = bool(plain and worded) and not spec.get("post_processor") and not spec.get("truncation")
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
            self.ends[[k for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith(suffix)]] = True

    def _raw(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self._raw(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, parts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Raw ids of parts.  Words go to the library many in a text, whose ids are cut where a
        word ends; a text that has not an end for each of its words is encoded word by word."""
        words = [p for p in parts if self.ends is not None and _WORD.fullmatch(p)]
        alone = list(set(parts).difference(words))
        lots = [words[a : a + TOGETHER] for a in range(0, len(words), TOGETHER)]
        for lot, raw in zip(lots, self._whole([" ".join(lot) for lot in lots]), strict=True):
            cuts = (self.id_bytes * (1 + np.flatnonzero(self.ends[np.frombuffer(raw, dtype=f"<u{self.id_bytes}")]))).tolist()
            if len(cuts) == len(lot) and cuts[-1] == len(raw):
                yield from zip(lot, (raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)), strict=True)
            else:
                alone += lot
        yield from zip(alone, self._whole(alone), strict=True)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Raw ids of each text, with the end id."""
        texts = [t or "" for t in texts]
        if not self.parted:
            return [x + self.end for x in self._whole(texts)]
        split = [_PARTS.findall(t) for t in texts]
        memory = self.memory
        seen = set().union(*split)
        new = list(seen.difference(memory))
        if len(memory) + len(new) > self.remembered:
            memory.clear()
            new = list(seen)
        if new:
            memory.update(self._parts(new))
        out = [b"".join(map(memory.__getitem__, parts)) for parts in split]
        whole = [k for k, t in enumerate(texts) if any(a in t for a in self.added)]
        for k, ids in zip(whole, self._whole([texts[k] for k in whole]), strict=True):
            out[k] = ids
        if texts and out[0] != self._whole(texts[:1])[0]:
            raise ValueError("parts and whole text are encoded differently")
        return [x + self.end for x in out]


def _size(frame: DataFrame) -> int:
    """Bytes of the rows by the plan's statistics, which files give; counted where it has none."""
    told = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return told if told < 1 << 60 else frame.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def write_shards(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    shards: int | None = None,
    shard_bytes: int = SHARD_BYTES,
    folder: str | None = None,
) -> DataFrame:
    """Write shards and return their manifest, one row for each shard, in key order.

    The manifest comes to the driver, which names the files and counts repeats over shards.
    """
    spark = docs.sparkSession
    if not isinstance(docs.select(col(key)).schema[0].dataType, IntegralType):
        raise TypeError(f"{key} is no column of whole numbers")
    folder = qualified(spark, folder or shared_path(spark, "token-ids"))
    frame = docs.select(col(key).cast("long").alias("key"), F.coalesce(col(text), F.lit("")).alias("text"))
    if shards is None:
        size = _size(frame)
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    # Rows of a key are split by their place, so that no key and no null fills a task.
    order = ["key", "place"]
    ordered = frame.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(shards, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)

    mine = ("words", tokenizer_path, end_id)
    schema = MANIFEST.removesuffix(", base long") + ", first_rows long, last_rows long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(mine)
        encoder = held(mine, lambda: WordEncoder(tokenizer_path, end_id))
        writer, part, path = None, -1, ""
        for batch in batches:
            for block in blocks_of(batch, 2048, 1 << 23):
                keys, texts, parts = (c.to_pylist() for c in block.columns)
                if writer is None:
                    part, path = parts[0], f"{folder}/shard-{parts[0]:06d}-{uuid.uuid4().hex[:8]}.tok"
                    writer = ShardWriter(path, encoder.id_bytes)
                for k, ids in zip(keys, encoder.encode(texts), strict=True):
                    writer.add(k, ids)
        if writer is not None:
            writer.close()
            n, nulls = len(writer.keys), writer.nulls
            own = np.frombuffer(writer.keys, dtype=np.int64)
            first, last = None if nulls else int(own[0]), None if nulls == n else int(own[-1])
            first_rows = nulls or int((own == first).sum())
            last_rows = nulls if last is None else int((own[nulls:] == last).sum())
            row = (part, path, n, writer.tokens, nulls, first, last, first_rows, last_rows)
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string() if k == 1 else pa.int32() if k == 0 else pa.int64()) for k, v in enumerate(row)], names=[f.split()[0] for f in schema.split(", ")])

    rows = sorted(ordered.select("key", "text", "part").mapInArrow(run, schema).collect(), key=lambda r: r["shard"])
    out, last, seen = [], "none", 0
    for r in rows:
        base = seen if r["first_key"] == last else 0
        out.append((r["shard"], r["path"], r["documents"], r["tokens"], r["nulls"], r["first_key"], r["last_key"], base))
        seen = r["last_rows"] + (base if r["last_key"] == r["first_key"] else 0)
        last = r["last_key"]
    return spark.createDataFrame(out, MANIFEST)


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, repeat, start, n_tokens, ids_crc32) of every document, from the files.

    Each key of a shard goes through the shard's index to its ids.
    """
    spark = manifest.sparkSession
    rows = sorted(manifest.collect(), key=lambda r: r["shard"])
    starts = np.r_[0, np.cumsum([r["tokens"] for r in rows])].tolist()
    named = [(r["path"], int(starts[k]), r["base"]) for k, r in enumerate(rows)]
    frame = spark.createDataFrame(named, "path string, start long, base long").repartition(max(1, len(named)))
    schema = "doc_id long, repeat long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = ShardReader(path)
                keys = shard.keys()
                repeats, null = _repeats(keys, shard.nulls), np.arange(len(keys)) < shard.nulls
                first = null if shard.nulls else keys == keys[:1]
                for a in range(0, len(keys), 4096):
                    here = slice(a, a + 4096)
                    numbers = shard.find(keys[here], repeats[here], null[here])
                    if (numbers < 0).any():
                        raise ValueError(f"{path}: a key is not in the index")
                    told = [(len(x), zlib.crc32(x.astype("<u4").tobytes())) for x in shard.several(numbers)]
                    before = np.where(numbers > 0, shard.ends[numbers - 1], 0) + start
                    again = repeats[here] + np.where(first[here], base, 0)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[here], mask=null[here], type=pa.int64()), pa.array(again, type=pa.int64()), pa.array(before, type=pa.int64()),
                            pa.array([n for n, _ in told], type=pa.int64()), pa.array([c for _, c in told], type=pa.int64()),
                        ],
                        names=["doc_id", "repeat", "start", "n_tokens", "ids_crc32"],
                    )
                shard.close()

    return frame.mapInArrow(run, schema)


class TokenStore:
    """Keyed reads over all shards: a key's shard by range, its ids by the shard's index."""

    def __init__(self, manifest: DataFrame):
        self.rows = sorted(manifest.collect(), key=lambda r: r["shard"])
        self.open: dict[int, ShardReader] = {}
        order = lambda k: (k is not None, k or 0)
        self.order, self.last = order, [order(r["last_key"]) for r in self.rows]

    def get(self, key: int | None, repeat: int = 0) -> np.ndarray | None:
        for k in range(bisect_left(self.last, self.order(key)), len(self.rows)):
            row = self.rows[k]
            if self.order(row["first_key"]) > self.order(key):
                return None
            if k not in self.open:
                self.open[k] = ShardReader(row["path"])
            found = self.open[k].get(key, repeat - (row["base"] if row["first_key"] == key else 0))
            if found is not None:
                return found
        return None


def token_digests(spark: SparkSession, docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    return read_shards(write_shards(docs, tokenizer_path, **options))
