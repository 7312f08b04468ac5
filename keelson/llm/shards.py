"""Sorted-string-table shards of token ids.

A shard holds documents in ascending key order, in blocks of prefix-compressed keys. After the blocks
come a sparse index (each block's first key, place and length), a Bloom filter of the keys and a fixed
footer that says where these are. A lookup asks the filter, searches the index by halves, and reads
one block (or its successors while a key goes on).

A key is one byte (0: null identifier, 1: otherwise) and the identifier as 8 big-endian bytes with the
sign bit turned, so that bytes sort as identifiers do. Values are ids of 16 or 32 bits, compressed by
block with zstd.
"""

from __future__ import annotations

import bisect
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import frames

MAGIC = b"KSST0001"
FOOTER = struct.Struct("<QQQQQQB7x8s")  # index place, length; filter place, length; documents; tokens; id width; magic
BLOCK_BYTES = 64 << 10
RESTART = 16
_BITS, _PROBES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [((a + i * b) & ((1 << 64) - 1)) % bits for i in range(_PROBES)]


class ShardWriter:
    """Writes keys in ascending order (equal ones may follow each other) to a binary stream."""

    def __init__(self, out, width: int = 4):
        self.out, self.width = out, width
        self.pack = zstandard.ZstdCompressor(level=1)
        self.at = self.documents = self.tokens = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self._clear()

    def _clear(self) -> None:
        self.heads, self.values, self.size, self.count, self.last, self.first = bytearray(), [], 0, 0, b"", b""

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: packed little-endian integers of the writer's width."""
        key = key_of(doc_id)
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.count % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        if not self.count:
            self.first = key
        self.heads += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids) // self.width) + key[shared:]
        self.values.append(ids)
        self.size += len(ids)
        self.count += 1
        self.last = key
        self.keys.append(key)
        self.documents += 1
        self.tokens += len(ids) // self.width
        if self.size + len(self.heads) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.count:
            return
        raw = b"".join(self.values)
        if self.width == 2:  # low and high bytes apart pack better
            raw = np.frombuffer(raw, np.uint8).reshape(-1, 2).T.tobytes()
        body = struct.pack("<II", self.count, len(self.heads)) + bytes(self.heads) + self.pack.compress(raw)
        body += struct.pack("<I", zlib.crc32(body))
        self.out.write(body)
        self.index.append((self.first, self.at, len(body)))
        self.at += len(body)
        self._clear()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(a) + _varint(n) for k, a, n in self.index)
        bits = max(64, _BITS * len(self.keys))
        bloom = np.zeros(-(-bits // 8), np.uint8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_raw = struct.pack("<Q", bits) + bloom.tobytes()
        self.out.write(index + bloom_raw + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom_raw), self.documents, self.tokens, self.width, MAGIC))


class ShardReader:
    """Reads a shard through a seekable file: in order, or by key."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - FOOTER.size)
        index_at, index_n, bloom_at, bloom_n, self.documents, self.tokens, self.width, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        file.seek(index_at)
        raw, self.keys, self.places, at = file.read(index_n), [], [], 0
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.keys.append(bytes(raw[at : at + n]))
            place, at = _read_varint(raw, at + n)
            length, at = _read_varint(raw, at)
            self.places.append((place, length))
        file.seek(bloom_at)
        bloom = file.read(bloom_n)
        self.bits, self.bloom = struct.unpack("<Q", bloom[:8])[0], bloom[8:]

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        place, length = self.places[k]
        self.file.seek(place)
        body = self.file.read(length)
        if zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        count, heads = struct.unpack("<II", body[:8])
        raw = zstandard.ZstdDecompressor().decompress(body[8 + heads : -4])
        if self.width == 2:
            raw = np.frombuffer(raw, np.uint8).reshape(2, -1).T.tobytes()
        ids = np.frombuffer(raw, "<u2" if self.width == 2 else "<u4")
        at, key, before = 8, b"", 0
        for _ in range(count):
            shared, at = _read_varint(body, at)
            own, at = _read_varint(body, at)
            n, at = _read_varint(body, at)
            key = key[:shared] + bytes(body[at : at + own])
            at += own
            yield key, ids[before : before + n]
            before += n

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.places)):
            for key, ids in self.block(k):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document under this identifier, none if there is no such."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        k, out = max(bisect.bisect_left(self.keys, key) - 1, 0), []
        while k < len(self.keys) and self.keys[k] <= key:
            out += [ids for own, ids in self.block(k) if own == key]
            k += 1
        return out


#: Words whose lower case, normal form and parts follow from single characters: ASCII and common Latin letters.
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-įı-ſ]+")
#: The vocabulary's own rule for parts of such a word in lower case.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ſ]+|[0-9]|[^\sa-z0-9À-ÖØ-öø-ſ]+")
_CACHED = 500_000  # distinct words that a Python worker keeps
_FRONT = 32  # characters of a text that order rows of one identifier between shards


def byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as its Latin-1 character where that is printable and no
    space, and the others, in order, as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class WordEncoder:
    """Whole texts through a `tokenizers` file whose rules never join characters across white space.

    Each distinct word goes to the library once: runs of Latin letters to its model, all else through
    its full encode(). A text that holds an added token goes there whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.words: dict[str, bytes] = {}
        self.characters = byte_characters()

    def ids(self, values: list[int]) -> bytes:
        return struct.pack(f"<{len(values)}{self.code}", *values)

    def _keep(self, word: str, ids: bytes) -> None:
        if len(word) > 64:
            return
        if len(self.words) >= _CACHED:
            self.words.clear()
        self.words[word] = ids

    def _full(self, word: str) -> bytes:
        return self.ids(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        known = self.words.get(part)
        if known is None:
            if part.isalpha():
                own = part if part.isascii() else part.encode().decode("latin-1").translate(self.characters)
                known = self.ids([t.id for t in self.model.tokenize(own)])
            else:
                known = self._full(part)
            self._keep(part, known)
        return known

    def word(self, word: str) -> bytes:
        out = b"".join([self._part(p) for p in _PARTS.findall(word.lower())]) if _PLAIN.fullmatch(word) else self._full(word)
        self._keep(word, out)
        return out

    def encode(self, text: str) -> bytes:
        low = text.lower()
        if any(t in text or t.lower() in low for t in self.added):
            return self._full(text)
        if text.isascii():
            text = text.lower()
        get, make = self.words.get, self.word
        # characters 28 to 31 are white space to split() but not to the vocabulary
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        return b"".join([get(w) or make(w) for w in (re.split(r"[\x20\x09-\x0D]+", text) if odd else text.split()) if w])


_encoders: dict[str, WordEncoder] = frames.kept()


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_shards(df: DataFrame, vocabulary: str, folder: str, end_id: int, doc_id: str = "doc_id", text: str = "text", shard_rows: int = 200_000, shards: int | None = None) -> DataFrame:
    """Encode df's texts and write them as shards in `folder`; a row for each shard: its number, path, documents and tokens.

    Identifiers ascend through the shards and within each; equal ones are ordered by their text, and
    null identifiers come first. A null text is empty: just the end id. Repeated rows are kept, each by itself.
    An empty table gives no shards. Texts of any length are encoded whole, one at a time. Other columns of df,
    whatever their names, are not looked at. Each shard is written under a
    name of its own and then renamed, so a task that runs again, or twice, leaves the same file.

    Shards are ranges of identifiers; where rows share one, of the first characters of their texts as well, and rows
    that are equal altogether may be in any of neighbouring shards. There are `shards` (by default as many as the session
    has shuffle partitions), and more where one would hold over shard_rows.
    """
    spark = df.sparkSession
    own = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    n = max(shards or frames.slices(spark), -(-own.count() // shard_rows), 1)
    if own.groupBy("doc_id").count().where("count > 1").isEmpty():
        parts = own.repartitionByRange(n, "doc_id")
    else:
        front = F.substring("text", 1, _FRONT)
        alike = F.when(F.coalesce(F.length("text"), F.lit(0)) < _FRONT, F.monotonically_increasing_id())
        parts = own.select("*", front.alias("front"), alike.alias("alike")).repartitionByRange(n, "doc_id", "front", "alike").select("doc_id", "text")
    parts = parts.sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = frames.filesystem(folder)
        own_encoder = encoder(vocabulary)
        end = own_encoder.ids([end_id])
        writer, number = None, TaskContext.get().partitionId()
        for batch in batches:
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    temporary = f"{base}/.part-{number:06d}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temporary)
                    writer = ShardWriter(out, own_encoder.width)
                writer.add(d, own_encoder.encode(t or "") + end)
        if writer:
            writer.close()
            out.close()
            path = f"{base}/shard-{number:06d}.ksst"
            fs.move(temporary, path)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([path]), pa.array([writer.documents], pa.int64()), pa.array([writer.tokens], pa.int64())], names=["shard", "path", "documents", "tokens"])

    return parts.mapInArrow(frames.task(run, __name__), "shard int, path string, documents long, tokens long")


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """What the shards hold, as doc_id, start (tokens of all documents before), n_tokens and ids_crc32.

    shards: as write_shards() returned it. Starts come from the shards' own totals, one number a shard.
    """
    spark = shards.sparkSession
    listed = sorted(map(tuple, shards.collect()))
    starts = np.concatenate([[0], np.cumsum([r[3] for r in listed])]).tolist()
    schema = "shard int, path string, start long"
    plan = spark.createDataFrame([(r[0], r[1], s) for r, s in zip(listed, starts, strict=False)], schema)
    plan = plan.repartition(max(1, min(len(listed), 4 * frames.slices(spark))), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = frames.filesystem(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                ids, begins, counts, sums = [], [], [], []
                with fs.open_input_file(path) as file:
                    for doc, tokens in ShardReader(file, file.size()):
                        ids.append(doc)
                        begins.append(start)
                        counts.append(len(tokens))
                        sums.append(zlib.crc32(tokens.astype("<u4").tobytes()))
                        start += len(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(begins, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return plan.mapInArrow(frames.task(run, __name__), "doc_id long, start long, n_tokens long, ids_crc32 long")
