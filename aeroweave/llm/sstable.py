"""Sorted-string-table shards of token ids, one shard a range of document identifiers.

File: data blocks | Bloom filter | index | footer.

* Entry: varint bytes shared with the key before, varint further key bytes, varint value bytes, the further
  key bytes, the value (token ids, little-endian). A key is stored in full every ``RESTART`` entries.
* Block: entries of about ``BLOCK_BYTES``, zstd-compressed, then the CRC-32 of the compressed bytes.
* Index: for each block its first and last key, place, length, and the ids and entries before it in the shard.
* Filter: ``BITS_PER_KEY`` bits a key, ``PROBES`` probes by double hashing.
* Footer: fixed size; places of filter and index, totals, width of an id, magic number.

Keys order as the identifiers do: byte 0 for null, or byte 1 and the 8 bytes of the number, sign flipped.
Entries of equal keys stay in order of their texts, so repeated rows keep a defined place.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import columns, cut, new_path, slices

MAGIC = b"AWSST001"
RESTART = 16
BLOCK_BYTES = 1 << 17
BITS_PER_KEY = 10
PROBES = 7
FOOTER = struct.Struct("<QQQQQQI8s")


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


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


def _bits(key: bytes, n_bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b) % n_bits for i in range(PROBES)]


class Writer:
    """Writes one shard to an open binary stream; keys must come in order."""

    def __init__(self, out, id_bytes: int, block_bytes: int = BLOCK_BYTES):
        self.out, self.id_bytes, self.block_bytes = out, id_bytes, block_bytes
        self.at = self.ids = self.entries = self.in_block = 0
        self.block: list[bytes] = []
        self.size = 0
        self.first = self.last = b""
        self.before = (0, 0)
        self.index: list[bytes] = []
        self.hashed: list[bytes] = []
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes) -> None:
        if self.entries and key < self.last:
            raise ValueError("keys out of order")
        shared = 0
        if self.in_block % RESTART:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        if not self.in_block:
            self.first, self.before = key, (self.ids, self.entries)
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.size += len(entry)
        if not self.hashed or self.hashed[-1] != key:
            self.hashed.append(key)
        self.last = key
        self.in_block += 1
        self.entries += 1
        self.ids += len(value) // self.id_bytes
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.in_block:
            return
        data = self.pack.compress(b"".join(self.block))
        self.out.write(data)
        self.out.write(struct.pack("<I", zlib.crc32(data)))
        self.index.append(struct.pack("<BB", len(self.first), len(self.last)) + self.first + self.last + struct.pack("<QQQQ", self.at, len(data), *self.before))
        self.at += len(data) + 4
        self.block, self.size, self.in_block = [], 0, 0

    def close(self) -> None:
        self._flush()
        n_bits = max(64, -(-len(self.hashed) * BITS_PER_KEY // 8) * 8)
        bits = bytearray(n_bits // 8)
        for key in self.hashed:
            for b in _bits(key, n_bits):
                bits[b >> 3] |= 1 << (b & 7)
        bloom_at = self.at
        self.out.write(bits)
        index = b"".join(self.index)
        self.out.write(index)
        index_at = bloom_at + len(bits)
        self.out.write(FOOTER.pack(bloom_at, len(bits), index_at, len(index), self.entries, self.ids, self.id_bytes, MAGIC))


@dataclass
class Block:
    first: bytes
    last: bytes
    at: int
    length: int
    ids_before: int
    entries_before: int


class Reader:
    """Reads one shard; a lookup touches the filter, the index and one block."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        bloom_at, bloom_len, index_at, index_len, self.entries, self.ids, self.id_bytes, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        self.bloom = self._read(bloom_at, bloom_len)
        raw, at, self.blocks = self._read(index_at, index_len), 0, []
        while at < len(raw):
            a, b = raw[at], raw[at + 1]
            at += 2
            first, last = raw[at : at + a], raw[at + a : at + a + b]
            at += a + b
            self.blocks.append(Block(first, last, *struct.unpack_from("<QQQQ", raw, at)))
            at += 32
        self.lasts = [b.last for b in self.blocks]
        self.dtype = np.dtype(f"<u{self.id_bytes}")
        self.unpack = zstandard.ZstdDecompressor()

    def _read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(length)
        if len(data) != length:
            raise ValueError("the shard is cut short")
        return data

    def _entries(self, block: Block) -> Iterator[tuple[bytes, bytes]]:
        data = self._read(block.at, block.length + 4)
        packed = data[:-4]
        if zlib.crc32(packed) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block is damaged")
        raw, at, key = self.unpack.decompress(packed), 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            more, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + more]
            at += more
            yield key, raw[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in the shard, its ids) in order."""
        for block in self.blocks:
            before = block.ids_before
            for key, value in self._entries(block):
                yield id_of(key), before, value
                before += len(value) // self.id_bytes

    def get(self, doc_id: int | None) -> list[tuple[int, np.ndarray]]:
        """(ids before it in the shard, ids) of every entry with this identifier."""
        key = key_of(doc_id)
        n_bits = len(self.bloom) * 8
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bits(key, n_bits)):
            return []
        out = []
        for block in self.blocks[bisect.bisect_left(self.lasts, key) :]:
            if block.first > key:
                break
            before = block.ids_before
            for k, value in self._entries(block):
                if k == key:
                    out.append((before, np.frombuffer(value, self.dtype)))
                before += len(value) // self.id_bytes
        return out


def _open(path: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return system, at


MANIFEST = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("first_id", T.LongType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_ids", T.LongType()),
    ]
)
ENTRIES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("shard", T.StringType()),
    ]
)


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None) -> DataFrame:
    """Encode every text and write shards under ``folder`` in ascending ``doc_id`` order (null first).

    Returns the manifest (path, first_id, n_docs, n_ids), a written table. Null texts are empty; each text
    ends with id 0. A task that is run again writes a file of another name, and only the manifest's files
    count. An empty input gives an empty manifest.
    """
    path = tokenizer or tokens.tokenizer_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = writer = system = None
        first = None
        for part in slices(batches, rows=512, size=1 << 20, operator=tokens.OPERATOR):
            encoder = tokens.encoder(path)
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            if writer is None:
                target = f"{folder}/{uuid.uuid4().hex}.sst"
                system, at = _open(target)
                system.create_dir(at.rpartition("/")[0], recursive=True)
                stream, first = system.open_output_stream(at), ids[0]
                writer = Writer(stream, encoder.dtype.itemsize)
            for doc_id, value in zip(ids, encoder.encode(texts), strict=True):
                writer.add(key_of(doc_id), value)
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"path": [target], "first_id": pa.array([first], pa.int64()), "n_docs": [writer.entries], "n_ids": [writer.ids]})

    rows = columns(docs, doc_id=T.LongType(), text=T.StringType())
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32, shard."""
    # one row a shard, of which there are as many as tasks that wrote
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), F.col("path")).rowsBetween(Window.unboundedPreceding, -1)
    based = cut(manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long"))).select("path", "base"), "bases")
    n = max(1, based.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, at = _open(path)
                with system.open_input_file(at) as file:
                    reader = Reader(file)
                    rows: list[tuple] = []
                    for doc_id, start, value in reader.scan():
                        ids = np.frombuffer(value, reader.dtype).astype("<u4")
                        rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.tobytes())))
                        if len(rows) == 4096:
                            yield _entry_batch(rows, path)
                            rows = []
                    if rows:
                        yield _entry_batch(rows, path)

    return based.repartition(n).mapInArrow(read, ENTRIES)


def _entry_batch(rows: list[tuple], path: str) -> pa.RecordBatch:
    doc_id, start, n, crc = zip(*rows, strict=True)
    kind = pa.int64()
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_id, kind), pa.array(start, kind), pa.array(n, kind), pa.array(crc, kind), pa.array([path.rpartition("/")[2]] * len(rows))],
        names=ENTRIES.names,
    )


def token_table(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the shards to the shared folder and read them back."""
    return read_shards(write_shards(docs, new_path(docs.sparkSession, "sst"), tokenizer))
